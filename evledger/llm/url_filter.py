"""URL verdicts: rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host and the start of a path, like ``example.net/en/``; it fits the host
and its subdomains, and the longest fitting rule decides.  URLs that a rule decides
are the labelled ones: features of the text of the URL, and block rates of its
suffixes among the labelled of other rules, train the trees that judge all others.  Features are SQL
expressions and the trees are Spark's, so nothing leaves the executors' JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evledger.session import broadcast_if_small, materialize

TREES = 20
DEPTH = 4
STEP = 0.2
#: Weight of the overall block rate in the rate of a suffix.
PRIOR = 20.0
#: Up to so many rules are one expression; more are joined by host suffix.
INLINE_RULES = 64
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0].translate(_LOWER)

    @property
    def path(self) -> str:
        return "".join(self.pattern.partition("/")[1:])


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or without ``://``."""
    known = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1), _UPPER, _UPPER.lower())
    path = F.regexp_extract(rest, r"(?s)^[^/]*(.*)", 1)
    return F.when(known, host).otherwise(F.lit("")), F.when(known, path).otherwise(F.lit(""))


def _fits(host: Column, path: Column, rule: Rule) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def apply_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls(key, host, path)`` with ``rule`` and ``ruled``, null where none fits.

    Of rules of one length the alphabetically first wins, of equal patterns a block.
    """
    ranked = sorted(set(rules), key=lambda r: (-len(r.pattern), r.pattern, r.verdict != BLOCK))
    if len(ranked) <= INLINE_RULES:
        rule = verdict = F.lit(None).cast("string")
        for r in reversed(ranked):
            fits = _fits(F.col("host"), F.col("path"), r)
            rule, verdict = F.when(fits, r.pattern).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
        return urls.withColumns({"rule": rule, "ruled": verdict})
    spark = urls.sparkSession
    rows = [(n, r.host, r.path, r.pattern, r.verdict) for n, r in enumerate(ranked)]
    listed = spark.createDataFrame(rows, "rank int, _suffix string, _path string, _rule string, _verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    hits = urls.select("key", "path", F.explode(suffixes).alias("_suffix")).join(broadcast_if_small(listed), "_suffix")
    hits = hits.filter(F.col("path").startswith(F.col("_path")))
    best = hits.groupBy("key").agg(F.min(F.struct("rank", "_rule", "_verdict")).alias("best"))
    best = best.select(F.col("key").alias("_key"), F.col("best._rule").alias("rule"), F.col("best._verdict").alias("ruled"))
    return urls.join(best, F.col("key") == F.col("_key"), "left").drop("_key")


def _entropy(text: Column) -> Column:
    """Bits per character; zero for an empty text."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
    return F.aggregate(
        F.array_distinct(F.split(text, "")),
        F.lit(0.0),
        lambda total, c: total - F.when(c != "", share(c) * F.log2(share(c))).otherwise(F.lit(0.0)),
    )


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


LEXICAL = (
    "length host_length path_length depth labels digit_ratio host_digits entropy params query_length hyphens marks"
    " longest_part has_fragment secure"
).split()
SUFFIXES = ("host_suffix", "path_suffix")


def features(urls: DataFrame) -> DataFrame:
    """Adds a double for each of `LEXICAL` and the suffixes of host and path."""
    url = F.coalesce("url", F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    size = F.greatest(F.length(url), F.lit(1))
    values = {
        "length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": _count(path, "/"),
        "labels": F.size(F.split(host, r"\.")),
        "digit_ratio": _count(url, "[0-9]") / size,
        "host_digits": _count(host, "[0-9]"),
        "entropy": _entropy(url),
        "params": F.when(query == "", F.lit(0)).otherwise(F.size(F.split(query, "&"))),
        "query_length": F.length(query),
        "hyphens": _count(url, "-"),
        "marks": _count(url, "[^A-Za-z0-9]"),
        "longest_part": F.array_max(F.transform(F.split(url, "[^A-Za-z0-9]"), F.length)),
        "has_fragment": url.contains("#").cast("int"),
        "secure": url.startswith("https:").cast("int"),
    }
    named = {name: F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in values.items()}
    named["host_suffix"] = F.substring_index(host, ".", -1)
    named["path_suffix"] = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})/?$", 1)
    return urls.withColumns(named)


def _with_rates(rows: DataFrame, labelled: DataFrame, own: bool) -> DataFrame:
    """Adds the damped block rate and the share of each suffix among the labelled.

    A rate is what other rules say of a suffix: a labelled row (``own``) does not see the
    rows of its own rule, and a suffix that only one rule has labelled has the overall rate
    for all rows.  Else the rate would repeat the verdict of the rule and carry it over to
    paths that the rule leaves open.
    """
    totals = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    overall = (totals["blocked"] or 0.0) / max(1, totals["n"])
    zero = F.lit(0.0)
    for name in SUFFIXES:
        per_rule = labelled.groupBy(F.col(name).alias("_suffix"), F.col("rule").alias("_rule")).agg(
            F.count("*").alias("_own_n"), F.sum("label").alias("_own_b")
        )
        whole = per_rule.groupBy("_suffix").agg(
            F.sum("_own_n").alias("_n"), F.sum("_own_b").alias("_b"), F.count("*").alias("_rules")
        )
        joined = rows.join(broadcast_if_small(whole), F.col(name) == F.col("_suffix"), "left").drop("_suffix")
        if own:
            same = (F.col(name) == F.col("_suffix")) & (F.col("rule") == F.col("_rule"))
            joined = joined.join(broadcast_if_small(per_rule), same, "left")
            n, b = F.col("_n") - F.col("_own_n"), F.col("_b") - F.col("_own_b")
        else:
            n, b = (F.when(F.col("_rules") > 1, F.col(c)) for c in ("_n", "_b"))
        n, b = F.coalesce(n, zero), F.coalesce(b, zero)
        rates = {f"{name}_rate": (b + PRIOR * overall) / (n + PRIOR), f"{name}_share": n / max(1, totals["n"])}
        rows = joined.withColumns(rates).select(*rows.columns, *rates)
    return rows


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` per row of ``pages``.

    ``verdict`` is the rule's, else the trees'; ``score`` is their probability of a
    block, null where a rule decides; at exactly 0.5 the verdict is a block.  A null URL or one
    without ``://`` has an empty host and path and fits no rule.  Repeated rows are judged alike,
    other columns are not read.  Where the labelled URLs have one verdict
    only, the others get it too; without any they are allowed.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    if len(rules) > INLINE_RULES:
        rows = materialize(rows.withColumn("key", F.monotonically_increasing_id()), "urls")
    rows = features(apply_rules(rows, rules)).drop("url")
    rows = materialize(rows.withColumn("label", (F.col("ruled") == BLOCK).cast("double")), "url-features")
    labelled = rows.filter("label IS NOT NULL")
    ends = labelled.agg(F.min("label"), F.max("label")).first()
    base = ["page_id", "host", "path", "rule"]
    if ends[0] == ends[1]:
        only = BLOCK if ends[0] else ALLOW
        none = F.lit(None).cast("double").alias("score")
        return rows.select(*base, F.coalesce("ruled", F.lit(only)).alias("verdict"), none)
    inputs = [*LEXICAL, *(f"{n}_{kind}" for n in SUFFIXES for kind in ("rate", "share"))]
    vectors = VectorAssembler(inputCols=inputs, outputCol="features")
    trees = GBTClassifier(
        maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, featuresCol="features", labelCol="label"
    )
    seen = vectors.transform(_with_rates(labelled, labelled, True)).select("label", "features")
    model = trees.fit(seen)
    judged = model.transform(vectors.transform(_with_rates(rows.filter("label IS NULL"), labelled, False)))
    score = vector_to_array(F.col("probability"))[1]
    by_trees = judged.select(*base, F.when(score >= 0.5, BLOCK).otherwise(ALLOW).alias("verdict"), score.alias("score"))
    by_rule = labelled.select(*base, F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return by_rule.union(by_trees)
