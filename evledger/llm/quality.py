"""Quality rules whose thresholds come from the corpus, with DataFrame functions only.

Every text is measured on the executors' JVM.  Each measure is a whole number; a
quantile sketch of it is a histogram with log-linear bins (exact below 128, then
seven significant bits, so under 1.6 % off), kept per language and source.  Such
sketches merge by adding counts: partial aggregation merges them before the
shuffle, and those of a language or of the whole corpus are sums of the finer
ones.  A document is judged by fences around the middle half of its group's
documents; a group with few documents takes its language's fences, a language
with few the corpus's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evledger.llm.common import fresh
from evledger.session import broadcast_if_small, materialize

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Groups with fewer documents use the next coarser sketch.
MIN_GROUP = 100
#: Middle halves that a fence lies beyond the quartiles.
REACH = 3


@dataclass(frozen=True)
class Rule:
    """A measure in thousandths, and the slack added to its fences."""

    name: str
    slack: int
    low: bool = False


RULES = (
    Rule("symbols", 150),
    Rule("dup_lines", 500),
    Rule("repeats", 450),
    Rule("word_length", 2500, low=True),
    Rule("marks", 60),
    Rule("capitals", 150),
)


def _repeat_words(words: Column, hashes: Column, sorted_windows: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    bits = 24
    same = lambda x, y: F.shiftright(x, bits) == F.shiftright(y, bits)
    near = F.filter(
        sorted_windows,
        lambda x, i: F.coalesce(same(x, F.get(sorted_windows, i - 1)), F.lit(False))
        | F.coalesce(same(x, F.get(sorted_windows, i + 1)), F.lit(False)),
    )
    window = lambda p: F.struct(
        F.get(words, p).alias("a"), F.get(words, p + 1).alias("b"), F.get(words, p + 2).alias("c"), p.alias("p")
    )
    # Equal 40-bit prefixes of hashes only nominate; the words themselves decide.
    return F.sort_array(F.transform(near, lambda x: window(x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))))


def measure(docs: DataFrame, text: str = "text", into: str = "_quality") -> DataFrame:
    """``docs`` with a struct column of counts for each text.

    Words are runs of characters other than space and tab to carriage return.  A
    null or blank text has no words and no lines.  ``n_repeat_words`` counts words
    in 3-word windows that occur at least twice, the first included;
    ``n_dup_lines`` counts lines with a word that equal an earlier one.  Repeated rows
    are measured alike; all columns of ``docs`` are kept as they are, whatever their names.
    """
    columns = docs.columns
    w_, l_, h_, s_, f_, a_ = fresh(columns, "words", "lines", "hashes", "sorted", "found", "at")
    value = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(value, F.lit(" \t\n\x0b\f\r"))
    step = docs.withColumns(
        {
            w_: F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, SPACES)),
            l_: F.filter(F.split(value, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    step = step.withColumn(h_, F.transform(w_, lambda w: F.xxhash64(w)))
    keep = F.lit(-(1 << 24))  # all but the low 24 bits, which take the position
    hashes = F.col(h_)
    windows = F.transform(
        F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0))),
        lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)).bitwiseAND(keep).bitwiseOR(i.cast("long")),
    )
    step = step.withColumn(s_, F.sort_array(windows))
    step = step.withColumn(f_, _repeat_words(F.col(w_), hashes, F.col(s_)))
    found = F.col(f_)
    equal = lambda x, y: F.coalesce((x.a == y.a) & (x.b == y.b) & (x.c == y.c), F.lit(False))
    step = step.withColumn(
        a_,
        F.sort_array(
            F.transform(
                F.filter(found, lambda x, i: equal(x, F.get(found, i - 1)) | equal(x, F.get(found, i + 1))), lambda x: x.p
            )
        ),
    )
    at = F.col(a_)
    covered = F.aggregate(
        F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda total, n: total + n,
    )
    lost = lambda pattern: F.length(value) - F.length(F.regexp_replace(value, pattern, ""))
    counts = F.struct(
        F.size(w_).cast("long").alias("n_words"),
        F.length(F.array_join(w_, "")).cast("long").alias("word_chars"),
        lost(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size(l_) - F.size(F.array_distinct(l_))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(l_).cast("long").alias("n_lines"),
        lost(r"[^\p{L}\p{N}\x20\x09-\x0D]+").cast("long").alias("n_marks"),
        lost(r"\p{Lu}+").cast("long").alias("n_capitals"),
    )
    return step.select(*columns, counts.alias(into))


def _measures(q: str) -> dict[str, Column]:
    words = F.greatest(F.col(f"{q}.n_words"), F.lit(1))
    chars = F.greatest(F.col(f"{q}.word_chars"), F.lit(1))
    lines = F.greatest(F.col(f"{q}.n_lines"), F.lit(1))
    per = lambda count, of: F.floor(F.lit(1000) * F.col(f"{q}.{count}") / of).cast("long")
    return {
        "symbols": per("n_symbols", words),
        "dup_lines": per("n_dup_lines", lines),
        "repeats": per("n_repeat_words", words),
        "word_length": per("word_chars", words),
        "marks": per("n_marks", chars),
        "capitals": per("n_capitals", chars),
    }


def bin_of(value: Column) -> Column:
    """Lower end of the value's bin: seven significant bits are kept."""
    drop = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    step = F.pow(F.lit(2.0), drop).cast("long")
    return (F.floor(value / step) * step).cast("long")


def base_failed(q: str) -> Column:
    n, again = F.col(f"{q}.n_words"), F.col(f"{q}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n)


def sketches(measured: DataFrame, q: str = "_quality") -> DataFrame:
    """``(lang, source, rule, bin, n)`` of the rows that pass the base rules."""
    values = _measures(q)
    rows = measured.filter(~base_failed(q)).select(
        "lang",
        "source",
        F.explode(
            F.array(*(F.struct(F.lit(r.name).alias("rule"), bin_of(values[r.name]).alias("bin")) for r in RULES))
        ).alias("m"),
    )
    return rows.groupBy("lang", "source", "m.rule", "m.bin").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of merged sketches as a struct of fences for each group."""
    merged = sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "rule")
    ranked = merged.withColumns({"upto": F.sum("n").over(by.orderBy("bin")), "total": F.sum("n").over(by)})
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bin")))
    per_rule = ranked.groupBy(*keys, "rule").agg(
        quartile(1).alias("q1"), quartile(3).alias("q3"), F.first("total").alias("total")
    )
    wide = REACH * (F.col("q3") - F.col("q1"))
    pick = lambda rule, value: F.max(F.when(F.col("rule") == rule.name, value))
    limits = []
    for rule in RULES:
        limits.append(pick(rule, F.col("q3") + wide + rule.slack).alias(f"{rule.name}_most"))
        if rule.low:
            limits.append(pick(rule, F.col("q1") - wide - rule.slack).alias(f"{rule.name}_least"))
    return per_rule.groupBy(*keys).agg(F.max("total").alias("size"), F.struct(*limits).alias("fences"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """``(lang, source, fences)``, one row per group of the sketches."""
    fine = _fences(sketch, ["lang", "source"])
    middle = _fences(sketch, ["lang"]).select(
        F.col("lang").alias("_lang"), F.col("size").alias("_size"), F.col("fences").alias("_middle")
    )
    whole = _fences(sketch.withColumn("all", F.lit(1)), ["all"]).select(F.col("fences").alias("_whole"))
    # The corpus has one row of fences.
    joined = fine.join(middle, F.col("lang").eqNullSafe(F.col("_lang"))).join(F.broadcast(whole))
    chosen = (
        F.when(F.col("size") >= MIN_GROUP, F.col("fences"))
        .when(F.col("_size") >= MIN_GROUP, F.col("_middle"))
        .otherwise(F.col("_whole"))
    )
    return joined.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), chosen.alias("_fences"))


def judge(measured: DataFrame, q: str = "_quality") -> DataFrame:
    """Rows of ``measured`` with the struct ``q`` extended by the verdict.

    Adds ``base_failed``, ``broken`` (names of the rules that a row breaks) and
    ``kept``.  ``measured`` is read twice, so it should be a written table.  Null
    languages and sources form groups of their own.  A group where every row fails the
    base rules has no fences and needs none.
    """
    # One row for each language and source: written once, so its size is known and texts do not shuffle.
    lang, source, fences = fresh(measured.columns, "lang", "source", "fences")
    limits = materialize(thresholds(sketches(measured, q)), "thresholds").toDF(lang, source, fences)
    limits = broadcast_if_small(limits)
    columns = [c for c in measured.columns if c != q]
    both = F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source))
    values = _measures(q)
    broken = []
    for rule in RULES:
        bad = bin_of(values[rule.name]) > F.col(f"{fences}.{rule.name}_most")
        if rule.low:
            bad |= bin_of(values[rule.name]) < F.col(f"{fences}.{rule.name}_least")
        broken.append(F.when(bad, F.lit(rule.name)))
    failed = base_failed(q)
    names = F.array_compact(F.array(*broken))
    verdict = F.col(q).withField("base_failed", failed).withField("broken", names)
    verdict = verdict.withField("kept", ~failed & (F.size(names) == 0))
    return measured.join(limits, both, "left").select(*columns, verdict.alias(q))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the adaptive ones."""
    q = "_quality"
    while q in docs.columns:
        q += "_"
    judged = judge(materialize(measure(docs, into=q), "measured"), q)
    return judged.filter(F.col(f"{q}.kept")).select(*docs.columns)
