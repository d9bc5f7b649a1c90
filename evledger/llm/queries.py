"""The registered queries of this subpackage: thin calls of its operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evledger.llm import (
    decontaminate,
    html_text,
    language,
    merkle,
    mixing,
    ngram_lm,
    oracle_sql,
    quality,
    quality_sql,
    resampling,
    simhash,
    token_counts,
    token_store,
    toxicity,
    url_filter,
)
from evledger.llm.common import crc_fold, table
from evledger.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(found["fp"]).alias("fingerprint"), "component_id")


@query("op9_token_store")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from a written store."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_store.store_digest(table(spark, sf_dir, "documents"), path)


@query("op8_quality_rules", quality_sql.oracle())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = materialize(quality.measure(docs).drop("text"), "measured")
    judged = quality.judge(measured).withColumnRenamed("_quality", "q")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *(f"q.{name}" for name in names))


@query("op6_cube_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    rows = materialize(mixing.sized(table(spark, sf_dir, "documents")), "sized")
    mixed = mixing.mix(rows)
    taken = (mixed["copies"] * mixed["size"]).cast("long").alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "source", "copies")


@query(
    "op3_decontamination",
    """
    WITH d AS (
        SELECT doc_id, row_number() OVER () AS r,
               regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents
    ), i AS (
        SELECT min(item_id) AS item_id, w
        FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark)
        WHERE len(w) > 0 GROUP BY w
    ), s AS (
        SELECT DISTINCT item_id, least(5, len(w)) AS k,
               unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2),
                                     lambda j: array_to_string(w[j:j + least(5, len(w)) - 1], ' '))) AS g
        FROM i
    ), q AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
    widths AS (SELECT DISTINCT k FROM s),
    t AS (
        SELECT DISTINCT r, doc_id,
               unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g
        FROM d, widths WHERE len(w) >= k
    ), m AS (
        SELECT r, doc_id, s.item_id, count(*) AS n FROM t JOIN s USING (g) GROUP BY r, doc_id, s.item_id
    )
    SELECT m.doc_id, m.item_id, m.n AS n_shared, q.n AS n_shingles, m.n / q.n AS containment
    FROM m JOIN q USING (item_id) WHERE 10 * m.n >= 8 * q.n
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from three quarters of the labels."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    found = toxicity.rate(docs, model)
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


@query("op2_html_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


#: Rules of the query: verdict and pattern.
URL_RULES = [
    url_filter.Rule("block", "net/"),
    url_filter.Rule("allow", "example.net/en/"),
    url_filter.Rule("block", "example.com/de/"),
    url_filter.Rule("allow", "org/fr/"),
]


@query("op5_url_filter")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    found = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after private data are scrubbed."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    edited = token_counts.edit_documents(table(spark, sf_dir, "documents"), path, token_counts.scrub)
    return edited.select("doc_id", "n_before", "n_edits", "n_tokens", "reencoded")


@query("op11_merkle_manifest", oracle_sql.merkle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document proved against the manifest, half of them after tampering."""
    return merkle.audit(table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 2) == 0)


@query("op12_importance_resampling", oracle_sql.resampling())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document for the benchmark's distribution, and the draw by it."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_ngram_lm")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document, learned from six sevenths of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 7) == 2
    found = ngram_lm.score(docs, ngram_lm.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), *(c for c in found.columns if c != "doc_id"))
