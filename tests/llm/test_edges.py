"""Every operator on nulls, empty tables, ties, repeats, long texts and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evledger.llm import (
    decontaminate,
    html_text,
    language,
    mixing,
    quality,
    simhash,
    token_counts,
    token_store,
    tokens,
    toxicity,
    url_filter,
)
from evledger.session import materialize
from tests.llm.data import COLUMNS, TOKENIZER, odd_documents, prose, write_tables

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return materialize(spark.createDataFrame(odd_documents(), SCHEMA), "odd")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(spark, odd, none):
    model = language.train(odd)
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count()
    by_text = {r["doc_id"]: r for r in rows}
    assert by_text[1]["lang_pred"] == by_text[2]["lang_pred"] == by_text[3]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language.identify(none, model).count() == 0
    empty = language.identify(odd, language.train(none)).collect()
    assert {r["lang_pred"] for r in empty} == {"und"}


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (6, 1, 0), (None, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    every = F.lit(True)
    rows = toxicity.rate(odd, toxicity.train(odd, labels, every)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.rate(none, toxicity.train(none, labels.limit(0), every)).count() == 0


def test_toxicity_with_long_texts(spark):
    """Long texts, one above the bound, do not displace the short ones."""
    assert toxicity.packed([(1, 0, 900), (2, 1, 10), (3, 0, 80), (4, 0, 20), (5, 1, 10), (6, 0, 1)], 120) == [2, 5, 3, 4]
    texts = [(k, f"{'vile' if k % 4 == 0 else 'mild'} words {k}") for k in range(40)]
    texts += [(100 + k, "mild calm " * 200_000) for k in range(3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 40 and k % 4 == 0)) for k, _ in texts], "doc_id long, toxic int")
    assert toxicity.train(docs, labels, F.lit(True), size=1000).fitted


def test_html(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, ""), (None, "<p>a"), (4, "<p>b"), (4, "<p>b"), (5, "<div>" * 5000 + "x" * 200_000)],
        "page_id long, html string",
    ).withColumn("text", F.lit("clash"))
    rows = sorted(((r["page_id"] or 0, len(r["text"])) for r in html_text.extract(pages).collect()))
    assert rows == [(0, 1), (1, 0), (2, 0), (4, 1), (4, 1), (5, 200_000)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_urls(spark):
    rules = [url_filter.Rule("block", "net/"), url_filter.Rule("allow", "a.net/x/")]
    urls = [None, "", "no scheme", "http://A.NET/x/1?q#f", "http://b.net", "http://b.net/", "x://y.net/://z", "http://c.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    rows = {r["page_id"]: r for r in url_filter.judge(pages, rules).collect()}
    assert len(rows) == len(urls)
    assert [(rows[k]["host"], rows[k]["path"]) for k in range(8)] == [
        ("", ""), ("", ""), ("", ""), ("a.net", "/x/1"), ("b.net", ""), ("b.net", "/"), ("y.net", "/://z"), ("c.org", "/")
    ]
    assert [rows[k]["rule"] for k in range(8)] == [None, None, None, "a.net/x/", None, "net/", "net/", None]
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    many = rules + [url_filter.Rule("block", f"h{k}.org/") for k in range(100)]
    joined = {r["page_id"]: r["rule"] for r in url_filter.judge(pages, many).collect()}
    assert joined == {k: r["rule"] for k, r in rows.items()}


def test_decontaminate(spark, odd, none):
    items = spark.createDataFrame(
        [(7, "Uno dos, TRES cuatro cinco seis."), (8, "uno dos tres cuatro cinco seis"), (None, None), (9, "Zeta eta"), (10, "")],
        "item_id long, text string",
    )
    docs = spark.createDataFrame(
        [(1, "x uno dos tres cuatro cinco seis y"), (2, "zeta eta"), (None, "uno DOS tres -- cuatro cinco seis"), (3, None), (1, "none")],
        "doc_id long, text string",
    ).withColumn("item_id", F.lit("clash"))
    found = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.find(docs, items).collect())
    assert found == [(0, 7), (1, 7), (2, 9)]
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(1, "none"), (3, None)]
    assert decontaminate.find(odd, items.limit(0)).count() == 0
    assert decontaminate.find(none, items).count() == 0


def test_quality(spark, odd, none):
    judged = quality.judge(materialize(quality.measure(odd), "measured"))
    rows = {r["doc_id"]: r["_quality"] for r in judged.collect()}
    assert judged.count() == odd.count()
    assert rows[1]["n_words"] == rows[2]["n_words"] == 0 and rows[3]["n_words"] == 2 and not rows[1]["kept"]
    assert quality.judge(quality.measure(none)).count() == 0
    names = ["_quality", "_words", "_lines", "_hashes", "_sorted", "_found", "_at", "_lang", "_source", "_fences", "__at", "q", "n"]
    clash = odd.withColumns({n: F.lit(f"{n} stays") for n in names})
    kept = quality.keep_good(clash)
    assert kept.columns == clash.columns
    assert kept.count() == quality.keep_good(odd).count()
    for r in kept.collect():
        assert all(r[n] == f"{n} stays" for n in names)


def test_mixing(spark, odd, none):
    rows = materialize(mixing.sized(odd), "sized")
    mixed = mixing.mix(rows).collect()
    assert len(mixed) == odd.count()
    assert all(0 <= r["copies"] <= 3 for r in mixed)
    assert all(r["copies"] == 0 for r in mixed if not r["size"])
    assert mixing.mix(materialize(mixing.sized(none), "sized")).count() == 0
    clash = odd.withColumn("_row", F.lit(1)).withColumn("copies", F.lit("x"))
    assert mixing.remix(clash).columns == clash.columns


def test_simhash(spark, odd, none):
    classes = materialize(simhash.near_duplicates(odd), "classes")
    assert classes.count() == odd.count()
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd, classes)
    assert kept.columns == COLUMNS
    roots = classes.select("root").distinct().count()
    assert kept.count() == roots
    names = ["_fp", "root", "_id", "_of", "_root", "_nth", "_own", "n", "copies", "fp", "component_id", "__id"]
    clash = odd.withColumns({n: F.lit(f"{n} stays") for n in names})
    one = simhash.keep_one(clash, classes)
    assert one.columns == clash.columns
    assert sorted(map(str, (r["doc_id"] for r in one.collect()))) == sorted(map(str, (r["doc_id"] for r in kept.collect())))
    assert all(r[n] == f"{n} stays" for r in one.collect() for n in names)


def test_keep_one_with_a_repeated_id(spark):
    """Id 5 stands for its first text only; its second is a copy of document 3."""
    one, other = prose(21, 200), prose(22, 200)
    rows = [(3, one), (5, other), (5, one.upper()), (9, other)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string"), "repeated")
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, one), (5, other)]
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, one), (5, other)]


def test_token_store(spark, odd, none):
    rows = token_store.store_digest(odd, TOKENIZER).collect()
    assert len(rows) == odd.count()
    ends = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    assert token_store.store_digest(none, TOKENIZER).count() == 0


def test_token_counts(spark, odd, none):
    held = token_counts.states(odd, TOKENIZER)
    rows = token_counts.apply_edits(held, TOKENIZER, token_counts.scrub).collect()
    assert len(rows) == odd.count()
    assert token_counts.states(none, TOKENIZER).count() == 0


def test_pipeline_stages(spark, odd, none, tmp_path):
    write_tables(spark, tmp_path, odd)
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == COLUMNS
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_memory_of_the_encoder_is_bounded_by_bytes():
    """Long pieces are never remembered, and what is remembered stays within its bytes."""
    coder = tokens.Encoder(TOKENIZER, remember=200_000)
    plain = tokens.Encoder(TOKENIZER)
    long = ["x" * 100_000 + f"{k} yy" for k in range(5)]
    many = [" ".join(f"word{n}" for n in range(k, k + 3000)) for k in range(0, 12_000, 1500)]
    for texts in (long, many, many[::-1]):
        assert coder.encode(texts) == plain.encode(texts)
        assert all(len(p) <= tokens.LONGEST for p in coder.known) and coder.held <= 200_000
        assert len(coder.known) * tokens.ENTRY <= 200_000
