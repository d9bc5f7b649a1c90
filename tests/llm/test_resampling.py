"""Importance resampling against plain code and its SQL."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evledger.llm import resampling
from tests.llm.data import odd_documents, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, widths=2):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + n]) for n in range(1, widths + 1) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(g.encode()) for g in grams]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6), st.integers(1, 4))
def test_prefixes_give_every_crc(texts, widths):
    crcs, owner, words = resampling.ngram_crcs([t.encode() for t in texts], widths)
    for k, text in enumerate(texts):
        seen, wanted = plain_features(text, widths)
        assert words[k] == len(seen)
        assert sorted(crcs[owner == k].tolist()) == sorted(wanted)


def test_long_words():
    text = b"a" * 3_000_000 + b" b"
    crcs, _, _ = resampling.ngram_crcs([text])
    assert crcs.tolist() == [zlib.crc32(text[:-2]), zlib.crc32(b"b"), zlib.crc32(text)]


def plain_resample(rows, items):
    raw, wanted = Counter(), Counter()
    for _, text, *_ in rows:
        raw.update(c % 10000 for c in plain_features(text)[1])
    for _, text in items:
        wanted.update(c % 10000 for c in plain_features(text)[1])
    s, t = sum(raw.values()) + 10000, sum(wanted.values()) + 10000
    out = []
    for doc_id, text, *_ in rows:
        words, crcs = plain_features(text)
        gain = [math.floor(1000 * math.log((wanted[c % 10000] + 1) * s / ((raw[c % 10000] + 1) * t))) for c in crcs]
        weight = sum(gain) // len(gain) if gain else 0
        name = f"7:{'' if doc_id is None else doc_id}"
        u = (int(hashlib.sha256(name.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        out.append([doc_id, len(crcs), weight, weight + math.floor(-1000 * math.log(-math.log(u))), len(words) >= 20])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(fit[: 25 * len(fit) // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=repr)


def test_odd_rows(spark):
    """Nulls, ties, repeats and clashing names."""
    rows = odd_documents() + [(200 + k % 3, prose(50, 40), "aa", "s", 1) for k in range(30)]
    items = [(1, prose(2, 80)), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).repartition(4)
    target = spark.createDataFrame(items, "item_id long, text string")
    got = resampling.resample(docs, target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(rows, items)
    assert resampling.resample(docs.limit(0), target).count() == 0
    bare = resampling.resample(docs, target.limit(0)).collect()
    assert sorted((tuple(r) for r in bare), key=repr) == plain_resample(rows, [])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_importance_resampling"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    wanted = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, DATA)
    assert got.columns == wanted.columns
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(wanted.fetchall(), key=repr)
