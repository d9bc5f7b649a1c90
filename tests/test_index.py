"""Range reads: what is opened, what is pushed down, and equal results with and without an index."""

import re

import pytest
from pyspark.sql import functions as F

from evledger.operators import index as X
from evledger.operators import read as R
from evledger.sources import lines as L
from evledger.streaming import live
from tests.reference_fold import chain, dump
from tests.test_read import outcome, write_all


@pytest.fixture
def stored(spark, tmp_path):
    """Two ledgers as a table of several files each, in offset order."""
    texts = {"one": b"".join(map(dump, chain(60))), "two": b"".join(map(dump, chain(20))) + b"\n" * 30}
    lines = L.ledger_lines(spark, write_all(tmp_path / "in", texts))
    path = str(tmp_path / "table")
    placed = lines.drop("path").repartitionByRange(6, "ledger_id", "byte_offset").sortWithinPartitions("ledger_id", "byte_offset")
    placed.write.parquet(path)
    return path, X.index_ledger(spark, path, str(tmp_path / "index")), {k: len(v) for k, v in texts.items()}


def test_index_follows_the_table(spark, stored, tmp_path):
    path, ledger, sizes = stored
    assert {r.ledger_id: r.ledger_size for r in ledger.sizes().collect()} == sizes
    known = ledger.index.count()
    more = spark.read.parquet(path).where("ledger_id = 'two'").withColumn("ledger_id", F.lit("three")).coalesce(1)
    more.write.mode("append").parquet(path)
    again = X.index_ledger(spark, path, str(tmp_path / "index"))
    assert again.index.count() == known + 1 and {r.ledger_id for r in again.sizes().collect()} == {"one", "two", "three"}
    assert X.index_ledger(spark, path, str(tmp_path / "index")).index.count() == known + 1


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_ranges_reach_the_scan(spark, stored, whole_plans):
    path, ledger, sizes = stored
    start = sizes["one"] // 2
    ranges = spark.createDataFrame([("one", start, start + 900)], "ledger_id string, lo long, hi long")
    for rows in (ledger.within(ranges), X.in_ranges(spark.read.parquet(path), ranges)):
        pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan_of(rows))[1]
        assert f"GreaterThanOrEqual(byte_offset,{start})" in pushed and f"LessThan(byte_offset,{start + 900})" in pushed
        got = {(r.ledger_id, r.byte_offset) for r in rows.collect()}
        whole = spark.read.parquet(path).where(f"ledger_id = 'one' AND byte_offset >= {start} AND byte_offset < {start + 900}")
        assert got == {(r.ledger_id, r.byte_offset) for r in whole.collect()} and got
    assert 1 <= len(ledger.files(ranges)) < len(spark.read.parquet(path).inputFiles())
    assert ledger.within(ranges.limit(0)).count() == 0


def test_many_ranges_are_joined(spark, stored, monkeypatch):
    path, ledger, sizes = stored
    rows = [("one", k * 100, k * 100 + 50) for k in range(20)] + [("two", 0, 10)]
    ranges = spark.createDataFrame(rows, "ledger_id string, lo long, hi long")
    key = lambda df: sorted((r.ledger_id, r.byte_offset) for r in df.collect())
    literal = key(ledger.within(ranges))
    monkeypatch.setattr(X, "LITERAL_RANGES", 3)
    assert key(ledger.within(ranges)) == literal == key(X.in_ranges(spark.read.parquet(path), ranges))
    monkeypatch.setattr(X, "NAMED_FILES", 0)
    assert key(ledger.within(ranges)) == literal


@pytest.mark.parametrize("window", [1 << 20, 8])
def test_reads_equal_with_and_without_index(spark, stored, monkeypatch, window):
    """Cursors at the start, inside, behind blank lines and beyond the end."""
    monkeypatch.setattr(R, "_WINDOW", window)
    path, ledger, sizes = stored
    lines = spark.read.parquet(path)
    first = R.read_incremental(lines, "one", limit=17)
    blank = R.read_incremental(lines, "two", max_bytes=sizes["two"] - 7)
    assert blank.next_cursor.byte_offset == sizes["two"] - 7 and blank.cursor_status == "ok"
    cursors = [None, first.next_cursor, R.Cursor("one", 10**9, "x", "y"), R.Cursor("one", 40, "x", "y")]
    for ledger_id, cursor in [*(("one", c) for c in cursors), ("two", None), ("two", blank.next_cursor)]:
        got = [R.read_incremental(t, ledger_id, after_cursor=cursor, limit=9, sources=["a", "b"]) for t in (lines, ledger)]
        plain = [(b.next_cursor, b.chain_status, b.cursor_status, b.truncated, b.bytes_read, b.ledger_size, b.warnings) for b in got]
        assert plain[0] == plain[1]
        assert [r.event_id for r in got[0].events.orderBy("byte_offset").collect()] == [r.event_id for r in got[1].events.orderBy("byte_offset").collect()]


def test_batches_of_many_ledgers(spark, stored):
    path, ledger, _ = stored
    lines = spark.read.parquet(path)
    for options in ({}, {"limit": 3}, {"max_bytes": 2000}):
        a, b = (R.read_batches(t, R.zero_cursors(t), **options) for t in (lines, ledger))
        assert outcome(a[0], a[1]) == outcome(b[0], b[1])


def test_consumers_open_each_range_once(spark, stored, tmp_path, monkeypatch):
    """Rounds read their own ranges: together they make up the ledger."""
    path, ledger, sizes = stored
    asked = []
    real = X.IndexedLedger.within

    def within(self, ranges):
        if "cursor_hash" in ranges.columns:
            asked.extend((r.ledger_id, r.lo, r.hi) for r in ranges.collect())
        return real(self, ranges)

    monkeypatch.setattr(X.IndexedLedger, "within", within)
    seen = []
    report = live.cursor_stream(ledger, str(tmp_path / "c"), lambda e, n: seen.extend(r.event_id for r in e.collect()), max_bytes=9000)
    assert {r.ledger_id for r in report.collect()} == {"one", "two"} and len(seen) == len(set(seen)) + 20 == 80
    starts = sorted(lo for name, lo, hi in asked if name == "one")
    assert len(starts) == len(set(starts)) and starts[0] == 0 and len(starts) >= sizes["one"] // 9000
