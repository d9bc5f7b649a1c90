import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evledger.functions import canonical as C
from evledger.operators import chain as H
from evledger.operators import segments as G
from evledger.operators.envelope import build_event


def events(spark, n=400, hot=0.5):
    """Half of all rows in one ledger, the rest spread over five."""
    rows = spark.range(n).withColumn(
        "ledger_id",
        F.when(F.col("id") % 10 < hot * 10, "hot").otherwise(F.concat(F.lit("l"), (F.col("id") % 5).cast("string"))),
    )
    return build_event(
        rows.withColumn("seq", F.col("id")),
        source=F.lit("s"),
        event_type=F.lit("t"),
        event_id=F.concat(F.lit("e"), F.col("id").cast("string")),
        ts="2024-01-01T00:00:00Z",
        raw_text=F.concat(F.lit('q"\\\n\u0001é\U0001f600'), F.col("id").cast("string")),
        payload=F.lit('{"z": 1e16, "a": {"previous_hash": "x"}, "f": -0.0, "b": 1.0}'),
        tags=F.array(F.lit("k")),
        keep=("ledger_id", "seq"),
    )


def folded(rows):
    """Sequential chain of collected rows."""
    out, heads = {}, {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        body = {k: r[k] for k in r.asDict() if k not in ("ledger_id", "seq", "previous_hash")}
        body["payload"], body["artifacts"] = json.loads(body["payload"]), json.loads(body["artifacts"])
        body["privacy"] = body["privacy"].asDict()
        body["previous_hash"] = heads.get(r["ledger_id"])
        text = json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        heads[r["ledger_id"]] = hashlib.sha256(text.encode()).hexdigest()
        out[r["seq"]] = (body["previous_hash"], heads[r["ledger_id"]])
    return out


def as_dict(chained):
    return {r.seq: (r.previous_hash, r.content_hash) for r in chained.select("seq", "previous_hash", "content_hash").collect()}


@pytest.mark.parametrize("round_rows", [10_000, 17])
def test_chain_equals_sequential_fold(spark, round_rows):
    df = events(spark)
    want = folded(df.collect())
    assert as_dict(H.chain_build(df, round_rows=round_rows)) == want


def test_append_continues_heads(spark):
    df = events(spark)
    want = folded(df.collect())
    first = H.chain_build(df.where("seq < 150"))
    rest = H.chain_build(df.where("seq >= 150"), heads=H.chain_heads(first), round_rows=20)
    assert as_dict(first) | as_dict(rest) == want


def test_lines_hash_to_their_content_hash(spark):
    lines = H.chain_lines(H.chain_build(events(spark, 40)))
    rows = lines.select("value", "content_hash", C.content_hash(F.col("value")).alias("again")).collect()
    assert all(r.content_hash == r.again == json.loads(r.value)["content_hash"] for r in rows)


def test_links_find_every_break(spark):
    chained = H.chain_build(events(spark)).where("seq % 23 <> 4")
    got = {r.seq for r in H.chain_links(chained, width=7).where("not link_ok").collect()}
    want, previous = set(), {}
    for r in sorted(chained.collect(), key=lambda r: r.seq):
        if r.previous_hash != previous.get(r.ledger_id):
            want.add(r.seq)
        previous[r.ledger_id] = r.content_hash
    assert got == want and want


@pytest.mark.parametrize("width", [3, 1000])
def test_segment_operators_equal_plain_windows(spark, width):
    df = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 4).cast("string")).alias("k"),
        F.col("id").alias("o"),
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"),
    )
    rows = sorted(df.collect(), key=lambda r: r.o)
    seen, fill, total = {}, {}, {}
    want = {}
    for r in rows:
        want[r.o] = (seen.get(r.k), total.get(r.k, 0))
        seen[r.k] = r.v
        fill[r.k] = r.v if r.v is not None else fill.get(r.k)
        total[r.k] = total.get(r.k, 0) + (r.v or 0)
        want[r.o] += (fill[r.k],)
    lag = {r.o: r.x for r in G.lag_value(df, ["k"], "o", F.col("v"), "x", width).collect()}
    run = {r.o: r.x for r in G.running_sum(df, ["k"], "o", F.coalesce("v", F.lit(0)), "x", width).collect()}
    ffill = {r.o: r.x for r in G.forward_fill(df, ["k"], "o", F.col("v"), "x", width).collect()}
    assert {o: (lag[o], run[o], ffill[o]) for o in want} == want


def test_later_copies_of_a_hot_key(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 150).cast("string")).alias("k"), F.col("id").alias("o"))
    seen, want = set(), set()
    for r in sorted(df.collect(), key=lambda r: r.o):
        if r.k in seen:
            want.add(r.o)
        seen.add(r.k)
    assert {r.o for r in G.later_copies(df, ["k"], "o").collect()} == want


def test_later_copies_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(G, "broadcast_if_small", lambda t: t)
    test_later_copies_of_a_hot_key(spark)
