import os
import random

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from evledger import positions
from evledger.operators import chain as H
from evledger.operators import health as K
from evledger.operators.policy import CapturePolicy
from evledger.sources import files as T
from evledger.streaming import live as V
from evledger.streaming import watch as W
from tests.test_chain import as_dict, events, folded


def test_batches_and_replay_give_one_ledger(spark, tmp_path):
    df = events(spark, 120).cache()
    want = folded(df.collect())
    ledger = str(tmp_path / "ledger")
    for number, (low, high) in enumerate([(0, 50), (50, 90), (90, 120)]):
        V.append_batch(df.where((F.col("seq") >= low) & (F.col("seq") < high)), number, ledger)
    assert as_dict(V.read_ledger(spark, ledger)) == want
    V.append_batch(df.where("seq >= 90"), 2, ledger)  # the same batch again
    assert as_dict(V.read_ledger(spark, ledger)) == want


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    df = events(spark, 90)
    source, ledger, checkpoint = (str(tmp_path / n) for n in ("src", "ledger", "cp"))
    for low in (0, 45):
        df.where((F.col("seq") >= low) & (F.col("seq") < low + 45)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        V.single_pass(V.append_stream(stream, ledger, checkpoint, policy=CapturePolicy(redaction_enabled=False), once=True))
    chained = V.read_ledger(spark, ledger)
    assert chained.count() == 90
    assert H.chain_links(chained, width=10).where("not link_ok").count() == 0
    metrics = spark.read.parquet(f"{ledger}/metrics")
    assert metrics.agg(F.sum("events")).first()[0] == 90


def test_heads_of_many_batches_read_a_few_folders(spark, tmp_path):
    """The newest row of each key, whatever the number of batches; a repeated batch changes nothing."""
    path = str(tmp_path / "heads")
    want = {}
    for batch in range(40):
        rows = [(f"k{(batch * 7 + j) % 11}", batch * 10 + j) for j in range(3)]
        want |= dict(rows)
        for _ in range(2 if batch in (15, 16, 31) else 1):
            positions.put(spark.createDataFrame(rows, "ledger_id string, last bigint").coalesce(1), path, batch, "ledger_id")
        assert len(positions.sources(spark, path, batch + 1)) <= positions.EVERY + 1
        if batch in (0, 14, 15, 16, 30, 31, 39):
            got = {r.ledger_id: r.last for r in positions.newest(spark, path, batch + 1, "ledger_id").collect()}
            assert got == want
    assert len(os.listdir(path)) <= 2 * positions.EVERY + 2
    assert positions.newest(spark, path, 0, "ledger_id") is None
    before = {r.ledger_id: r.last for r in positions.newest(spark, path, 39, "ledger_id").collect()}
    assert before != want and set(before) == set(want)


def clip_rows(seed, n):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", "c"]
    return [(rng.choice(keys), k, rng.choice(["x", "y", "x", " ", "z"])) for k in range(n)]


def test_clip_changes_equal_on_any_batching(spark, tmp_path):
    """A key with most rows in small segments; batches, restarts and a repeated batch."""
    schema = "clip_key string, pos long, text string"
    rows = clip_rows(4, 120)
    last, want = {}, []
    for key, pos, text in rows:
        if text.strip():
            if key in last and last[key] != text:
                want.append((key, pos, text))
            last[key] = text
    for cuts in ([0, 120], [0, 1, 5, 60, 61, 120]):
        out = str(tmp_path / f"out{len(cuts)}")
        for n, (low, high) in enumerate(zip(cuts, cuts[1:])):
            df = spark.createDataFrame(rows[low:high], schema)
            for _ in range(2 if n == 1 else 1):
                V.clip_change_batch(df, n, out, width=7)
        got = [(r.clip_key, r.pos, r.raw_text) for r in V.read_clip_changes(spark, out).collect()]
        assert sorted(got) == sorted(want)


def test_clip_state_survives_restart(spark, tmp_path):
    schema = "clip_key string, pos long, text string"
    source, out, checkpoint = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for rows in ([("k", 1, "a"), ("k", 2, "b")], [("k", 3, "b"), ("k", 4, "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        clips = spark.readStream.schema(schema).parquet(source)
        V.single_pass(V.clip_change_stream(clips, out, checkpoint, once=True))
    got = V.read_clip_changes(spark, out).orderBy("pos").collect()
    assert [(r.pos, r.raw_text) for r in got] == [(2, "b"), (4, "c")]


def test_observed_metrics_and_failures(spark, tmp_path):
    """A row a batch, each event counted once; a query that fails leaves an error row."""
    df = events(spark, 60)
    source, ledger, checkpoint, path = (str(tmp_path / n) for n in ("src", "ledger", "cp", "metrics"))
    listener = V.attach_metrics(spark, path, {"notes"})
    policy = CapturePolicy(redaction_enabled=False)

    def run(once_more):
        stream = spark.readStream.schema(df.schema).parquet(source)
        query = V.append_stream(stream if once_more else stream.withColumn("seq", F.raise_error(F.lit("lost")).cast("long")),
                                ledger, checkpoint, policy=policy, once=True, name="notes")
        try:
            query.awaitTermination()
        except StreamingQueryException:
            assert not once_more
        listener.wait(query)

    try:
        for low, sound in ((0, True), (30, False)):
            df.where((F.col("seq") >= low) & (F.col("seq") < low + 30)).coalesce(1).write.mode("append").parquet(source)
            run(sound)
        run(True)
    finally:
        spark.streams.removeListener(listener)
    rows = V.read_metrics(spark, path)
    total = K.source_metrics(rows).first()
    assert total["name"] == "notes" and total.events == 60 and total.skipped == 0 and total.tracked_files == 0
    assert (total.runs, total.errors) == (3, 1) and "Exception" in total.last_error
    assert V.read_ledger(spark, ledger).count() == 60


def test_watch_stream_restarts_and_repeats(spark, tmp_path):
    """A trigger a start; a batch that is repeated gives its event again, from the saved snapshot."""
    root, state, out, checkpoint = (str(tmp_path / n) for n in ("root", "state", "out", "cp"))
    os.makedirs(root)
    snapshot = lambda: T.tree_snapshot(spark, root, ["none"]).withColumn("root", F.lit("r"))

    def run():
        W.watch_stream(spark, snapshot, state, out, checkpoint, once=True, ts="2024-01-01T00:00:00Z").awaitTermination()
        return [(r.batch, r.event_id, r.summary) for r in spark.read.parquet(out).orderBy("batch").collect()]

    for name in ("a", "b"):
        with open(f"{root}/{name}", "w") as f:
            f.write(name)
    assert [s for *_, s in run()] == ["Watch baseline for 2 files"]
    os.remove(f"{root}/a")
    first = run()
    assert [s for *_, s in first] == ["Watch baseline for 2 files", "File change batch: 1 paths"]
    for name in ("1", ".1.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    with open(f"{root}/late", "w") as f:
        f.write("late")
    again = run()  # batch 1 again, then batch 2
    assert again[:2] == first and again[2:] in ([], [(2, again[-1][1], "File change batch: 1 paths")])
    assert len(run()) >= 3 or run()[-1][2] == "File change batch: 1 paths"


def test_order_statistics_with_a_hot_value(spark):
    df = spark.range(1001).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    values = sorted(r.v for r in df.collect())
    row = K.latency_report(df, "v", ("g",)).first()
    assert (row.p50, row.p95, row.max) == (values[500], values[950], values[-1])
