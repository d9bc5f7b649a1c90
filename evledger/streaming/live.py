"""Structured Streaming forms: append, clip changes, cursor reads, metrics."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from evledger import positions
from evledger import schema as S
from evledger.functions import text as X
from evledger.operators.chain import chain_build, chain_heads
from evledger.operators.policy import CapturePolicy, apply_policy, redaction_totals
from evledger.operators.index import IndexedLedger, ledger_sizes
from evledger.operators.read import Lines, next_cursors, read_batches, zero_cursors
from evledger.operators.segments import SEGMENT_ROWS, lag_value
from evledger.session import broadcast_if_small, materialize
from evledger.sources.capture import clip_events

Policy = Callable[[DataFrame], DataFrame]


def text_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Lines of immutable segment files as they arrive.

    The file source takes each file once; `sources.growing.line_stream` is for
    files that grow in place.
    """
    return (
        spark.readStream.option("lineSep", "\n")
        .option("maxFilesPerTrigger", max_files)
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )


def ledger_heads(spark: SparkSession, ledger: str, before_batch: int) -> DataFrame | None:
    """(ledger_id, last_hash, last_seq) of all batches before this one."""
    return positions.newest(spark, f"{ledger}/heads", before_batch, "ledger_id")


def append_batch(
    events: DataFrame,
    batch: int,
    ledger: str,
    *,
    policy: CapturePolicy | None = None,
    order: str = "seq",
    round_rows: int | None = None,
    namespace: str = S.NAMESPACE,
) -> None:
    """Policy, then chained append of one batch.

    Output folders are named by the batch and overwritten on replay, and heads
    of later batches are ignored, so a repeated batch gives the same ledger.
    ``events`` may carry the policy's decision already (`decided`).
    """
    spark = events.sparkSession
    if policy is not None:
        events = apply_policy(events, policy, namespace)
    if "accepted" in events.columns:
        # Decided once: the totals, the chain's widths and the fold all read this.
        events = materialize(events, "decided")
        redaction_totals(events).write.mode("overwrite").parquet(f"{ledger}/metrics/batch={batch}")
        events = events.where("accepted").drop("accepted", "reason", "redaction_count")
    options = {"round_rows": round_rows} if round_rows else {}
    heads = ledger_heads(spark, ledger, batch)
    if heads is not None:
        heads = heads.join(events.select("ledger_id").distinct(), "ledger_id", "left_semi")
    chained = chain_build(events, order, heads, **options)
    chained.write.mode("overwrite").parquet(f"{ledger}/events/batch={batch}")
    stored = spark.read.parquet(f"{ledger}/events/batch={batch}")
    positions.put(chain_heads(stored, order), f"{ledger}/heads", batch, "ledger_id")


def append_stream(
    events: DataFrame,
    ledger: str,
    checkpoint: str,
    *,
    policy: CapturePolicy | None = None,
    order: str = "seq",
    once: bool = False,
    name: str | None = None,
    namespace: str = S.NAMESPACE,
) -> StreamingQuery:
    """Continuous chained append; ``once`` makes one pass over all sources.

    Rows of a batch arrive in any order and are sorted by ``order`` before the
    fold.  ``events`` needs ledger_id, the order column and the envelope.  With a
    policy its counts are observed in the stream itself (`attach_metrics` keeps
    them), under ``name``, the name of the query.
    """
    if policy is not None:
        events = observed(apply_policy(events, policy, namespace))
    writer = (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(
            # One write reads the stream's plan once, so what is observed counts each row once.
            lambda df, number: append_batch(materialize(df, "batch"), number, ledger, order=order, namespace=namespace)
        )
        .queryName(name or f"append-{zlib.crc32(ledger.encode()):08x}")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def single_pass(*queries: StreamingQuery) -> None:
    """Wait until every source's one pass is done."""
    for query in queries:
        query.awaitTermination()


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.parquet(f"{ledger}/events").drop("batch")


# -- clips -------------------------------------------------------------------

def clip_change_batch(clips: DataFrame, batch: int, out: str, width: int = SEGMENT_ROWS, **options) -> None:
    """Clip changes of one batch of ``(clip_key, pos, text)``, against the last digest of each key.

    A key's rows are cut into segments by ``pos``, so no key is held in one task; the first row
    of a key in a batch meets the digest that earlier batches left.  A key's very first text
    is its baseline.  A repeated batch replaces its output.
    """
    spark = clips.sparkSession
    real = clips.where(~X.is_blank(F.col("text"))).withColumn("digest", F.sha2("text", 256))
    real = materialize(real, "clips")
    known = positions.newest(spark, f"{out}/digests", batch, "clip_key")
    rows = lag_value(real, ["clip_key"], "pos", F.col("digest"), "_before", width)
    before = F.col("_before")
    if known is not None:
        ends = materialize(known.join(real.select("clip_key").distinct(), "clip_key", "left_semi"), "digests")
        rows = rows.join(broadcast_if_small(ends), "clip_key", "left")
        before = F.coalesce(before, F.col("last"))
    changed = rows.where(before.isNotNull() & (F.col("digest") != before)).select("clip_key", "pos", "text")
    clip_events(changed, **options).write.mode("overwrite").parquet(f"{out}/events/batch={batch}")
    last = real.groupBy("clip_key").agg(F.max_by("digest", "pos").alias("last"))
    positions.put(last, f"{out}/digests", batch, "clip_key")


def clip_change_stream(clips: DataFrame, out: str, checkpoint: str, *, once: bool = False, **options) -> StreamingQuery:
    """Stateful clip changes of a stream ``(clip_key, pos, text)``, appended below ``out``.

    A batch's positions come after those of earlier batches, as a clipboard gives them.
    """
    writer = (
        clips.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, number: clip_change_batch(df, number, out, **options))
        .queryName(f"clips-{zlib.crc32(out.encode()):08x}")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_clip_changes(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/events").drop("batch")


# -- consumers ---------------------------------------------------------------


def save_cursors(envelopes: DataFrame, path: str, before: DataFrame | None = None) -> DataFrame:
    """Persist the positions of sound batches; others keep their old cursor.

    Positions are written as a new version beside the old one, so a crash at any
    moment leaves one that is complete.
    """
    rows = next_cursors(envelopes)
    if before is not None:
        rows = rows.unionByName(before.join(rows, "ledger_id", "left_anti"))
    return positions.save(rows, path)


def cursor_stream(
    lines: Lines,
    cursor_path: str,
    consume: Callable[[DataFrame, int], None],
    *,
    max_rounds: int | None = None,
    **options,
) -> DataFrame:
    """Resume the consumers of all ledgers until they have caught up.

    Identity and boundary of each ledger are checked before every batch.  A
    changed, truncated or invalid ledger is reported in the returned envelopes
    and its position is left alone: it is never rewound here.  Sizes are taken once; each round
    reads the ranges of its batches only.
    """
    spark = lines.spark if isinstance(lines, IndexedLedger) else lines.sparkSession
    sizes = materialize(ledger_sizes(lines), "sizes")
    saved, _ = positions.load(spark, cursor_path)
    fresh = zero_cursors(lines)
    cursors = fresh if saved is None else saved.unionByName(fresh.join(saved, "ledger_id", "left_anti"))
    number, reports = 0, None
    while True:
        events, envelopes, _ = read_batches(lines, cursors, sizes=sizes, **options)
        envelopes = materialize(envelopes, "envelopes")
        sound = envelopes.where((F.col("cursor_status") == "ok") & (F.col("chain_status") != "failed"))
        consume(events.join(sound.select("ledger_id"), "ledger_id", "left_semi"), number)
        saved = save_cursors(envelopes, cursor_path, saved)
        number += 1
        more = sound.where(F.col("truncated") & (F.col("bytes_read") > 0)).select("ledger_id")
        done = envelopes.join(more, "ledger_id", "left_anti")
        reports = done if reports is None else reports.unionByName(done)
        if more.isEmpty():
            return reports
        if max_rounds and number >= max_rounds:
            # Those with more to read are reported as they stand: truncated.
            return reports.unionByName(envelopes.join(more, "ledger_id", "left_semi"))
        cursors = saved.join(more, "ledger_id", "left_semi")


# -- metrics -----------------------------------------------------------------

_OBSERVED = "capture"
_POLLS = (
    "name string, run bigint, events bigint, skipped bigint, redactions bigint,"
    " tracked_files bigint, available_files bigint, error string, ts string"
)


def observed(decided: DataFrame) -> DataFrame:
    """``decided`` with its counts reported in the progress of the query that reads it."""
    return decided.observe(
        _OBSERVED,
        F.count_if("accepted").alias("events"),
        F.count_if(~F.col("accepted")).alias("skipped"),
        F.sum(F.when(F.col("accepted"), F.col("redaction_count"))).alias("redactions"),
    )


class SourceMetrics(StreamingQueryListener):
    """Writes a row a batch for each named query, as `health.source_metrics` reads them.

    A row is named by source and batch and replaces itself, so a repeated batch counts once; an
    error is named by the run that it ended.  ``run`` orders them by time.
    ``files`` gives (tracked, available) of a source, where it has files.
    """

    def __init__(self, spark: SparkSession, path: str, names: set[str], files: Callable[[str], tuple[int, int]] | None = None):
        self.spark, self.path, self.names = spark, path, names
        self.files = files or (lambda name: (0, 0))
        self.started: dict[str, str] = {}
        self.ended: set[str] = set()

    def _write(self, name: str, key: str, *values) -> None:
        row = (name, time.time_ns() // 1000, *values)
        rows = self.spark.createDataFrame([row], _POLLS).drop("name").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/name={name}/key={key}")

    def onQueryStarted(self, event) -> None:
        if event.name in self.names:
            self.started[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        counts = p.observedMetrics.get(_OBSERVED) if p.name in self.names else None
        if counts is None or p.numInputRows == 0:
            return
        values = (counts["events"], counts["skipped"], counts["redactions"] or 0)
        self._write(p.name, f"batch-{p.batchId}", *values, *self.files(p.name), None, p.timestamp)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.started.pop(str(event.runId), None)
        if name is not None and event.exception:
            self._write(name, f"error-{event.runId}", 0, 0, 0, *self.files(name), event.exception.splitlines()[0], None)
        self.ended.add(str(event.runId))

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Progress is reported beside the query; wait until all of an ended one has come."""
        until = time.monotonic() + seconds
        while str(query.runId) not in self.ended and time.monotonic() < until:
            time.sleep(0.05)


def attach_metrics(spark: SparkSession, path: str, names: set[str], files=None) -> SourceMetrics:
    listener = SourceMetrics(spark, path, names, files)
    spark.streams.addListener(listener)
    return listener


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row per source and batch: what `health.source_metrics` takes."""
    return spark.read.schema(_POLLS).parquet(path)
