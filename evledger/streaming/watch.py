"""Watching trees in a stream: each trigger takes a snapshot and diffs it with the newest one.

The snapshot of a trigger is saved under its batch number before its event is written, so
state is replaced first.  A batch that is repeated after a crash finds its snapshot saved and
gives the same event again under the same id.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from evledger import positions
from evledger.session import materialize
from evledger.sources import files as T

Snapshot = Callable[[], DataFrame]


class _Clock(DataSourceStreamReader):
    """One row a trigger: there is always a later moment to read up to."""

    def initialOffset(self) -> dict:
        return {"moment": 0}

    def latestOffset(self) -> dict:
        return {"moment": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(end["moment"])]

    def read(self, partition: InputPartition) -> Iterator[tuple[int]]:
        yield (partition.value,)


class Clock(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clock"

    def schema(self) -> str:
        return "moment bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Clock()


def watch_version(snapshot: Snapshot, state: str, version: int, spark: SparkSession, **options) -> DataFrame:
    """Events of one snapshot ``(root, path, size, mtime_ns)`` against the newest one before ``version``.

    The first snapshot is a baseline for each root; a root without a change has no event.
    """
    current = positions.save_at(materialize(snapshot(), "tree"), state, version)
    previous = positions.before(spark, state, version)
    number = F.lit(version)
    if previous is None:
        return T.watch_baseline(current, version=number, **options)
    # Roots that appear later get their baseline, the others their changes.
    known = previous.select("root").distinct()
    fresh = T.watch_baseline(current.join(known, "root", "left_anti"), version=number, **options)
    changes = T.snapshot_diff(previous, current.join(known, "root", "left_semi"), ("root", "path"))
    return T.change_batches(changes, version=number, **options).unionByName(fresh)


def watch_stream(
    spark: SparkSession,
    snapshot: Snapshot,
    state: str,
    out: str,
    checkpoint: str,
    *,
    once: bool = False,
    interval: str = "30 seconds",
    **options,
) -> StreamingQuery:
    """Events of a tree, a snapshot a trigger, appended below ``out`` by batch."""
    spark.dataSource.register(Clock)

    def tick(rows: DataFrame, batch: int) -> None:
        events = watch_version(snapshot, state, batch + 1, spark, **options)
        events.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer = spark.readStream.format("clock").load().writeStream.option("checkpointLocation", checkpoint).foreachBatch(tick)
    writer = writer.queryName(f"watch-{zlib.crc32(out.encode()):08x}")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
