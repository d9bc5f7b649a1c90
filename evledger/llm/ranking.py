"""Dense ranks over any number of rows, without a window over a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evledger.session import broadcast_if_small, materialize

_POSITION = (1 << 33) - 1


def ranked(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` (0, 1, 2, ... inside ``key``) and ``total`` (rows of ``key``).

    ``rows`` is a written table without columns of these names, its ``key`` has no
    nulls.  Rows that tie in ``order`` are told apart by their place in the table,
    so that no number of equal rows has to meet in one task: the rows are sorted in
    ranges of (key, order), and a key's offset in each range comes from its counts.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(key), *order, F.col("_tie")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION))
    sorted_ = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    sorted_ = materialize(sorted_.withColumns({"_range": F.spark_partition_id(), "_place": place}), "ranges")
    runs = sorted_.groupBy(key, "_range").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        key, "_range", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(key)).alias("total"),
    )
    runs = materialize(runs, "runs")
    found = sorted_.join(broadcast_if_small(runs, 20_000), [key, "_range"])
    rank = F.col("_before") + F.col("_place") - F.col("_first")
    return found.select(*rows.columns, rank.alias("rank"), "total")
