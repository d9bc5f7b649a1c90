"""Ordered operators that never put one whole key into one task.

A ledger, file or conversation may hold a large share of all rows, so a plain
``Window.partitionBy(key)`` would sort that share in a single task.  Here each
key is cut into segments of bounded width by its order column.  Rows are
windowed inside a segment, one edge row per segment is scanned per key, and
the edge value is joined back on (key, segment).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evledger.session import broadcast_if_small, materialize

SEGMENT_ROWS = 250_000
SEGMENT_BYTES = 128 * 1024 * 1024


def with_segment(df: DataFrame, order: str, width: int, name: str = "_segment") -> DataFrame:
    return df.withColumn(name, F.floor(F.col(order) / F.lit(width)).cast("long"))


def _attach_edges(df: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    # Both sides are keyed by (key, segment): the body is already partitioned
    # that way by its window, and AQE broadcasts the edges when they are small.
    return df.join(edges, [*keys, "_segment"], "left")


def lag_value(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, width: int = SEGMENT_ROWS
) -> DataFrame:
    """``lag(value)`` per key in ``order``, segment by segment.

    Also adds ``<out>_first``: true on the very first row of the key.
    """
    df = with_segment(df, order, width)
    local = W.partitionBy(*keys, "_segment").orderBy(order)
    body = df.withColumn("_lag", F.lag(F.struct(value.alias("v"))).over(local))
    edges = df.groupBy(*keys, "_segment").agg(
        F.max_by(F.struct(value.alias("v")), F.col(order)).alias("_last")
    )
    across = W.partitionBy(*keys).orderBy("_segment")
    edges = edges.withColumn("_edge", F.lag("_last").over(across)).drop("_last")
    prev = F.coalesce(F.col("_lag"), F.col("_edge"))
    return (
        _attach_edges(body, edges, keys)
        .withColumn(out, prev["v"])
        .withColumn(f"{out}_first", prev.isNull())
        .drop("_lag", "_edge", "_segment")
    )


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, width: int = SEGMENT_ROWS
) -> DataFrame:
    """Latest non-null ``value`` at or before each row of its key."""
    df = with_segment(df, order, width).withColumn("_value", value)
    local = (
        W.partitionBy(*keys, "_segment").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    body = df.withColumn("_local", F.last("_value", ignorenulls=True).over(local))
    edges = df.groupBy(*keys, "_segment").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last")
    )
    across = W.partitionBy(*keys).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    edges = edges.withColumn("_edge", F.last("_last", ignorenulls=True).over(across)).drop("_last")
    return (
        _attach_edges(body, edges, keys)
        .withColumn(out, F.coalesce("_local", "_edge"))
        .drop("_value", "_local", "_edge", "_segment")
    )


def last_before(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, width: int = SEGMENT_ROWS
) -> DataFrame:
    """Latest non-null ``value`` strictly before each row of its key; one shuffle of the rows."""
    df = with_segment(df, order, width).withColumn("_value", value)
    local = W.partitionBy(*keys, "_segment").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    body = df.withColumn("_local", F.last("_value", ignorenulls=True).over(local)).drop("_value")
    edges = df.where(F.col("_value").isNotNull()).groupBy(*keys, "_segment").agg(
        F.max_by("_value", F.col(order)).alias("_last")
    )
    # Segments without a value have a row too, or the value before them would not reach them.
    edges = df.select(*keys, "_segment").distinct().join(edges, [*keys, "_segment"], "left")
    across = W.partitionBy(*keys).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    edges = edges.withColumn("_edge", F.last("_last", ignorenulls=True).over(across)).drop("_last")
    return (
        _attach_edges(body, edges, keys)
        .withColumn(out, F.coalesce("_local", "_edge"))
        .drop("_local", "_edge", "_segment")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, width: int = SEGMENT_ROWS
) -> DataFrame:
    """Sum of ``value`` over the rows strictly before each row of its key."""
    df = with_segment(df, order, width).withColumn("_value", value.cast("long"))
    local = W.partitionBy(*keys, "_segment").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    body = df.withColumn("_local", F.coalesce(F.sum("_value").over(local), F.lit(0)))
    edges = df.groupBy(*keys, "_segment").agg(F.sum("_value").alias("_total"))
    across = W.partitionBy(*keys).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    edges = edges.withColumn("_edge", F.coalesce(F.sum("_total").over(across), F.lit(0))).drop("_total")
    return (
        _attach_edges(body, edges, keys)
        .withColumn(out, F.col("_local") + F.col("_edge"))
        .drop("_value", "_local", "_edge", "_segment")
    )


def first_positions(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First position and count of every repeated key.

    Partial aggregation collapses a hot key before the shuffle, so a key held
    by a third of all rows arrives as one row per map task.
    """
    return (
        df.groupBy(*keys)
        .agg(F.min(order).alias("_first_at"), F.count(F.lit(1)).alias("_copies"))
        .where(F.col("_copies") > 1)
        .drop("_copies")
    )


def later_copies(df: DataFrame, keys: Sequence[str], order: str, salts: int = 16) -> DataFrame:
    """Rows that repeat an earlier row's key; the first copy is not returned.

    Repeated keys are usually few: their table is written and counted, and a
    small one is broadcast, so the rows do not shuffle again.  A large one is
    replicated over ``salts``, which spreads the copies of one hot key.
    """
    firsts = materialize(first_positions(df, keys, order), "first-copies")
    small = broadcast_if_small(firsts)
    if small is not firsts:
        joined = df.join(small, list(keys))
    else:
        firsts = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
        # Spark takes the replicas for as small as their file and would send them through the driver.
        joined = rows.join(firsts.hint("merge"), [*keys, "_salt"]).drop("_salt")
    return joined.where(F.col(order) > F.col("_first_at")).drop("_first_at")
