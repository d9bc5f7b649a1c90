"""Mixing sources to target weights by balanced (cube) sampling.

A source's target over its size is the factor by which its documents repeat.  The
whole part of the factor is taken for certain; the fraction is an inclusion
probability.  The cube method moves the probabilities of a few documents at a time
through the null space of the balancing constraints (number of documents and
number of words), until each is 0 or 1, so both totals keep their expected value.

The flight runs in blocks of bounded size, dealt by a hash of the document and
never by source alone.  A block ends with at most as many undecided documents as
there are constraints; these meet in blocks again, round by round, until one block
a source is left.  Its landing tries all outcomes of the last 16 documents at most.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evledger.llm.common import word_count
from evledger.session import broadcast_if_small, materialize, ship_package

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 4_000
EPS = 1e-9
#: Documents that wait for the landing, beside the two that the flight leaves.
WAITING = 14


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the
    sum of all sizes; a target stops at ``most`` times its source's size and the
    excess is shared anew by weight.  That is the level ``x`` with
    ``target = least(most * size, x * weight)``, found from running sums in the order
    of ``size / weight``.  There is one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("double"))
    capped = weighed.withColumn("cap", F.col("source_size").cast("double") * most)
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = F.lit(0.0)
    total = F.sum(F.col("source_size").cast("double")).over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), zero)
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)
    # The level if all sources before this one are full; the first that it does not overfill holds.
    levels = capped.withColumn("level", left / share)
    fit = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.first(fit, ignorenulls=True).over(fills.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("level", level).select(
        "source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target")
    )


def _null(sizes: list[float]) -> tuple[float, float, float]:
    """A direction that changes neither count nor words of three documents."""
    a, b, c = sizes
    if a == b == c:
        return 1.0, -1.0, 0.0
    return b - c, c - a, a - b


def flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Move ``p`` until at most two documents are neither 0 nor 1.

    Expected values are kept: a step goes either way with the probability that
    makes it fair.  ``draws`` are uniform numbers, one for each step.  The order
    of the documents decides which are left at the end: the last ones.
    """
    p = p.astype(float).copy()
    held: list[int] = []
    steps = iter(draws.tolist())
    for i in np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist():
        held.append(i)
        while len(held) == 3:
            u = _null([float(size[j]) for j in held])
            up, down = np.inf, np.inf
            for j, d in zip(held, u):
                if d > 0:
                    up, down = min(up, (1 - p[j]) / d), min(down, p[j] / d)
                elif d < 0:
                    up, down = min(up, p[j] / -d), min(down, (1 - p[j]) / -d)
            move = up if next(steps, 0.5) * (up + down) < down else -down
            for j, d in zip(held, u):
                p[j] += move * d
                if p[j] <= EPS or p[j] >= 1 - EPS:
                    p[j] = float(p[j] > 0.5)
            held = [j for j in held if 0 < p[j] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the undecided: the outcome whose word total is nearest, then count."""
    p = p.copy()
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if len(left):
        outcomes = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
        words = np.abs((outcomes - p[left]) @ size[left])
        count = np.abs(outcomes.sum(axis=1) - p[left].sum())
        p[left] = outcomes[np.lexsort((count, words.round(6)))[0]]
    return p


def fly_and_land(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """`flight`, but a few documents of all sizes wait for the landing."""
    undecided = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    waiting = undecided[np.unique(np.linspace(0, len(undecided) - 1, WAITING).round().astype(int))] if len(undecided) else undecided
    rest = np.setdiff1d(undecided, waiting)
    p = p.copy()
    p[rest] = flight(p[rest], size[rest], draws[rest])
    return land(p, size)


COLUMNS = "group long, key long, row long, size long, p double"
NAMES = ["group", "key", "row", "size", "p"]


def _flier(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fly(frame: pd.DataFrame) -> pd.DataFrame:
        # Large documents are decided first, so what is left over is small.
        frame = frame[NAMES].sort_values(["size", "key", "row"], ascending=[False, True, True])
        size = frame["size"].to_numpy()
        draws = (frame["key"].to_numpy() & ((1 << 53) - 1)) / float(1 << 53)
        return frame.assign(p=(fly_and_land if last else flight)(frame["p"].to_numpy(), size, draws))

    return fly


def balance(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows(group, key, row, size, p)`` with every ``p`` moved to 0 or 1.

    Totals of ``p`` and of ``p * size`` in each group change by little: by the
    landing of the last two documents.  ``key``, a hash of the document, deals
    the blocks and gives the draws, so reruns agree.  ``rows`` should be a
    written table.
    """
    ship_package(rows.sparkSession)
    decided = rows.filter("p <= 0 OR p >= 1").select(*NAMES)
    undecided = rows.filter("p > 0 AND p < 1").select(*NAMES)
    while True:
        sizes = materialize(undecided.groupBy(F.col("group").alias("_group")).agg(F.count("*").alias("_n")), "undecided")
        last = (sizes.agg(F.max("_n")).first()[0] or 0) <= block
        dealt = undecided.join(broadcast_if_small(sizes), F.col("group") == F.col("_group"))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.ceil(F.col("_n") / block)))
        flown = dealt.groupBy("group", "block").applyInPandas(_flier(last), COLUMNS)
        flown = materialize(flown, "flight")
        decided = decided.union(flown.filter("p = 0 OR p = 1"))
        if last:
            return decided
        undecided = flown.filter("p > 0 AND p < 1")


def sized(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """``(row, doc_id, source, size, key)``: what mixing needs of each row."""
    return docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        word_count(F.col("text")).alias("size"),
        F.xxhash64("doc_id", "text").alias("key"),
    )


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(row, doc_id, source, size, source_size, target, copies)`` per row.

    ``rows`` is a written table of `sized`.  ``copies`` (0 to ``most``) is how often
    the mix repeats the document.  A null text has no words; documents without
    words are not taken.  Rows with null ids count like others, repeated rows are
    decided one by one, a null source is a source of its own, and a source without
    words has target 0.  An empty table gives an empty result.
    """
    totals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    totals = materialize(totals.withColumn("group", F.xxhash64("source")), "targets")
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    parts = totals.select(F.col("source").alias("_source"), "source_size", "target", "group", factor.alias("factor"))
    joined = rows.join(broadcast_if_small(parts), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    taken = F.col("size") > 0
    whole = F.when(taken, F.least(F.floor(F.col("factor") + EPS), F.lit(most))).otherwise(F.lit(0)).cast("int")
    over = F.col("factor") - F.col("whole")
    joined = joined.withColumn("whole", whole)
    joined = joined.withColumn("p", F.when(taken & (over > EPS), over).otherwise(F.lit(0.0)))
    joined = materialize(joined, "fractions")
    extra = balance(joined).select(F.col("row").alias("_row"), F.col("p").alias("_p"))
    copies = (F.col("whole") + F.col("_p")).cast("int").alias("copies")
    names = ["row", "doc_id", "source", "size", "source_size", "target"]
    return joined.join(extra, F.col("row") == F.col("_row")).select(*names, copies)


def remix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Repeated rows (same id, source and text) are decided together.
    """
    names = docs.columns
    mark = "_mix"
    while any(c.startswith(mark) for c in names):
        mark += "_"
    key = F.xxhash64("doc_id", "source", "text")
    rows = sized(docs, key).groupBy("row", "source", "key").agg(F.min("doc_id").alias("doc_id"), F.sum("size").alias("size"))
    taken = materialize(mix(materialize(rows, "sized")).filter("copies > 0"), "taken")
    times = F.sequence(F.lit(1), F.col("copies"))
    taken = broadcast_if_small(taken.select(F.col("row").alias(f"{mark}row"), times.alias(f"{mark}times")))
    repeated = docs.join(taken, key == F.col(f"{mark}row"))
    return repeated.withColumn(f"{mark}nth", F.explode(f"{mark}times")).select(*(docs[c] for c in names))
