"""SimHash near-duplicates through a byte-position index with count filtering.

Two 64-bit fingerprints that differ in at most four bits agree in at least four
of their eight bytes.  The index posts a fingerprint under each set of four positional
bytes, since lists of single bytes would hold one in 256 fingerprints each.  In a
bucket the equal positional bytes of each pair are tallied; a pair below the guaranteed
minimum (eight less the distance sought) is dropped, the others are verified by their exact distance.  Buckets
are keyed by 32 bits, so they stay small until fingerprints number in the billions.

A bucket that is still hot (many different fingerprints with four equal bytes)
is split by the same rule on its 32 free bits as eight nibbles, then on 16 free
bits as eight pairs; eight free bits hold at most 256 fingerprints.  Nothing is
capped: each split keeps every pair within the distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evledger.llm.common import arrow_map, as_bytes, fresh
from evledger.llm.components import components
from evledger.session import broadcast_if_small, materialize, ship_package, task_width

SYMBOLS = 8
MAX_BITS = 4
#: Buckets with more fingerprints are split further before pairs are compared.
HOT_BUCKET = 2048
#: Shingle hashes whose bits are tallied at once.
TALLY = 1 << 16


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """SimHash of all ``width``-word shingles of a text, repeats included.

    A-Z are lower-cased.  Fewer words give one shingle of all of them; no word
    gives zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    total = len(words) - width + 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:total]
    ends = ends[width - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, TALLY):
        spans = zip(starts[at : at + TALLY].tolist(), ends[at : at + TALLY].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, keep: str | None = None) -> DataFrame:
    """``(doc_id, fp)`` per row of ``docs``; a null text has no words.

    With ``keep``, all columns of ``docs`` and the fingerprint under that name.
    """
    if keep is None:
        kept, name = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "fp"
        schema = T.StructType([kept.schema["doc_id"], T.StructField(name, T.LongType())])
    else:
        kept, name = docs, keep
        schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        values = [fingerprint(t, width, seed) for t in as_bytes(batch.column("text"))]
        return {c: batch.column(c) for c in batch.schema.names} | {name: pa.array(values, pa.int64())}

    return arrow_map(kept, schema, each, sized_by="text")


def _masks(fixed: int, width: int) -> list[int]:
    """``fixed`` joined with each set of four of the eight free symbols."""
    free = [b for b in range(64) if not fixed >> b & 1]
    symbols = [sum(1 << b for b in free[i * width : (i + 1) * width]) for i in range(SYMBOLS)]
    return [fixed | sum(chosen) for chosen in combinations(symbols, SYMBOLS - MAX_BITS)]


def _posted(members: DataFrame, width: int) -> DataFrame:
    """Post each ``(mask, fp)`` under the finer masks: ``(mask, value, fp)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed = batch.column("mask").to_numpy()
            fp = batch.column("fp").to_numpy()
            for mask in np.unique(fixed):
                of = fp[fixed == mask]
                for finer in _masks(int(mask) & (2**64 - 1), width):
                    finer = np.array(finer, np.uint64).view(np.int64)
                    columns = [np.full(len(of), finer), of & finer, of]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["mask", "value", "fp"])

    return members.mapInArrow(run, "mask long, value long, fp long")


def shared_bytes(apart: np.ndarray) -> np.ndarray:
    """Tally of the positional bytes in which two fingerprints agree, from their XOR."""
    return (np.ascontiguousarray(apart)[..., None].view(np.uint8) == 0).sum(axis=-1)


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs within ``bits`` of a bucket connect."""
    left = np.arange(len(fps))
    words = fps.view(np.uint64)  # bits of signed numbers would be counted in their absolute value
    links: list[tuple[int, int]] = []
    while len(left):  # breadth first over the members that are not reached yet
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            apart = words[front[:, None]] ^ words[left[None, :]]
            near = shared_bytes(apart) >= SYMBOLS - bits
            # Only pairs that reach the guaranteed minimum of shared bytes are measured.
            i, j = np.nonzero(near)
            near[i, j] = np.bitwise_count(apart[i, j]) <= bits
            reached = near.any(axis=0)
            by = front[near.argmax(axis=0)]
            links += zip(fps[by[reached]].tolist(), fps[left[reached]].tolist())
            front, left = left[reached], left[~reached]
    return links


def _compare(buckets: DataFrame, bits: int) -> DataFrame:
    """Spanning links ``(a, b)`` of every bucket; a bucket's rows are adjacent."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            rows = frame if rest is None else pd.concat([rest, frame])
            key = rows[["mask", "value"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if not len(cuts):
                rest = rows
                continue
            rest = rows.iloc[cuts[-1] :]
            yield found(rows["fp"].to_numpy(), cuts)
        if rest is not None:
            yield found(rest["fp"].to_numpy(), np.array([len(rest)]))

    def found(fps: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        start = 0
        for end in ends.tolist():
            if end - start > 1:
                links += _forest(fps[start:end], bits)
            start = end
        return pd.DataFrame(sorted(set(links)), columns=["a", "b"], dtype="int64")

    return buckets.mapInPandas(run, "a long, b long")


def near_links(distinct: DataFrame, rows: int, bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs within ``bits``.

    ``distinct`` has one row per fingerprint ``fp`` and ``rows`` of them; it is
    read twice for each level.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the index finds pairs within {MAX_BITS} bits")
    spark = distinct.sparkSession
    ship_package(spark)
    members = distinct.select(F.lit(0).cast("long").alias("mask"), "fp")
    links = None
    for width in (8, 4, 2):
        if width == 8:
            members = members.repartition(task_width(spark, rows, 20_000))
        posted = _posted(members, width)
        if width < 8:
            posted = posted.distinct()
        # Only buckets with two members or more go on; counts combine before the shuffle.
        counts = posted.groupBy("mask", "value").agg(F.count("*").alias("size")).filter("size > 1")
        counts = materialize(counts, "buckets")
        shared = posted.join(broadcast_if_small(counts), ["mask", "value"])
        shared = materialize(shared, "postings")
        small = shared if width == 2 else shared.filter(F.col("size") <= HOT_BUCKET)
        small = small.select("mask", "value", "fp")
        parted = small.repartition("mask", "value").sortWithinPartitions("mask", "value")
        found = _compare(parted, bits)
        links = found if links is None else links.union(found)
        if width == 2 or counts.filter(F.col("size") > HOT_BUCKET).isEmpty():
            return links
        members = shared.filter(F.col("size") > HOT_BUCKET).select("mask", "fp")
        members = members.repartition(F.col("mask"), F.col("fp"))
    return links


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, root, component_id)``: one row per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over fingerprints that
    differ in at most ``bits`` bits, equal ones included.  Texts without a word,
    null among them, have fingerprint zero and link like any other.  Rows with a
    null ``doc_id`` link their neighbours but never name a component unless all
    of it has none; repeated rows share one component.  Other columns are not
    read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = materialize(fingerprints(docs, width, seed), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return classes_of(rows, distinct, near_links(distinct.select("fp"), distinct.count(), bits))


def classes_of(rows: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """Root and component of each ``(doc_id, fp)``; ``distinct`` has ``(fp, least)``, ``links`` join fingerprints."""
    members = components(links)
    rooted = distinct.join(members, distinct["fp"] == members["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")
    return rows.join(broadcast_if_small(named, 20_000), "fp").select("doc_id", "fp", "root", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(
    docs: DataFrame, classes: DataFrame, prints: Callable[..., DataFrame] = fingerprints
) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one for each.

    Kept is the row whose ``doc_id`` is its ``component_id``.  Where several rows
    carry that id (repeated rows, also of other components, or components without
    any id), fingerprints tell which belong to the component, and the one with the
    smallest hash of id and text stays.  ``classes`` is what `near_duplicates`
    gave for ``docs``, with fingerprints as ``prints`` makes them.
    """
    names = docs.columns
    mark, name, of, tree, nth, own_ = fresh(names, "fp", "id", "of", "root", "nth", "own")
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    chosen = classes.filter(own)
    chosen = chosen.select(F.col("doc_id").alias(name), F.col("fp").alias(of), F.col("root").alias(tree))
    per_id = classes.groupBy(F.col("doc_id").alias(name)).agg(F.count("*").alias("n"), F.max(own).alias(own_))
    per_id = materialize(per_id.filter(own_).drop(own_), "kept")
    single = broadcast_if_small(per_id.filter((F.col("n") == 1) & F.col(name).isNotNull()).select(name))
    alone = docs.join(single, docs["doc_id"] == F.col(name), "left_semi")
    several = per_id.filter((F.col("n") > 1) | F.col(name).isNull()).select(name)
    if several.isEmpty():
        return alone
    same = docs["doc_id"].eqNullSafe(F.col(name))
    repeated = prints(docs.join(several, same, "left_semi"), keep=mark)
    repeated = repeated.join(chosen.distinct(), F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(mark) == F.col(of)))
    order = Window.partitionBy(tree).orderBy(F.xxhash64("doc_id", "text"))
    repeated = repeated.withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1)
    return alone.unionByName(repeated.select(*names))
