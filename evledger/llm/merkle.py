"""Merkle manifest of a dataset in blocks with a van Emde Boas layout.

A source's documents, ordered by id, are the leaves of a tree in which three
consecutive nodes make one.  The tree is cut into aligned blocks of `HEIGHT` steps
(3**HEIGHT leaves); the roots of the blocks are the leaves of the next blocks, until
one node is left.  The subroots of all sources make one more tree of the same kind.

A block is one row.  It stores the digests of its subtree in the van Emde Boas order:
the upper half of its levels first, then each subtree below it, each laid out in the
same way.  A path to a leaf so touches few neighbouring ranges at any cache size.
Addresses are arithmetic; building a block and finding siblings both go through them.

Each level of blocks costs one shuffle of rows of a hash's size.  No source meets in
one task: leaves are numbered by ranges, and a block is a group of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evledger.llm.common import arrow_map, to_arrow
from evledger.llm.ranking import ranked
from evledger.session import broadcast_if_small, materialize

ARITY = 3
#: Steps from the leaves of a block to its root.
HEIGHT = 5
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<at:int,others:string>>"


def nodes(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


@lru_cache
def addresses(levels: int, depth: int) -> np.ndarray:
    """Places of the nodes at ``depth``, left to right, in a stored tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros(1, np.int64)
    top = levels // 2
    bottom = levels - top
    if depth < top:
        return addresses(top, depth)
    below = nodes(top) + nodes(bottom) * np.arange(ARITY**top)
    return (below[:, None] + addresses(bottom, depth - top)[None, :]).ravel()


def levels_for(total: int, height: int = HEIGHT) -> int:
    """Levels of a block of a tree level with ``total`` nodes: whole unless it reaches the root."""
    levels = 1
    while ARITY ** (levels - 1) < total and levels <= height:
        levels += 1
    return levels


def widths(count: int, levels: int) -> list[int]:
    """Nodes present at each depth of a block over ``count`` leaves."""
    found = [count]
    for _ in range(levels - 1):
        found.append(-(-found[-1] // ARITY))
    return found[::-1]


def fill(leaves: list[bytes], levels: int) -> bytes:
    """A block's stored tree; places without a node are zero."""
    stored = bytearray(nodes(levels) * DIGEST)
    row = leaves
    for depth in range(levels - 1, -1, -1):
        for at, digest in zip(addresses(levels, depth).tolist(), row):
            stored[at * DIGEST : (at + 1) * DIGEST] = digest
        if depth:
            hexes = [d.hex() for d in row]
            row = [sha256("".join(hexes[i : i + ARITY]).encode()).digest() for i in range(0, len(hexes), ARITY)]
    return bytes(stored)


def digest_at(stored: bytes, levels: int, depth: int, index: int) -> str:
    at = int(addresses(levels, depth)[index]) * DIGEST
    return stored[at : at + DIGEST].hex()


def climb(stored: bytes, levels: int, count: int) -> list[list[tuple[int, str]]]:
    """For each leaf of a block the steps to its root: its place in the run and the run's other digests."""
    present = widths(count, levels)
    above: list[list[tuple[int, str]]] = [[]]
    for depth in range(1, levels):
        row = [digest_at(stored, levels, depth, i) for i in range(present[depth])]
        steps = []
        for i in range(present[depth]):
            first = i - i % ARITY
            others = "".join(row[first:i] + row[i + 1 : first + ARITY])
            steps.append([(i - first, others), *above[i // ARITY]])
        above = steps
    return above


def fold(leaf: str, steps: list[tuple[int, str]]) -> str:
    """The root that a leaf digest and its siblings give."""
    for at, others in steps:
        cut = at * 2 * DIGEST
        leaf = sha256((others[:cut] + leaf + others[cut:]).encode()).hexdigest()
    return leaf


def leaf_digest(**changed: Column) -> Column:
    """Hex digest of a row's five fields, each with its length; ``changed`` replaces fields."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        sized = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Manifest:
    """Blocks of the sources' trees by level, blocks of the tree over them, and their tops.

    Blocks are ``(key, block, total, count, tree)``, at the first level with the ids of
    the leaves; ``subroots`` is ``(key, level, subroot)``, ``root`` the digest of all.
    """

    levels: list[DataFrame]
    over: list[DataFrame]
    subroots: DataFrame
    root: str | None
    height: int


def _blocks(rows: DataFrame, label: str, carried: list[str], height: int) -> DataFrame:
    """Stored blocks of ``(key, rank, total, digest, *carried)``."""
    size = ARITY**height
    block = F.floor(F.col("rank") / size).cast("long").alias("block")
    member = F.struct("rank", "digest", *carried)
    grouped = rows.groupBy("key", block, "total").agg(F.sort_array(F.collect_list(member)).alias("members"))
    lists = {c: F.col(f"members.{c}").alias(f"{c}s") for c in carried}
    grouped = grouped.select("key", "block", "total", F.col("members.digest").alias("digests"), *lists.values())
    kept = [c for c in grouped.columns if c != "digests"]
    schema = T.StructType([*(grouped.schema[c] for c in kept), T.StructField("count", T.IntegerType()), T.StructField("tree", T.BinaryType())])

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        digests = batch.column("digests").to_pylist()
        totals = batch.column("total").to_pylist()
        trees = [fill(d, levels_for(n, height)) for d, n in zip(digests, totals)]
        return {c: batch.column(c) for c in kept} | {"count": [len(d) for d in digests], "tree": pa.array(trees, pa.binary())}

    return materialize(arrow_map(grouped, schema, each), label)


def _raised(blocks: DataFrame, height: int) -> DataFrame:
    """Roots of the blocks as leaves of the next level, where a source has several."""
    size = ARITY**height
    root = F.substring("tree", 1, DIGEST).alias("digest")  # the root comes first in every layout
    total = F.ceil(F.col("total") / size).cast("long").alias("total")
    return blocks.filter(F.col("total") > size).select("key", F.col("block").alias("rank"), total, root)


def _levels(rows: DataFrame, label: str, carried: list[str], height: int) -> list[DataFrame]:
    found = [_blocks(rows, label, carried, height)]
    while not (rows := _raised(found[-1], height)).isEmpty():
        found.append(_blocks(rows, label, [], height))
    return found


def _tops(levels: list[DataFrame], height: int) -> DataFrame:
    """``(key, level, digest)`` of every tree."""
    size = ARITY**height
    parts = [
        b.filter(F.col("total") <= size).select("key", F.lit(k).alias("level"), F.substring("tree", 1, DIGEST).alias("digest"))
        for k, b in enumerate(levels)
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def build(docs: DataFrame, forged: Column | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of ``docs(doc_id, source, lang, n_chars, text)``.

    ``forged`` is an expression for another digest to be checked against a row's
    siblings (see `proofs`); null where there is none.  Leaves of a source ascend
    by ``doc_id`` (null first), equal ids by digest; repeated rows are leaves of their
    own.  A null source is a source, before all others.
    """
    # Sources as keys that are never null and keep their order.
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    other = F.lit(None).cast("binary") if forged is None else F.unhex(forged)
    leaves = docs.select(key.alias("key"), "doc_id", F.unhex(leaf_digest()).alias("digest"), other.alias("forged"))
    leaves = leaves.withColumn("forged", F.when(F.col("forged") != F.col("digest"), F.col("forged")))
    leaves = ranked(materialize(leaves, "leaves"), "key", [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    levels = _levels(leaves, "blocks", ["doc_id", "forged"], height)
    tops = materialize(_tops(levels, height), "tops")
    named = tops.select(F.lit("").alias("all"), F.col("key").alias("name"), "digest")
    sources = ranked(materialize(named, "sources"), "all", [F.col("name")])
    over = _levels(sources.withColumnRenamed("all", "key"), "over", ["name"], height)
    root = _tops(over, height).select(F.lower(F.hex("digest")).alias("root")).first()
    subroots = tops.select("key", "level", F.lower(F.hex("digest")).alias("subroot"))
    return Manifest(levels, over, subroots, root["root"] if root else None, height)


def _below(blocks: DataFrame, height: int, names: str | None = None) -> DataFrame:
    """``(key, rank, steps)`` of the leaves of blocks that have the ``steps`` of their roots.

    With ``names``, the column of leaf names takes the place of key and rank.
    """
    carried = [c for c in ("subroot",) if c in blocks.columns]
    schema = f"key string, rank long, steps {STEP}" + "".join(f", {c} string" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = climb(row["tree"], levels_for(row["total"], height), row["count"])
                above = [(s["at"], s["others"]) for s in row["steps"]]
                first = row["block"] * ARITY**height
                out = [
                    {"key": row[names][i] if names else row["key"], "rank": first + i,
                     "steps": [{"at": at, "others": others} for at, others in [*steps, *above]]}
                    | {c: row[c] for c in carried}
                    for i, steps in enumerate(own)
                ]
                yield pa.RecordBatch.from_pylist(out, schema=target)

    target = to_arrow(schema)
    return blocks.mapInArrow(run, schema)


def _paths(levels: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """Blocks of the first level with the steps from their roots on.

    ``tops`` is ``(key, level, steps, ...)``: what follows the top of each tree.
    """
    above = None
    for k in range(len(levels) - 1, -1, -1):
        ends = tops.filter(F.col("level") == k).drop("level").withColumn("rank", F.lit(0).cast("long"))
        above = ends if above is None else above.unionByName(ends)
        above = above.withColumnRenamed("rank", "block")
        joined = levels[k].join(broadcast_if_small(above, 20_000), ["key", "block"])
        if k:
            above = materialize(_below(joined, height), "paths")
    return joined


def proofs(manifest: Manifest) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every leaf.

    ``folded_root`` is what the forged digest, or else the leaf, gives with the
    leaf's siblings up to the root of all.
    """
    root, height = manifest.root or "", manifest.height
    start = manifest.subroots.sparkSession.createDataFrame([("", len(manifest.over) - 1, [])], f"key string, level int, steps {STEP}")
    of_sources = _below(_paths(manifest.over, start, height), height, "names")
    of_sources = materialize(of_sources.select("key", "steps"), "source-paths")
    tops = materialize(manifest.subroots.join(of_sources, "key"), "tops")
    blocks = _paths(manifest.levels, tops, height)
    id_type = blocks.schema["doc_ids"].dataType.elementType
    texts = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(c, T.StringType()) for c in texts), T.StructField("verified", T.BooleanType())])

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in schema.names}
        for row in batch.to_pylist():
            levels = levels_for(row["total"], height)
            above = [(s["at"], s["others"]) for s in row["steps"]]
            for i, steps in enumerate(climb(row["tree"], levels, row["count"])):
                steps += above
                leaf = digest_at(row["tree"], levels, levels - 1, i)
                other = row["forgeds"][i]
                folded = fold(leaf if other is None else other.hex(), steps)
                proof = sha256("".join(others for _, others in steps).encode()).hexdigest()
                values = (row["doc_ids"][i], leaf, row["subroot"], root, proof, folded, folded == root)
                for c, value in zip(schema.names, values):
                    out[c].append(value)
        return out

    return arrow_map(blocks, schema, each)


def audit(docs: DataFrame, tampered: Column, height: int = HEIGHT) -> DataFrame:
    """Every row of ``docs`` proved against the manifest, as it is or as tampering left it.

    Where ``tampered`` holds, the checked copy of the row has lost the newlines of
    its text (a null stays null, so such a row and one without newlines still verify).  Nulls are
    digested as ``-`` and differ from empty texts; other columns are not read; an empty
    table gives an empty result.
    """
    changed = F.when(tampered, leaf_digest(text=F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    return proofs(build(docs, changed, height))
