"""Finds test items inside documents by size-partitioned MinHash containment.

A test item is short and a document may be long, so their resemblance is close
to zero even where the item is contained whole, and signatures of documents would
miss it.  The sketch is therefore taken on the item's side.  Items are partitioned by
their number of shingles; an item with ``q`` of them is contained at ``t`` if at most
``q - ceil(t * q)`` are missing, so among its ``q - ceil(t * q) + 1`` smallest
hashes (its bottom-k MinHash sketch) at least one is in the document.  A document
probes the partitions that are not too large for it with all its shingles, which
nominates every item above the threshold; exact shingles decide.

Documents are read once for each block of items and never shuffled.  A block is
broadcast and holds at most ``BLOCK_BYTES`` of text; more items make more blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evledger.llm.common import as_bytes, slices, to_arrow
from evledger.session import ship_package

WIDTH = 5
THRESHOLD = 0.8
BLOCK_BYTES = 16 << 20
FOUND = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"
_NOT_WORD = regex.compile(r"[^\p{L}\p{N}]+")
#: Low bits of hashes that a table of bits holds, to pass over most shingles.
_BITS = 20


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters and digits."""
    return _NOT_WORD.sub(" ", text.decode("utf-8", "replace").lower()).encode().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    total = len(words) - width + 1
    if total < 1:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:total].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


class Partition:
    """Items of one shingle width whose shingle counts have one bit length."""

    def __init__(self, width: int, items: list[tuple[int | None, set[bytes]]], threshold: float) -> None:
        self.width = width
        self.items = items
        self.need = [math.ceil(threshold * len(s) - 1e-9) for _, s in items]
        self.least = min(self.need)
        hashes, owners = [], []
        for i, (_, own) in enumerate(items):
            sketch = sorted(xxhash.xxh64_intdigest(s) for s in own)[: len(own) - self.need[i] + 1]
            hashes += sketch
            owners += [i] * len(sketch)
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        self.hashes = np.array(hashes, np.uint64)[order]
        self.owners = np.array(owners)[order]

    def nominated(self, hashes: np.ndarray) -> list[int]:
        low = np.searchsorted(self.hashes, hashes, "left")
        high = np.searchsorted(self.hashes, hashes, "right")
        found: set[int] = set()
        for a, b in zip(low[low < high].tolist(), high[low < high].tolist()):
            found.update(self.owners[a:b].tolist())
        return sorted(found)


class Index:
    """The sketches of a block of items, by size."""

    def __init__(self, items: list[tuple[int | None, str]], width: int, threshold: float) -> None:
        groups: dict[tuple[int, int], list[tuple[int | None, set[bytes]]]] = {}
        for item_id, text in items:
            words = words_of(text.encode())
            if words:  # a shorter item is one shingle of all its words
                own = min(width, len(words))
                found = shingles(words, own)
                groups.setdefault((own, len(found).bit_length()), []).append((item_id, found))
        self.partitions = [Partition(w, found, threshold) for (w, _), found in sorted(groups.items())]
        self.seen = {w: np.zeros(1 << _BITS, bool) for w, _ in groups}
        for p in self.partitions:
            self.seen[p.width][p.hashes & np.uint64((1 << _BITS) - 1)] = True

    def search(self, text: bytes) -> list[tuple[int | None, int, int]]:
        """``(item, shared shingles, its shingles)`` of what ``text`` contains."""
        words = words_of(text)
        out = []
        for width, seen in self.seen.items():
            hashes = shingle_hashes(words, width)
            probes = hashes[seen[hashes & np.uint64((1 << _BITS) - 1)]]
            if not len(probes):
                continue
            own: set[bytes] | None = None
            for p in self.partitions:
                if p.width == width and p.least <= len(hashes):
                    for i in p.nominated(probes):
                        own = shingles(words, width) if own is None else own
                        item_id, needed = p.items[i]
                        shared = len(needed & own)
                        if shared >= p.need[i]:
                            out.append((item_id, shared, len(needed)))
        return out


def classes(items: DataFrame) -> DataFrame:
    """``(item_id, text)`` with one row for items of the same words.

    The smallest id stands for them; items without a word are left out.
    """
    words = F.btrim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), words.alias("text"))
    return rows.filter("text <> ''").groupBy("text").agg(F.min("item_id").alias("item_id"))


def blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """Item classes in blocks of at most about ``limit`` bytes, or one longer item."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // (limit // 2)) if total > limit else 1
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).select("item_id", "text").collect()
        if rows:
            yield [(row["item_id"], row["text"]) for row in rows]


def _scan(
    docs: DataFrame, schema: T.StructType, index: Index, each: Callable[[pa.RecordBatch, Index], pa.RecordBatch]
) -> DataFrame:
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield each(part, shared.value)

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_shingles, containment)`` of contained items.

    A pair is found if at least ``threshold`` of the item's distinct ``width``-word
    shingles are in the document.  Items of the same words are one, named by the
    smallest id.  Items with fewer words are one shingle; null or wordless texts
    contain and are contained in nothing.  Repeated documents each have their rows.
    """
    schema = T._parse_datatype_string(FOUND)
    arrow = to_arrow(FOUND)

    def each(batch: pa.RecordBatch, index: Index) -> pa.RecordBatch:
        rows = [
            (doc_id, item, shared, size, shared / size)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")))
            for item, shared, size in index.search(text)
        ]
        columns = list(zip(*rows)) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    found = docs.sparkSession.createDataFrame([], schema)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in blocks(classes(items)):
        found = found.union(_scan(read, schema, Index(block, width, threshold), each))
    return found


def drop_contaminated(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` whose text contains no item."""

    def each(batch: pa.RecordBatch, index: Index) -> pa.RecordBatch:
        clean = [not index.search(text) for text in as_bytes(batch.column("text"))]
        return batch.filter(pa.array(clean, pa.bool_()))

    for block in blocks(classes(items)):
        docs = _scan(docs, docs.schema, Index(block, width, threshold), each)
    return docs
