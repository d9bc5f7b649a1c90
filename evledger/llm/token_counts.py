"""Token counts that follow edits, from a segment tree of pre-tokens per document.

The leaves of a document's tree are the pieces of `tokens.pieces`, whose tokens never
join; a node sums characters and tokens below it.  An edit finds its leaves by a descent
over characters, takes in neighbours until both ends are again places where pieces may
part, re-encodes that region alone and updates the sums above it.  The cost of an edit
is that of the region and the height of the tree, whatever the document's length.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evledger.llm.common import arrow_map, as_bytes
from evledger.llm.token_store import encoder
from evledger.llm.tokens import Encoder, pieces

Edit = tuple[int, int, str]
#: Bytes of text whose pieces a task holds at once.
PIECE_BYTES = 2 << 20
HELD = (
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lengths", T.ArrayType(T.IntegerType())),
    T.StructField("counts", T.ArrayType(T.IntegerType())),
)


class CountTree:
    """Sums of characters and tokens over the pieces of one text."""

    def __init__(self, parts: list[str], counts: list[int], count: Callable[[list[str]], list[int]]) -> None:
        self.count = count
        self.reencoded = 0
        self._build(parts, counts)

    def _build(self, parts: list[str], counts: list[int]) -> None:
        self.parts = list(parts)
        self.size = 1 << max(0, len(parts) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if parts:
            self.sums[self.size : self.size + len(parts), 0] = list(map(len, parts))
            self.sums[self.size : self.size + len(parts), 1] = counts
        at = self.size
        while at > 1:  # one level at a time
            level = self.sums[at : 2 * at]
            at //= 2
            self.sums[at : 2 * at] = level[0::2] + level[1::2]

    @property
    def length(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(self.parts)

    def _leaf(self, offset: int) -> tuple[int, int]:
        """Leaf that holds the character at ``offset``, and its place in there."""
        node = 1
        while node < self.size:
            node *= 2
            left = int(self.sums[node, 0])
            if offset >= left:
                offset -= left
                node += 1
        return node - self.size, offset

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        node = leaf + self.size
        self.parts[leaf] = text
        self.sums[node] = (len(text), tokens)
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` up to ``end`` by ``new``.

        Offsets are cut to the text; an end before the start means the start.
        """
        start = min(max(0, start), self.length)
        end = min(max(start, end), self.length)
        if start == end and not new:
            return
        if not self.length:
            parts = pieces(new)
            self.reencoded += len(new)
            self._build(parts, self.count(parts))
            return
        first, skip = self._leaf(min(start, self.length - 1))
        if start == self.length:
            skip = len(self.parts[first])
        last, past = self._leaf(max(start, end - 1) if end > start else min(start, self.length - 1))
        past = past + 1 if end > start else skip
        region = self.parts[first][:skip] + new + self.parts[last][past:]
        while first > 0 and not self._parts_before(first, region):
            first -= 1
            region = self.parts[first] + region
        while last + 1 < len(self.parts) and not self._parts_after(last, region):
            last += 1
            region += self.parts[last]
        found = pieces(region) if region else []
        counts = self.count(found) if found else []
        self.reencoded += len(region)
        room = last - first + 1
        if len(found) > room + 64:  # much was inserted: new leaves
            old = self.sums[self.size : self.size + len(self.parts), 1].tolist()
            self._build(
                self.parts[:first] + found + self.parts[last + 1 :], old[:first] + counts + old[last + 1 :]
            )
            return
        # The last leaf of the region holds what is over; unused ones are empty.
        for k in range(room - 1):
            self._put(first + k, found[k] if k < len(found) else "", counts[k] if k < len(counts) else 0)
        self._put(last, "".join(found[room - 1 :]), sum(counts[room - 1 :]))

    def _parts_before(self, first: int, region: str) -> bool:
        """Whether the region may begin here: after no space, before one."""
        k = first - 1
        while k >= 0 and not self.parts[k]:
            k -= 1
        return k < 0 or (region[:1] in (" ", "\n") and region != "" and not self.parts[k][-1].isspace())

    def _parts_after(self, last: int, region: str) -> bool:
        k = last + 1
        while k < len(self.parts) and not self.parts[k]:
            k += 1
        return k == len(self.parts) or (region != "" and self.parts[k][0] in (" ", "\n") and not region[-1].isspace())


def counter(coder: Encoder) -> Callable[[list[str]], list[int]]:
    """Token counts of pieces."""
    wide = coder.dtype.itemsize

    def count(parts: list[str]) -> list[int]:
        return [len(ids) // wide for row in coder.parts(parts) for ids in [b"".join(row)]]

    return count


def states(docs: DataFrame, tokenizer: str, keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, text, lengths, counts)``: the leaves of each document's tree.

    A null text has none.  Columns in ``keep`` are carried along.
    """
    keep = keep or []
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    carried = {field.name: field for field in kept.schema if field.name in keep}
    schema = T.StructType([*HELD, *carried.values()])

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        texts, lengths, counts = _leaves(batch, encoder(tokenizer))
        out = {c: batch.column(c) for c in ["doc_id", *carried]}
        return out | {"text": pa.array(texts), "lengths": lengths, "counts": counts}

    return arrow_map(kept, schema, each, sized_by="text", limit=PIECE_BYTES)


def _leaves(batch: pa.RecordBatch, coder: Encoder) -> tuple[list[str], list[list[int]], list[list[int]]]:
    """Texts, and characters and tokens of their pieces."""
    wide = coder.dtype.itemsize
    texts = [t.decode("utf-8", "replace") for t in as_bytes(batch.column("text"))]
    rows, cuts = coder.parts(texts, with_cuts=True)
    return texts, [list(map(len, cut)) for cut in cuts], [[len(ids) // wide for ids in row] for row in rows]


def _edited(
    text: str, lengths: list[int], counts: list[int], edits: list[Edit], count: Callable[[list[str]], list[int]]
) -> tuple[str, list[int], list[int], int, int, int, int]:
    """State after the edits, and its figures."""
    before, again = sum(counts), 0
    if edits:
        ends = np.cumsum(lengths).tolist()
        tree = CountTree([text[e - k : e] for e, k in zip(ends, lengths)], counts, count)
        for edit in edits:
            tree.edit(*edit)
        leaves = [(p, c) for p, c in zip(tree.parts, tree.sums[tree.size :, 1].tolist()) if p]
        text, lengths, counts = tree.text(), [len(p) for p, _ in leaves], [c for _, c in leaves]
        again = tree.reencoded
    return text, lengths, counts, before, len(edits), again, sum(counts)


FIGURES = ("n_before", "n_edits", "reencoded", "n_tokens")


def apply_edits(held: DataFrame, tokenizer: str, propose: Callable[[str], list[Edit]] | None = None) -> DataFrame:
    """States after edits, with ``(n_before, n_edits, reencoded, n_tokens)``.

    Edits are a column ``edits`` of ``(start, end, new)`` structs in ``held``, or what
    ``propose`` gives for a text.  They apply in order, each to the text that the one
    before left; null means none.  ``reencoded`` counts characters.
    """
    schema = T.StructType([*HELD, *(T.StructField(name, T.LongType()) for name in FIGURES)])
    names = ["text", "lengths", "counts"]

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        count = counter(encoder(tokenizer))
        wanted = batch.column("edits").to_pylist() if propose is None else None
        rows = []
        for n, (text, lengths, counts) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
            edits = propose(text) if propose else [(e["start"], e["end"], e["new"] or "") for e in wanted[n] or []]
            rows.append(_edited(text, lengths, counts, edits, count))
        columns = zip(*rows) if rows else [[]] * 7
        return {"doc_id": batch.column("doc_id")} | dict(zip([*names, *FIGURES], map(list, columns)))

    return arrow_map(held, schema, each, sized_by="text", limit=PIECE_BYTES)


def edit_documents(docs: DataFrame, tokenizer: str, propose: Callable[[str], list[Edit]]) -> DataFrame:
    """``(doc_id, n_before, n_edits, reencoded, n_tokens)``: trees built and edited in one pass.

    Rows are those of `states` and `apply_edits`; the states are not kept.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([HELD[0], *(T.StructField(name, T.LongType()) for name in FIGURES)])

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        coder = encoder(tokenizer)
        count = counter(coder)
        rows = [_edited(*leaves, propose(leaves[0]), count)[3:] for leaves in zip(*_leaves(batch, coder))]
        columns = zip(*rows) if rows else [[]] * len(FIGURES)
        return {"doc_id": batch.column("doc_id")} | dict(zip(FIGURES, map(list, columns)))

    return arrow_map(kept, schema, each, sized_by="text", limit=PIECE_BYTES)


_PRIVATE = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+?\(?\d[\d() -]{6,}\d")


def scrub(text: str) -> list[Edit]:
    """Edits that put a mark in place of mail addresses and telephone numbers.

    Last first, so that offsets of the original text hold.
    """
    found = [(m.start(), m.end(), "[removed]") for m in _PRIVATE.finditer(text)]
    return found[::-1]
