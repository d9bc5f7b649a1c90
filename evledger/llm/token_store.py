"""Token ids of a corpus in entropy-coded blocks, in document order.

A store is a folder of Parquet tables that Spark writes and commits:

- ``table``: one row with the shared frequency table and its checksum;
- ``blocks``: rows ``(part, seq, n_docs, n_tokens, doc_ids, lengths, block)``.
  ``part`` and ``seq`` order the blocks; a block holds whole documents, about
  ``BLOCK_TOKENS`` ids or one longer document, coded by `rans`.

Blocks are coded and read by any number of tasks; the tasks share only the table,
whose size is that of the vocabulary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evledger.llm import rans
from evledger.llm.common import arrow_map, as_bytes, slices, to_arrow
from evledger.llm.tokens import Encoder
from evledger.session import broadcast_if_small, materialize, scratch_path, ship_package, task_width

BLOCK_TOKENS = 1 << 20
BLOCKS = (
    "part int, seq int, n_docs int, n_tokens long, doc_ids array<bigint>, lengths array<int>, block binary"
)
READ = "doc_id long, part int, seq int, within long, n_tokens long, ids_crc32 long"
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_ids(docs: DataFrame, path: str, end_id: int | None = None) -> DataFrame:
    """``(doc_id, n, ids)``: ids of each row's text as little-endian bytes.

    Two bytes an id where the vocabulary allows, else four.  A null text is
    empty; ``end_id`` is appended to each document where given.
    """

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        coder = encoder(path)
        end = b"" if end_id is None else np.array([end_id], coder.dtype).tobytes()
        texts = [t.decode("utf-8", "replace") for t in as_bytes(batch.column("text"))]
        ids = [found + end for found in coder.encode(texts)]
        wide = coder.dtype.itemsize
        return {"doc_id": batch.column("doc_id"), "n": [len(x) // wide for x in ids], "ids": ids}

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(kept, "doc_id long, n long, ids binary", each, sized_by="text", limit=2 << 20)


def id_counts(ids: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; tasks count, Spark adds the counts up."""
    wide = _width(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                joined = np.frombuffer(b"".join(part.column("ids").to_pylist()), wide)
                counts += np.bincount(joined, minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in rows.collect():  # one row per id of the vocabulary at most
        counts[row["id"]] = row["n"]
    return counts


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def write_store(docs: DataFrame, target: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode every text of ``docs`` into a store at ``target``.

    Documents are in ascending ``doc_id`` order, nulls first, rows of one id by
    a hash of their ids.  Null texts hold only the end id.
    """
    spark = docs.sparkSession
    ship_package(spark)
    size = encoder(tokenizer).size
    wide = _width(size)
    ids = materialize(token_ids(docs, tokenizer, end_id), "token-ids")
    freq = rans.quantize(id_counts(ids, size), end_id)
    packed = bytearray(freq.astype("<u4").tobytes())
    head = [(size, end_id, tokenizer.rsplit("/", 1)[-1], zlib.crc32(packed), packed)]
    spark.createDataFrame(head, "size int, end_id int, tokenizer string, crc32 long, freq binary").coalesce(
        1
    ).write.parquet(f"{target}/table")
    shared = spark.sparkContext.broadcast(freq)
    schema = to_arrow(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(shared.value)
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        docs_in: list[int | None] = []
        found: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            block = rans.encode_block(np.concatenate(found), table)
            row = [part, seq, len(docs_in), held, docs_in, [len(x) for x in found], block]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                docs_in.append(doc_id)
                found.append(np.frombuffer(value.as_buffer(), wide))
                held += len(found[-1])
                if held >= BLOCK_TOKENS:
                    yield close()
                    seq, held = seq + 1, 0
                    docs_in, found = [], []
        if docs_in:
            yield close()

    tokens = ids.agg(F.sum("n")).first()[0] or 0
    width = task_width(spark, tokens, 4 * BLOCK_TOKENS)
    order = ["doc_id", F.xxhash64("ids")]
    ranged = ids.select("doc_id", "ids").repartitionByRange(width, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(run, BLOCKS).write.parquet(f"{target}/blocks")


def read_table(spark: SparkSession, store: str) -> np.ndarray:
    row = spark.read.parquet(f"{store}/table").first()
    if zlib.crc32(row["freq"]) != row["crc32"]:
        raise ValueError("the frequency table is damaged")
    return np.frombuffer(row["freq"], "<u4")


def block_starts(blocks: DataFrame) -> DataFrame:
    """``(part, seq, first)``: number of ids before each block.

    Parts add up in one small table, blocks inside their part.
    """
    sizes = blocks.select("part", "seq", "n_tokens")
    before = (Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    total = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*before))
    return (
        sizes.join(parts.select("part", total.alias("base")), "part")
        .select("part", "seq", (F.col("base") + F.coalesce(inside, F.lit(0))).alias("first"))
    )


def read_documents(spark: SparkSession, store: str) -> DataFrame:
    """Decode a store: ``(doc_id, start, n_tokens, ids_crc32)`` per document.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is that of
    the document's ids as little-endian unsigned 32-bit integers.
    """
    ship_package(spark)
    shared = spark.sparkContext.broadcast(read_table(spark, store))
    blocks = spark.read.parquet(f"{store}/blocks")
    schema = to_arrow(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("part", "seq", "doc_ids", "lengths", "block")}
                ids = rans.decode_block(row["block"], table).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                view = memoryview(ids.tobytes())
                crcs = [zlib.crc32(view[4 * (e - n) : 4 * e]) for n, e in zip(lengths.tolist(), ends.tolist())]
                n = len(lengths)
                columns = [row["doc_ids"], [row["part"]] * n, [row["seq"]] * n, ends - lengths, lengths, crcs]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    found = blocks.select("part", "seq", "doc_ids", "lengths", "block").mapInArrow(run, READ)
    starts = broadcast_if_small(materialize(block_starts(blocks), "block-starts"))
    return found.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def store_digest(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write a store of ``docs`` in the shared folder and read it back."""
    spark = docs.sparkSession
    target = scratch_path(spark, "token-store")
    write_store(docs, target, tokenizer, end_id)
    return read_documents(spark, target)
