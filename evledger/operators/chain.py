"""Hash chains: building them per ledger and checking their links."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evledger.functions import canonical as C
from evledger.functions.text import long_hash, short_hash
from evledger.operators.envelope import event_body
from evledger.operators.segments import SEGMENT_ROWS, lag_value, with_segment
from evledger.schema import BODY_FIELDS
from evledger.session import materialize, scratch_path, task_width

# Rows one task may fold per round.  The fold is sequential by definition (each
# hash covers the one before), so this bounds task time and lost work; memory
# is bounded by one Arrow batch in any case.
ROUND_ROWS = 20_000_000

_SEED_ORDER = -(2**63)

# Rows of one ledger that travel to its fold as one compressed block.
BLOCK_ROWS = 1024


def _pack(order: str, block_rows: int):
    """Rows sorted by (ledger, order) as blocks: compressed Arrow, one ledger each."""

    def run(batches):
        number = 0
        for batch in batches:
            rows = batch.num_rows
            keys = batch.column("ledger_id").to_pylist()
            # Rows without an order stand before a seed, so no block mixes them with others.
            blank = batch.column(order).is_null().to_pylist()
            starts, blocks, start = [], [], 0
            for end in range(1, rows + 1):
                alike = end < rows and (keys[end], blank[end]) == (keys[start], blank[start])
                if alike and end - start < block_rows:
                    continue
                sink = pa.BufferOutputStream()
                options = pa.ipc.IpcWriteOptions(compression="zstd")
                with pa.ipc.new_stream(sink, batch.schema, options=options) as stream:
                    stream.write_batch(batch.slice(start, end - start))
                starts.append(start)
                blocks.append(sink.getvalue().to_pybytes())
                start = end
            first = pa.array(starts, pa.int64())
            nth = pa.array(range(number, number + len(blocks)), pa.int64())
            number += len(blocks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("ledger_id").take(first), batch.column(order).take(first), nth, pa.array(blocks, pa.binary())],
                ["ledger_id", order, "_nth", "_block"],
            )

    return run


def _spell_and_pack(order: str, block_rows: int, kept: list[str]):
    """`_pack` of rows that get their canonical text in the same pass, so they cross to Python once.

    Blocks hold the ``kept`` columns and the text.
    """
    pack = _pack(order, block_rows)

    def spelled(batches):
        for batch in batches:
            body = pa.StructArray.from_arrays([batch.column(n) for n in BODY_FIELDS], list(BODY_FIELDS))
            yield batch.select(kept).append_column("_parts", C.body_parts(body))

    return lambda batches: pack(spelled(batches))


def _fold(batches):
    """Chain hashes over blocks sorted by (ledger, order), one block at a time."""
    ledger = previous = None
    for batch in batches:
        keys = batch.column("ledger_id").to_pylist()
        seeds = batch.column("_seed").to_pylist()
        blocks = batch.column("_block")
        for i, key in enumerate(keys):
            if key != ledger:
                ledger, previous = key, None
            if not blocks[i].is_valid:
                previous = seeds[i]
                continue
            table = pa.ipc.open_stream(blocks[i].as_buffer()).read_all()
            parts = table.column("_parts").combine_chunks()
            before, own = [], []
            heads, tails = (parts.field(n).cast(pa.binary()).to_pylist() for n in ("head", "tail"))
            link = b"null" if previous is None else json.dumps(previous).encode("utf-8")
            for head, tail in zip(heads, tails):
                before.append(previous)
                previous = hashlib.sha256(head + link + tail).hexdigest()
                link = b'"%b"' % previous.encode("ascii")
                own.append(previous)
            out = table.drop_columns([n for n in ("_parts", "previous_hash") if n in table.column_names])
            out = out.append_column("previous_hash", pa.array(before, pa.string()))
            out = out.append_column("content_hash", pa.array(own, pa.string()))
            yield from out.to_batches()


def _fold_round(
    rows: DataFrame,
    heads: DataFrame | None,
    order: str,
    width: int,
    block_rows: int = BLOCK_ROWS,
    build: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One bounded round: seed rows carry each ledger's current head.

    Rows are ordered in ranges of any ledger, spelled there, and come to their ledger's
    task as compressed blocks: what a task sorts is one row a block, so it holds a ledger
    of any length without spilling its text.
    """
    kept = [f for f in rows.schema.fields if f.name != "previous_hash"]
    prepared = (
        rows.repartitionByRange(width, "ledger_id", order)
        .sortWithinPartitions("ledger_id", order)
    )
    if build is not None:
        prepared = build(prepared)
    head = [rows.schema["ledger_id"], rows.schema[order]]
    packed = T.StructType(
        [T.StructField(f.name, f.dataType) for f in head]
        + [T.StructField("_nth", T.LongType()), T.StructField("_block", T.BinaryType())]
    )
    blocks = prepared.mapInArrow(_spell_and_pack(order, block_rows, [f.name for f in kept]), packed).withColumn("_seed", F.lit(None).cast("string"))
    if heads is not None:
        seeds = heads.select(
            "ledger_id",
            F.lit(_SEED_ORDER).cast(rows.schema[order].dataType).alias(order),
            F.lit(-1).cast("long").alias("_nth"),
            F.lit(None).cast("binary").alias("_block"),
            F.col("last_hash").alias("_seed"),
        )
        blocks = blocks.unionByName(seeds)
    out = T.StructType(
        kept + [T.StructField("previous_hash", T.StringType()), T.StructField("content_hash", T.StringType())]
    )
    # A fixed width: the fold is Python-bound, so AQE must not merge its tasks
    # by bytes.  Blocks that begin alike come from one range, which numbered them.
    return (
        blocks.repartition(width, "ledger_id")
        .sortWithinPartitions("ledger_id", order, "_nth")
        .mapInArrow(_fold, out)
    )


def _round_plan(events: DataFrame, order: str, round_rows: int) -> DataFrame:
    """(ledger, segment) -> round, from counts only."""
    width = max(1, min(SEGMENT_ROWS, round_rows))
    counts = with_segment(events, order, width).groupBy("ledger_id", "_segment").count()
    before = W.partitionBy("ledger_id").orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn(
        "_round",
        F.floor(F.coalesce(F.sum("count").over(before), F.lit(0)) / F.lit(round_rows)).cast("int"),
    ).drop("count")


def chain_build(
    events: DataFrame,
    order: str = "seq",
    heads: DataFrame | None = None,
    round_rows: int = ROUND_ROWS,
    build: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Append events to their ledgers: fills previous_hash and content_hash.

    ``events`` has ``ledger_id``, ``order`` and the body columns; ``heads`` has
    ``(ledger_id, last_hash)`` of ledgers that already hold events.

    With ``build``, ``events`` are narrow rows that it turns into events, keeping their columns.  It runs
    after the exchange that orders them, and the result has the narrow columns and the two hashes.

    Canonical text is made row by row in parallel and comes to its ledger in compressed
    blocks.  Ledgers are folded in parallel; one ledger longer than ``round_rows`` is folded in rounds, each
    written to the shared folder, so that no task ever holds a whole hot ledger
    and a lost executor costs at most one round.
    """
    longest, total = events.groupBy("ledger_id").count().agg(F.max("count"), F.sum("count")).first()
    longest, total = longest or 0, total or 0
    tasks = task_width(events.sparkSession, total)
    if longest <= round_rows:
        return _fold_round(events, heads, order, tasks, build=build)

    plan = materialize(_round_plan(events, order, round_rows), "chain-plan")
    width = max(1, min(SEGMENT_ROWS, round_rows))
    staged = materialize(
        with_segment(events, order, width)
        .join(plan, ["ledger_id", "_segment"])
        .drop("_segment"),
        "chain-rounds",
        partition_by="_round",
    )
    rounds = plan.agg(F.max("_round")).first()[0]
    spark = events.sparkSession
    target = scratch_path(spark, "chain")
    for number in range(rounds + 1):
        part = staged.where(F.col("_round") == number).drop("_round")
        folded = _fold_round(part, heads, order, tasks, build=build)
        path = f"{target}/round={number}"
        folded.write.parquet(path)
        heads = chain_heads(spark.read.parquet(path), order)
    return spark.read.parquet(target).drop("round").select(folded.columns)


def chain_heads(chained: DataFrame, order: str = "seq") -> DataFrame:
    """(ledger_id, last_hash, last_seq) of each ledger."""
    return chained.groupBy("ledger_id").agg(
        F.max_by("content_hash", order).alias("last_hash"), F.max(order).alias("last_seq")
    )


def chain_lines(chained: DataFrame, order: str = "seq") -> DataFrame:
    """Ledger lines of chained events."""
    return chained.withColumn(
        "value", C.stored_line(event_body(), F.col("previous_hash"), F.col("content_hash"))
    )


def write_ledger(
    events: DataFrame,
    path: str,
    order: str = "seq",
    compression: str = "none",
    spell: Callable[[DataFrame, str], DataFrame] = chain_lines,
) -> None:
    """Write ledgers as JSON lines: one folder per ledger, files in log order.

    With ``compression`` "gzip" the files are compressed; a scan reads both forms.

    Takes chained events, which ``spell`` gives their ``value``, or rows that already have it.  A range
    partition reads its input twice, so the input is a written table and lines
    are spelled after the exchange.  It also cuts a hot ledger into several
    files whose names keep log order.
    """
    width = task_width(events.sparkSession, events.count())
    placed = events.repartitionByRange(width, "ledger_id", order).sortWithinPartitions("ledger_id", order)
    if "value" not in events.columns:
        placed = spell(placed, order)
    placed.select("ledger_id", "value").write.partitionBy("ledger_id").text(path, compression=compression)


def chain_links(events: DataFrame, order: str = "seq", width: int = SEGMENT_ROWS) -> DataFrame:
    """Expected previous hash of every event and whether its link holds."""
    # Digests shuffle as bytes.
    hashes = ("previous_hash", "content_hash")
    linked = lag_value(
        events.withColumns({n: short_hash(F.col(n)) for n in hashes}),
        ["ledger_id"],
        order,
        F.col("content_hash"),
        "expected_previous_hash",
        width,
    )
    linked = linked.withColumns({n: long_hash(F.col(n)) for n in (*hashes, "expected_previous_hash")})
    return linked.withColumn(
        "link_ok", F.col("previous_hash").eqNullSafe(F.col("expected_previous_hash"))
    ).drop("expected_previous_hash_first")
