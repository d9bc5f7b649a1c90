"""Capture of growing files: poll, parse, policy, chained append, then the state.

One call of `capture_once` takes what the sources of a ledger gained since the saved
state.  The state is saved after the append and its version names the batch, so a
crash in between repeats the batch with the same ids and replaces its output.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evledger import positions
from evledger import schema as S
from evledger.operators.policy import CapturePolicy
from evledger.schema import DEFAULT_BATCH_BYTES
from evledger.session import broadcast_if_small, materialize
from evledger.sources import tail as L
from evledger.sources import transcripts as A
from evledger.sources.growing import line_stream
from evledger.streaming.live import append_batch, ledger_heads

Parser = Callable[..., DataFrame]
Change = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class SourceSpec:
    """Where a source keeps its files and how their lines become events.

    ``layout`` is the regular expression of paths below ``root``; ``parse`` takes
    lines (path, byte_offset, generation, part, text) and ``keep``, the columns to
    leave on the events.  ``header`` marks the lines whose newest carries over to
    later polls, so that it holds for lines that come without it.
    """

    name: str
    root: str
    parse: Parser
    layout: str = r".*\.jsonl"
    header: Callable[[DataFrame], DataFrame] | None = None
    glob: str = "*.jsonl"
    options: dict = field(default_factory=dict)


def codex_headers(lines: DataFrame) -> DataFrame:
    kind = F.try_variant_get(F.try_parse_json("text"), "$.type", "string")
    return lines.where(kind == "session_meta")


def claude_code(root: str, **options) -> SourceSpec:
    """One folder a project, session files in it."""
    return SourceSpec("claude-code", root, A.claude_code_turns, r"[^/]+/[^/]+\.jsonl", options=options)


def codex(root: str, **options) -> SourceSpec:
    """Session files at any depth, each led by its session header."""
    return SourceSpec("codex", root, A.codex_turns, r".*\.jsonl", codex_headers, options=options)


def cursor(root: str, **options) -> SourceSpec:
    """Files below a project's folder of agent transcripts."""
    layout = r"[^/]+/agent-transcripts/(?:.*/)?[^/]+\.jsonl"
    return SourceSpec("cursor", root, A.cursor_turns, layout, options={"root": root} | options)


_PLACE = ("path", "generation", "byte_offset", "part")


def poll_source(
    spark: SparkSession, spec: SourceSpec, state: DataFrame, *, backfill: bool = False, max_bytes: int = DEFAULT_BATCH_BYTES
) -> tuple[DataFrame, DataFrame]:
    """New events of a source (with their place) and its next state."""
    first_run = state.where(F.col("tailer") == spec.name).isEmpty()
    pieces, after = L.poll(
        spark, spec.root, state, spec.name, glob=spec.glob, layout=spec.layout, backfill=backfill, max_bytes=max_bytes
    )
    pieces, after = materialize(pieces, "pieces"), materialize(after, "state")
    if spec.header is not None:
        if first_run and not backfill:
            # Text before the baseline is skipped, but its first line names the session.
            paths = after.where(F.col("offset") > 0)
            opening = L.changed_lines(spark, spec.root, paths.select("path", F.col("offset").alias("size"), F.lit(0).alias("start")), spec.glob)
            opening = opening.where(F.col("byte_offset") == 0)
            opening = opening.select("path", F.make_valid_utf8(F.col("value").cast("string")).alias("text"))
            first = spec.header(opening).select("path", F.col("text").alias("_meta"))
            after = after.join(first, "path", "left").withColumn("meta", F.coalesce("meta", "_meta")).drop("_meta")
            after = materialize(after, "state")
        # The carried header comes before all new lines of its file.
        carried = after.where(F.col("meta").isNotNull()).join(pieces.select("path").distinct(), "path", "left_semi")
        carried = carried.select(
            "path", F.lit(-1).cast("long").alias("byte_offset"), "generation", F.lit(0).alias("part"), F.col("meta").alias("text")
        )
        newest = spec.header(pieces).groupBy("path").agg(
            F.max_by("text", F.struct("byte_offset", "part")).alias("_meta")
        )
        after = after.join(newest, "path", "left").withColumn("meta", F.coalesce("_meta", "meta")).drop("_meta")
        pieces = pieces.unionByName(carried)
    events = spec.parse(pieces, keep=_PLACE, **spec.options)
    return events, after.select("tailer", "path", "offset", "generation", "meta")


def in_order(rows: DataFrame, order: list[str], last: int = 0) -> DataFrame:
    """``rows`` with ``seq`` counting from ``last + 1`` in the given order.

    Rows are sorted by range; partitions count on their own and start where those
    before end, so no task holds them all.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_id", F.monotonically_increasing_id()), "captured")
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    bases = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    seq = F.lit(last + 1) + F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.join(broadcast_if_small(bases), part == F.col("_part"))
    return joined.select(seq.alias("seq"), *rows.columns)


def _append_in_order(
    events: DataFrame, batch: int, ledger: str, ledger_id: str, policy: CapturePolicy | None, namespace: str
) -> None:
    """Number the events of a batch after those before it and append them."""
    heads = ledger_heads(events.sparkSession, ledger, batch)
    last = None if heads is None else heads.where(F.col("ledger_id") == ledger_id).first()
    numbered = in_order(events.withColumn("ledger_id", F.lit(ledger_id)), ["source", *_PLACE], last["last_seq"] if last else 0)
    append_batch(numbered.drop(*_PLACE), batch, ledger, policy=policy, namespace=namespace)


def capture_once(
    spark: SparkSession,
    specs: list[SourceSpec],
    state_path: str,
    ledger: str,
    *,
    ledger_id: str = "ledger",
    policy: CapturePolicy | None = None,
    change: Change | None = None,
    backfill: bool = False,
    max_bytes: int = DEFAULT_BATCH_BYTES,
    namespace: str = S.NAMESPACE,
) -> DataFrame:
    """Append what the sources gained to one ledger; returns the appended events.

    ``change`` is any DataFrame step on the envelopes before the policy: it may drop,
    rewrite or add events.  Events are chained by source, file and place.
    """
    state, version = L.load_source_state(spark, state_path)
    events, states = None, []
    for spec in specs:
        found, after = poll_source(spark, spec, state, backfill=backfill, max_bytes=max_bytes)
        events = found if events is None else events.unionByName(found)
        states.append(after)
    if change is not None:
        events = change(events)
    _append_in_order(events, version, ledger, ledger_id, policy, namespace)
    after = states[0]
    for more in states[1:]:
        after = after.unionByName(more)
    others = state.where(~F.col("tailer").isin([s.name for s in specs]))
    L.save_source_state(after.unionByName(others, allowMissingColumns=True), state_path)
    return spark.read.parquet(f"{ledger}/events/batch={version}")


def _with_headers(spec: SourceSpec, pieces: DataFrame, kept: str, batch: int) -> DataFrame:
    """Lines of a batch with the header that their file carries from earlier batches.

    Opening lines (part -1) give the header of a file whose beginning was not captured.  The
    newest header of each file is kept for later batches.
    """
    spark = pieces.sparkSession
    lines = pieces.where("part >= 0")
    place = F.struct("generation", "byte_offset", "part")
    newest = lambda rows: spec.header(rows).groupBy("path").agg(F.max_by("text", place).alias("meta"))
    known = positions.newest(spark, kept, batch, "path")
    opening = newest(pieces.where("part < 0"))
    carried = opening if known is None else known.unionByName(opening.join(known, "path", "left_anti"))
    carried = materialize(carried.join(pieces.select("path").distinct(), "path", "left_semi"), "headers")
    fresh = newest(lines)
    positions.put(fresh.unionByName(carried.join(fresh, "path", "left_anti")), kept, batch, "path")
    generations = lines.groupBy("path").agg(F.max("generation").alias("generation"))
    before = carried.join(generations, "path").select(
        "path", F.lit(-1).cast("long").alias("byte_offset"), "generation", F.lit(0).alias("part"), F.col("meta").alias("text")
    )
    return lines.unionByName(before)


def capture_stream(
    spark: SparkSession,
    specs: list[SourceSpec],
    ledger: str,
    checkpoint: str,
    *,
    ledger_id: str = "ledger",
    policy: CapturePolicy | None = None,
    change: Change | None = None,
    backfill: bool = False,
    max_bytes: int = DEFAULT_BATCH_BYTES,
    once: bool = False,
    namespace: str = S.NAMESPACE,
) -> StreamingQuery:
    """`capture_once` as a stream: growing files of several sources into one ledger.

    Places are in the checkpoint, headers and heads in tables by batch; a batch that is
    repeated after a crash reads the same ranges, mints the same ids and replaces its output.
    """
    lines = None
    for spec in specs:
        found = line_stream(
            spark, spec.root, f"{checkpoint}/places-{spec.name}", glob=spec.glob, layout=spec.layout, backfill=backfill, max_bytes=max_bytes
        ).withColumn("tailer", F.lit(spec.name))
        lines = found if lines is None else lines.unionByName(found)

    def append(rows: DataFrame, batch: int) -> None:
        rows = materialize(rows, "lines")
        events = None
        for spec in specs:
            pieces = rows.where(F.col("tailer") == spec.name).drop("tailer")
            if spec.header is not None:
                pieces = _with_headers(spec, pieces, f"{ledger}/headers-{spec.name}", batch)
            found = spec.parse(pieces.where("part >= 0"), keep=_PLACE, **spec.options)
            events = found if events is None else events.unionByName(found)
        if change is not None:
            events = change(events)
        _append_in_order(events, batch, ledger, ledger_id, policy, namespace)

    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)
    writer = writer.queryName(f"capture-{zlib.crc32(ledger.encode()):08x}")
    return (writer.trigger(availableNow=True) if once else writer).start()
