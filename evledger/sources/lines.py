"""Raw ledger text: lines, positions and per-line facts in one scan.

Spark cuts a file into splits.  One pass per split numbers its lines, measures
their bytes and (for ledgers) parses and hashes each line once.  The pass never
shuffles the text.  Positions become absolute, and links across split borders
are checked, through one small row per split.
"""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evledger.functions.canonical import event_facts, line_checks
from evledger.functions.text import long_hash, short_hash
from evledger.operators.segments import SEGMENT_BYTES, last_before
from evledger.schema import CHECK_FIELDS, FACTS_TYPE
from evledger.session import broadcast_if_small, materialize

_BOM = b"\xef\xbb\xbf"

_POSITION_FIELDS = [
    T.StructField("path", T.StringType()),
    T.StructField("block_start", T.LongType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("local_line", T.LongType()),
    T.StructField("local_start", T.LongType()),
    T.StructField("local_len", T.LongType()),
]
_CHECK_TYPES = {
    "kind": T.StringType(),
    "problem": T.StringType(),
    "schema_name": T.StringType(),
    "event_id": T.StringType(),
    "stored_hash": T.StringType(),
    "hash_ok": T.BooleanType(),
    "calculated_hash": T.StringType(),
    "link_ok": T.BooleanType(),
    "previous_hash": T.StringType(),
    "previous_is_text": T.BooleanType(),
    "expected_previous_hash": T.StringType(),
    "previous_event_id": T.StringType(),
}


def _check_lines(values: list[bytes], previous):
    """Check rows of consecutive lines of one split.

    ``previous`` is (stored hash, id) of the preceding event in the same
    split; the first event of a split leaves ``link_ok`` null, to be settled
    from the split before it.
    """
    rows = []
    for raw in values:
        kind, problem, schema, event_id, before, is_text, stored, calculated = line_checks(raw)
        if kind != "event":
            rows.append((kind, problem) + (None,) * 10)
            continue
        hash_ok = stored is not None and stored == calculated
        link_ok = None if previous is None else is_text and before == previous[0]
        sound = link_ok is True
        rows.append(
            (
                kind,
                None,
                schema,
                event_id,
                stored,
                hash_ok,
                None if hash_ok else calculated,
                link_ok,
                None if sound else before,
                None if sound else is_text,
                None if sound or previous is None else previous[0],
                None if sound or previous is None else previous[1],
            )
        )
        previous = (stored, event_id)
    return rows, previous


_EDGE = "edge"  # kind of the one row per split that sums it up


def _scan_pass(keep_value: bool, with_facts: bool, digest: bool):
    fields = list(_POSITION_FIELDS)
    if keep_value:
        fields.append(T.StructField("value", T.BinaryType()))
    if digest:
        fields.append(T.StructField("line_sha", T.BinaryType()))
        # Of the one edge row: its last line without newline, and its first and last with a byte order mark.
        fields.append(T.StructField("edge_sha", T.ArrayType(T.BinaryType())))
    if with_facts:
        fields += [T.StructField(n, t) for n, t in _CHECK_TYPES.items()]
        fields.append(T.StructField("events", T.LongType()))
    else:
        fields.append(T.StructField("kind", T.StringType()))
    schema = to_arrow_schema(T.StructType(fields))

    def batch_of(head, start_line, start_at, values):
        """Rows of one split piece, positions vectorised."""
        rows = len(values)
        size = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = np.cumsum(size)
        out = [pa.array([v] * rows, t.type) for v, t in zip(head, schema)]
        out += [pa.array(a) for a in (np.arange(rows) + start_line, ends - size + start_at, size)]
        if keep_value:
            out.append(values)
        if digest:
            shas = [sha256(v + b"\n").digest() for v in values.to_pylist()]
            out += [pa.array(shas, pa.binary()), pa.nulls(rows, schema.field("edge_sha").type)]
        return out, int(ends[-1])

    def run(batches):
        split, size, offset, line = None, None, 0, 0
        previous = first = None
        events = 0
        outer = [None, None]  # first and last line of the split

        def edge():
            """Totals of a finished split and its last event."""
            row = dict.fromkeys(schema.names)
            row.update(path=split[0], block_start=split[1], file_size=size)
            row.update(local_line=line, local_start=offset, local_len=0, kind=_EDGE)
            if digest:
                variants = (outer[1], _BOM + outer[0] + b"\n", _BOM + outer[1])
                row.update(edge_sha=[sha256(v).digest() for v in variants])
            if with_facts:
                row.update(events=events, problem=first, link_ok=previous is not None)
                if previous is not None:
                    row.update(stored_hash=previous[0], event_id=previous[1])
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            paths, blocks = batch.column("path"), batch.column("block_start")
            rows = batch.num_rows
            changes = pc.or_(
                pc.not_equal(paths.slice(1), paths.slice(0, rows - 1)),
                pc.not_equal(blocks.slice(1), blocks.slice(0, rows - 1)),
            ).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), rows]
            for begin, end in zip(cuts, cuts[1:]):
                here = (paths[begin].as_py(), blocks[begin].as_py())
                if here != split:
                    if split is not None:
                        yield edge()
                    split, size, offset, line = here, batch.column("file_size")[begin].as_py(), 0, 0
                    previous, first, events = None, None, 0
                    outer[0] = batch.column("value")[begin].as_py()
                outer[1] = batch.column("value")[end - 1].as_py()
                values = batch.column("value").slice(begin, end - begin)
                out, length = batch_of((*split, size), line, offset, values)
                if with_facts:
                    checks, previous = _check_lines(values.to_pylist(), previous)
                    columns = list(zip(*checks))
                    out += [
                        pa.array(list(c), schema.field(n).type) for c, n in zip(columns, _CHECK_TYPES)
                    ]
                    out.append(pa.nulls(len(values), pa.int64()))
                    events += columns[0].count("event")
                    if first is None:
                        first = next((h for h in columns[4] if h is not None), None)
                else:
                    out.append(pa.array(["line"] * len(values)))
                offset += length
                line += len(values)
                yield pa.RecordBatch.from_arrays(out, schema=schema)
        if split is not None:
            yield edge()

    return run, T.StructType(fields)


def read_text_splits(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """Raw lines with the file split they came from; only ``\\n`` ends a line."""
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.text(paths).select(
        F.col("value").cast("binary").alias("value"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        # How many bytes of text a compressed file holds is not known; it is one split.
        F.when(~F.col("_metadata.file_path").endswith(".gz"), F.col("_metadata.file_size")).alias("file_size"),
    )


def ledger_of_path(path: Column) -> Column:
    """Ledger name of a file: its ``ledger_id=`` folder, else the file stem."""
    named = F.regexp_extract(path, r"ledger_id=([^/]+)", 1)
    return F.coalesce(
        F.nullif(F.url_decode(named), F.lit("")), F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?\z", 1)
    )


class LedgerScan(NamedTuple):
    lines: DataFrame  # one row per physical line
    splits: DataFrame  # one row per file split: totals and last event


def scan_ledger(
    spark: SparkSession,
    paths: str | list[str],
    *,
    with_facts: bool = True,
    keep_value: bool = False,
    ledger: Column | None = None,
    glob: str | None = None,
    digest: bool = False,
) -> LedgerScan:
    """One pass over ledger text.

    Lines have ledger_id, path, line (from 1), byte_offset, byte_len,
    terminated and, on request, ``value``, the check columns and ``line_sha``, the SHA-256
    of the line's bytes with its newline.  A ledger
    kept as several files is read in path order as one log.  The pass is
    written once to the shared folder; everything that follows reads narrow
    columns of that table.
    """
    run, schema = _scan_pass(keep_value, with_facts, digest)
    staged = materialize(
        read_text_splits(spark, paths, glob)
        .mapInArrow(run, schema)
        .withColumn("ledger_id", ledger if ledger is not None else ledger_of_path(F.col("path"))),
        "scan",
    )
    is_edge = F.col("kind") == _EDGE
    columns = [
        "ledger_id",
        "path",
        "block_start",
        "file_size",
        F.col("local_line").alias("lines"),
        F.col("local_start").alias("bytes"),
    ]
    if digest:
        columns.append("edge_sha")
    if with_facts:
        columns += [
            "events",
            F.col("problem").alias("first_hash"),
            F.when(F.col("link_ok"), F.struct("stored_hash", "event_id")).alias("last_event"),
        ]
    splits = staged.where(is_edge).select(*columns)
    staged = staged.where(~is_edge).drop("edge_sha")
    in_file = W.partitionBy("ledger_id", "path")
    in_log = W.partitionBy("ledger_id").orderBy("path", "block_start")
    before = in_log.rowsBetween(W.unboundedPreceding, -1)
    over = F.sum("bytes").over(in_file) - F.col("file_size")
    splits = (
        # A compressed file is taken to end its last line and to have no byte order mark.
        splits.withColumn("_over", F.coalesce(over, F.lit(0)))
        .withColumn("_tail", F.col("block_start") == F.max("block_start").over(in_file))
        .withColumn("_head", F.col("block_start") == F.min("block_start").over(in_file))
        # A last line without newline was counted one byte too long; a byte
        # order mark was dropped by the reader.
        .withColumn("_open", F.col("_tail") & F.col("_over").isin(1, -2))
        .withColumn("_bom", F.when(F.col("_head") & (F.col("_over") < 0), F.lit(len(_BOM))).otherwise(0))
        .withColumn("_size", F.col("bytes") - F.col("_open").cast("long") + F.col("_bom"))
        .withColumn("line_base", F.coalesce(F.sum("lines").over(before), F.lit(0)))
        .withColumn("byte_base", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    )
    place = ["ledger_id", "path", "block_start", "lines", "line_base", "byte_base", "_open", "_bom"]
    if digest:
        place.append("edge_sha")
    keep = [*place, "_size"]
    if with_facts:
        splits = splits.withColumn("edge", F.last("last_event", ignorenulls=True).over(before))
        place.append("edge")
        keep += ["edge", "events", "first_hash", "last_event"]
    splits = materialize(splits.select(*keep), "splits")
    placed = staged.join(
        broadcast_if_small(splits.select(*place)), ["ledger_id", "path", "block_start"]
    )
    first_row = F.col("local_line") == 0
    last_row = F.col("local_line") == F.col("lines") - 1
    placed = (
        placed.withColumn("line", F.col("line_base") + F.col("local_line") + 1)
        .withColumn(
            "byte_offset",
            F.col("byte_base") + F.col("local_start") + F.when(first_row, 0).otherwise(F.col("_bom")),
        )
        .withColumn("terminated", ~(F.col("_open") & last_row))
        .withColumn(
            "byte_len",
            F.col("local_len")
            - F.when(F.col("terminated"), 0).otherwise(1)
            + F.when(first_row, F.col("_bom")).otherwise(0),
        )
    )
    columns = ["ledger_id", "path", "line", "byte_offset", "byte_len", "terminated"]
    if keep_value:
        placed = placed.withColumn(
            "value",
            F.when(first_row & (F.col("_bom") > 0), F.concat(F.lit(_BOM), F.col("value"))).otherwise(
                F.col("value")
            ),
        )
        columns.append("value")
    if digest:
        marked, opened = first_row & (F.col("_bom") > 0), ~F.col("terminated")
        sha = F.when(marked & opened, F.col("edge_sha")[2]).when(marked, F.col("edge_sha")[1])
        placed = placed.withColumn("line_sha", sha.when(opened, F.col("edge_sha")[0]).otherwise(F.col("line_sha")))
        columns.append("line_sha")
    if with_facts:
        # A byte order mark is not JSON: the line fails as it would unstripped.
        marked = first_row & (F.col("_bom") > 0) & (F.col("kind") == "event")
        opens = F.col("link_ok").isNull()
        expected = F.when(opens, F.col("edge.stored_hash")).otherwise(F.col("expected_previous_hash"))
        holds = F.col("previous_is_text") & F.col("previous_hash").eqNullSafe(F.col("edge.stored_hash"))
        placed = placed.select(
            *columns,
            F.when(marked, F.lit("invalid")).otherwise(F.col("kind")).alias("kind"),
            "problem",
            "schema_name",
            "event_id",
            "stored_hash",
            "hash_ok",
            "calculated_hash",
            F.when(opens, holds).otherwise(F.col("link_ok")).alias("link_ok"),
            "previous_hash",
            expected.alias("expected_previous_hash"),
            F.when(opens, F.col("edge.event_id")).otherwise(F.col("previous_event_id")).alias("previous_event_id"),
        )
        columns += list(CHECK_FIELDS)
    return LedgerScan(placed.select(*columns), splits)


def ledger_lines(spark: SparkSession, paths: str | list[str], ledger: Column | None = None) -> DataFrame:
    """Physical lines with line number, byte offset and raw bytes."""
    return scan_ledger(spark, paths, with_facts=False, keep_value=True, ledger=ledger).lines


def line_table(lines: DataFrame, columns: tuple[str, ...] = tuple(FACTS_TYPE.names)) -> DataFrame:
    """What each line of a ledger table says by itself, written once without its text.

    ``_same`` tells whether the hashes agree; the calculated one is kept only where they do not.
    """
    facts = lines.withColumn("_f", event_facts(F.col("value")))
    agrees = F.coalesce(F.col("_f.stored_hash") == F.col("_f.calculated_hash"), F.lit(False))
    own = [F.when(~agrees, F.col(f"_f.{n}")).alias(n) if n == "calculated_hash" else F.col(f"_f.{n}") for n in columns]
    return materialize(
        facts.select(*[c for c in lines.columns if c != "value"], *own, agrees.alias("_same")), "facts"
    )


def table_facts(lines: DataFrame, width: int = SEGMENT_BYTES, flat: DataFrame | None = None) -> DataFrame:
    """Line facts of a ledger table (ledger_id, line, byte_offset, byte_len, value).

    Hashing is row-wise; only the narrow facts shuffle for the link check, once, without the
    calculated hash where it is the stored one and with hashes as bytes.  ``flat`` is the
    `line_table` of ``lines``, where the caller reads that too.
    """
    flat = line_table(lines) if flat is None else flat
    names = [c for c in flat.columns if c != "_same"]
    event = F.col("kind") == "event"
    hashes = ("stored_hash", "previous_hash")
    linked = last_before(
        flat.withColumns({n: short_hash(F.col(n)) for n in hashes}),
        ["ledger_id"],
        "byte_offset",
        F.when(event, F.struct("stored_hash", "event_id")),
        "_prev",
        width,
    )
    before = F.struct(long_hash(F.col("_prev.stored_hash")).alias("stored_hash"), F.col("_prev.event_id").alias("event_id"))
    linked = linked.withColumns({n: long_hash(F.col(n)) for n in hashes})
    previous = F.when(event & F.col("_prev").isNotNull(), before)
    holds = F.col("previous_is_text") & F.col("previous_hash").eqNullSafe(F.col("_prev.stored_hash"))
    linked = (
        linked.withColumn("_prev", previous)
        .withColumn("calculated_hash", F.when(F.col("_same"), F.col("stored_hash")).otherwise(F.col("calculated_hash")))
        .withColumn("expected_previous_hash", F.col("_prev.stored_hash"))
        .withColumn("previous_event_id", F.col("_prev.event_id"))
        .withColumn("link_ok", F.when(event, holds))
        .withColumn("hash_ok", F.when(event, F.col("_same")))
    )
    return linked.select(*names, "expected_previous_hash", "previous_event_id", "link_ok", "hash_ok")


def read_events(lines: DataFrame) -> DataFrame:
    """Whole-ledger strict read: blank lines skipped, the first bad line raises."""
    facts = lines.withColumn("_f", event_facts(F.col("value")))
    bad = F.concat(
        F.lit("Invalid JSON in "), F.col("ledger_id"), F.lit(" line "), F.col("line").cast("string")
    )
    checked = F.when(F.col("_f.kind") == "invalid", F.raise_error(bad)).otherwise(F.col("_f.kind"))
    return (
        facts.withColumn("_kind", checked)
        .where(F.col("_kind") == "event")
        .select("ledger_id", "line", "byte_offset", F.col("value").cast("string").alias("event"))
    )


def first_event(lines: DataFrame) -> DataFrame:
    """First non-blank line of each ledger."""
    return _boundary(lines, F.min_by)


def last_event(lines: DataFrame, before_offset: int | None = None) -> DataFrame:
    """Last event of each ledger that ends at or before an offset."""
    if before_offset is not None:
        lines = lines.where(F.col("byte_offset") + F.col("byte_len") <= before_offset)
    return _boundary(lines, F.max_by)


def _boundary(lines: DataFrame, pick) -> DataFrame:
    full = lines.where(F.col("value").cast("string").rlike(r"\S"))
    return full.groupBy("ledger_id").agg(
        pick(F.struct("line", "byte_offset", "byte_len", "value"), F.col("byte_offset")).alias("_b")
    ).select("ledger_id", "_b.*")


def recent_events(lines: DataFrame, limit: int) -> DataFrame:
    """Last ``limit`` non-blank lines of each ledger."""
    full = lines.where(F.col("value").cast("string").rlike(r"\S"))
    newest = W.partitionBy("ledger_id").orderBy(F.desc("byte_offset"))

    def ranked(rows):
        return rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= limit).drop("_rank")

    # Offsets are ranked first, so that no task sorts text.  Lines without an offset come last.
    at = F.col("byte_offset")
    from_ = F.when(F.count_if(at.isNull()) == 0, F.min(at))
    starts = ranked(full.select("ledger_id", "byte_offset")).groupBy("ledger_id").agg(from_.alias("_from"))
    starts = broadcast_if_small(materialize(starts.withColumnRenamed("ledger_id", "_of"), "recent"))
    near = full.join(starts, full["ledger_id"].eqNullSafe(F.col("_of")) & (F.col("_from").isNull() | (at >= F.col("_from"))))
    return ranked(near.drop("_of", "_from"))
