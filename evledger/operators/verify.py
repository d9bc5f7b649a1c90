"""Ledger verification: errors, breakpoints and one summary row per ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evledger import schema as S
from evledger.functions import text as X
from evledger.operators.digest import scanned_digest
from evledger.operators.segments import later_copies
from evledger.session import broadcast_if_small, materialize
from evledger.sources.lines import ledger_of_path, scan_ledger
from evledger.sources.tail import plain_path

# Message of each error code.
MESSAGES = {
    S.INVALID_JSON: "event line is not a valid UTF-8 JSON object: ",
    S.SCHEMA_MISMATCH: "expected schema ",
    S.MISSING_EVENT_ID: "event_id is missing",
    S.DUPLICATE_EVENT_ID: "event_id is duplicated",
    S.PREVIOUS_HASH_MISMATCH: "previous_hash does not match the preceding content_hash",
    S.CONTENT_HASH_MISMATCH: "stored content_hash does not match the canonical event hash",
    S.LEDGER_CHANGED: "ledger changed while the read-only verification snapshot was scanned",
}

# Check order within one line.
_RANK = {
    S.INVALID_JSON: 0,
    S.SCHEMA_MISMATCH: 1,
    S.MISSING_EVENT_ID: 2,
    S.DUPLICATE_EVENT_ID: 2,
    S.PREVIOUS_HASH_MISMATCH: 3,
    S.CONTENT_HASH_MISMATCH: 4,
}

_DETAILS = (
    "event_id",
    "previous_event_id",
    "expected_previous_hash",
    "actual_previous_hash",
    "content_hash",
    "stored_content_hash",
    "calculated_content_hash",
)


def _error(code: str, message: Column | None = None, **details: Column) -> Column:
    text = message if message is not None else F.lit(MESSAGES[code])
    return F.struct(
        F.lit(_RANK[code]).alias("rank"),
        F.lit(code).alias("code"),
        text.alias("message"),
        *[details.get(name, F.lit(None).cast("string")).alias(name) for name in _DETAILS],
    )


def line_errors(facts: DataFrame, namespace: str = S.NAMESPACE) -> DataFrame:
    """Errors that one line and its predecessor decide, one row per error."""
    expected_schema = S.schema_id(S.EVENT, namespace)
    event = F.col("kind") == "event"
    stored = X.safe_hash(F.col("stored_hash"))
    checks = [
        (
            F.col("kind") == "invalid",
            _error(
                S.INVALID_JSON,
                F.concat(
                    F.lit(MESSAGES[S.INVALID_JSON]), F.coalesce("problem", F.lit("byte order mark"))
                ),
            ),
        ),
        (
            event & ~F.col("schema_name").eqNullSafe(F.lit(expected_schema)),
            _error(S.SCHEMA_MISMATCH, F.lit(MESSAGES[S.SCHEMA_MISMATCH] + expected_schema)),
        ),
        (event & F.col("event_id").isNull(), _error(S.MISSING_EVENT_ID)),
        (
            event & ~F.col("link_ok"),
            _error(
                S.PREVIOUS_HASH_MISMATCH,
                event_id=F.col("event_id"),
                previous_event_id=F.col("previous_event_id"),
                expected_previous_hash=X.safe_hash(F.col("expected_previous_hash")),
                actual_previous_hash=X.safe_hash(F.col("previous_hash")),
                content_hash=stored,
            ),
        ),
        (
            event & ~F.col("hash_ok"),
            _error(
                S.CONTENT_HASH_MISMATCH,
                event_id=F.col("event_id"),
                stored_content_hash=stored,
                calculated_content_hash=F.col("calculated_hash"),
            ),
        ),
    ]
    # Clean lines, nearly all of them, drop out before any error is built.
    any_error = checks[0][0]
    for condition, _ in checks[1:]:
        any_error = any_error | condition
    errors = F.array_compact(F.array(*[F.when(c, e) for c, e in checks]))
    return facts.where(any_error).select(
        "ledger_id", "line", "byte_offset", F.inline(errors)
    )


def duplicate_ids(facts: DataFrame) -> DataFrame:
    """Second and later occurrences of an event id within a ledger."""
    ids = facts.where((F.col("kind") == "event") & F.col("event_id").isNotNull()).select(
        "ledger_id", "event_id", "line", "byte_offset"
    )
    return later_copies(ids, ["ledger_id", "event_id"], "byte_offset")


def verify_errors(facts: DataFrame, namespace: str = S.NAMESPACE, flat: DataFrame | None = None) -> DataFrame:
    """All error rows; sort by (ledger_id, line, rank) for report order.

    ``flat`` has the same lines before their links were found, where that is a written table.
    """
    lines = line_errors(facts, namespace)
    copies = duplicate_ids(facts if flat is None else flat).select(
        "ledger_id",
        "line",
        "byte_offset",
        F.lit(_RANK[S.DUPLICATE_EVENT_ID]).alias("rank"),
        F.lit(S.DUPLICATE_EVENT_ID).alias("code"),
        F.lit(MESSAGES[S.DUPLICATE_EVENT_ID]).alias("message"),
        "event_id",
    )
    return lines.unionByName(copies, allowMissingColumns=True)


def verify_breakpoints(errors: DataFrame) -> DataFrame:
    return errors.where(F.col("code") == S.PREVIOUS_HASH_MISMATCH).select(
        "ledger_id", *[f.name for f in S.BREAKPOINT_TYPE.fields]
    )


def error_codes(errors: DataFrame) -> DataFrame:
    """Sorted distinct codes that forbid sealing, per ledger."""
    fatal = errors.where(F.col("code") != S.PREVIOUS_HASH_MISMATCH)
    return fatal.groupBy("ledger_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def seal_gate(errors: DataFrame) -> DataFrame:
    """Ledgers that may not be sealed, with the refusal message."""
    return error_codes(errors).select(
        "ledger_id",
        F.concat(
            F.lit("ledger has non-archivable integrity errors: "), F.array_join("codes", ", ")
        ).alias("message"),
    )


def verify_summary(facts: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per ledger: counts, boundary hashes and validity."""
    event = F.col("kind") == "event"
    at = F.when(event, F.col("byte_offset"))
    named = F.when(event & X.optional_text(F.col("stored_hash")).isNotNull(), F.col("byte_offset"))
    # Numbers first, in a hash aggregate; then the two boundary rows by position.
    scanned = materialize(
        facts.groupBy("ledger_id").agg(
            F.count_if(event).alias("event_count"),
            F.sum("byte_len").alias("byte_size"),
            F.min(named).alias("_first_at"),
            F.max(at).alias("_last_at"),
        ),
        "ledger-sizes",
    )
    edges = broadcast_if_small(scanned.select("ledger_id", "_first_at", "_last_at"))
    bounds = (
        facts.select("ledger_id", "byte_offset", "stored_hash", "event_id")
        .join(edges, "ledger_id")
        .where((F.col("byte_offset") == F.col("_first_at")) | (F.col("byte_offset") == F.col("_last_at")))
        .groupBy("ledger_id")
        .agg(
            F.max(F.when(F.col("byte_offset") == F.col("_first_at"), F.col("stored_hash"))).alias("_first"),
            F.max(F.when(F.col("byte_offset") == F.col("_last_at"), F.col("event_id"))).alias("last_event_id"),
            F.max(F.when(F.col("byte_offset") == F.col("_last_at"), F.col("stored_hash"))).alias("_last"),
        )
    )
    totals = scanned.join(bounds, "ledger_id", "left").withColumnsRenamed(
        {"_first": "first_hash", "_last": "last_hash"}
    )
    return _summary(totals, errors)


def _summary(totals: DataFrame, errors: DataFrame) -> DataFrame:
    broken = errors.groupBy("ledger_id").agg(
        F.count(F.lit(1)).alias("error_count"),
        F.count_if(F.col("code") == S.PREVIOUS_HASH_MISMATCH).alias("breakpoint_count"),
    )
    zero = F.lit(0).cast("long")
    return totals.join(broken, "ledger_id", "left").select(
        "ledger_id",
        "event_count",
        "byte_size",
        X.safe_hash(F.col("first_hash")).alias("first_content_hash"),
        "last_event_id",
        X.safe_hash(F.col("last_hash")).alias("last_content_hash"),
        F.coalesce("error_count", zero).alias("error_count"),
        F.coalesce("breakpoint_count", zero).alias("breakpoint_count"),
        F.col("error_count").isNull().alias("valid"),
    )


def split_totals(splits: DataFrame) -> DataFrame:
    """Ledger totals from the split table of a scan, a few rows per file."""
    at = F.struct("path", "block_start")
    return splits.groupBy("ledger_id").agg(
        F.sum("events").alias("event_count"),
        F.sum("_size").alias("byte_size"),
        F.min_by("first_hash", F.when(F.col("first_hash").isNotNull(), at)).alias("first_hash"),
        F.max_by("last_event.event_id", F.when(F.col("last_event").isNotNull(), at)).alias("last_event_id"),
        F.max_by("last_event.stored_hash", F.when(F.col("last_event").isNotNull(), at)).alias("last_hash"),
    )


def file_versions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Size and modification time of each ledger file, content not read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")


def verify_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose size or time differ between two listings, as error rows."""
    old, new = before.alias("old"), after.alias("new")
    same = F.col("old.length").eqNullSafe(F.col("new.length")) & F.col(
        "old.modificationTime"
    ).eqNullSafe(F.col("new.modificationTime"))
    return (
        old.join(new, "path", "full_outer")
        .where(~same)
        .select("path", F.lit(S.LEDGER_CHANGED).alias("code"), F.lit(MESSAGES[S.LEDGER_CHANGED]).alias("message"))
    )


def verify_ledger_id(
    ledgers: DataFrame, manifests: DataFrame | None = None, states: DataFrame | None = None
) -> DataFrame:
    """Known id of each ledger: manifest, then state, then derived from content.

    ``ledgers`` has (path, snapshot_sha256); the others have (path, ledger_id).
    """
    out = ledgers
    known = []
    for name, table in (("_manifest", manifests), ("_state", states)):
        if table is not None:
            safe = X.safe_identifier(F.col("ledger_id"))
            usable = F.when(~safe.startswith("invalid_identifier_sha256:"), safe)
            out = out.join(table.select("path", usable.alias(name)), "path", "left")
            known.append(F.col(name))
    derived = X.derived_ledger_id(F.col("path"), F.col("snapshot_sha256"))
    return out.select("path", "snapshot_sha256", F.coalesce(*known, derived).alias("ledger_id"))


def verify_ledger(
    spark: SparkSession,
    paths: str | list[str],
    namespace: str = S.NAMESPACE,
    ledger: Column | None = None,
    manifests: DataFrame | None = None,
    states: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Verify ledger text: (summary, errors).

    The listing is taken before and after the scan; a file that changed in
    between adds an error to its ledger.  The summary also has the first file of
    each ledger, the digest of its bytes, made in the same scan, and the id that it is known by:
    from ``manifests`` or ``states`` (path, ledger_id), else derived from its content.
    """
    before = materialize(file_versions(spark, paths), "listing")
    scan = scan_ledger(spark, paths, ledger=ledger, digest=True)
    errors = verify_errors(scan.lines, namespace)
    after = materialize(file_versions(spark, paths), "listing")
    name = ledger if ledger is not None else ledger_of_path(F.col("path"))
    changed = verify_changed(before, after).withColumn("ledger_id", name)
    errors = errors.unionByName(
        changed.select("ledger_id", "code", "message").distinct(), allowMissingColumns=True
    )
    errors = materialize(errors, "errors")
    summary = _summary(split_totals(scan.splits), errors)
    places = scan.splits.groupBy("ledger_id").agg(plain_path(F.min("path")).alias("path"))
    found = places.join(scanned_digest(scan.lines).withColumnRenamed("sha256", "snapshot_sha256"), "ledger_id")
    # One row a ledger: paths lead to the known ids and back to the ledger's name here.
    known = verify_ledger_id(found.drop("ledger_id"), manifests, states)
    known = known.select("path", "snapshot_sha256", F.col("ledger_id").alias("known_id"))
    identity = found.select("ledger_id", "path").join(known, "path")
    return summary.join(identity, "ledger_id", "left"), errors
