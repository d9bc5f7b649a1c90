"""Sealed archives: freeze verified ledgers, pin them, and query them later.

A seal works on any number of ledgers in one job.  It writes the lines, the
breakpoints and the verification report first and the manifest last: readers
trust only ledgers that have a manifest, so a job that dies midway leaves
files nobody reads.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evledger import schema as S
from evledger.functions import text as X
from evledger.operators import digest as D
from evledger.operators import read as R
from evledger.operators import verify as V
from evledger.operators.chain import chain_build, chain_lines
from evledger.operators.envelope import build_event
from evledger.session import broadcast_if_small, materialize, task_width
from evledger.sources.lines import line_table, table_facts

# Facts of a line that its verification reads; the routing fields are left out.
_VERIFIED = (
    "kind",
    "problem",
    "schema_name",
    "event_id",
    "previous_hash",
    "previous_is_text",
    "stored_hash",
    "calculated_hash",
)


class SealedArchiveError(RuntimeError):
    """An active-ledger call on a sealed ledger, or a damaged archive."""


class LedgerNotSealableError(RuntimeError):
    """Integrity errors that an archive may not carry."""


class LedgerAlreadySealedError(RuntimeError):
    """Another seal of the ledger was committed first."""


# -- digests -----------------------------------------------------------------


def snapshot_digest(lines: DataFrame) -> DataFrame:
    """(ledger_id, sha256) over the exact bytes of each ledger."""
    digest = D.line_digest(F.col("value"), F.col("terminated")).alias("digest")
    return D.tree_digest(lines.select("ledger_id", F.col("byte_offset").alias("at"), digest))


def breakpoint_digest(breakpoints: DataFrame) -> DataFrame:
    """(ledger_id, sha256) over the breakpoint rows of each ledger."""
    fields = [f.name for f in S.BREAKPOINT_TYPE.fields]
    digest = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256).alias("digest")
    return D.tree_digest(breakpoints.select("ledger_id", F.col("byte_offset").alias("at"), digest))


_empty_digest = D.empty_digest


# -- documents ---------------------------------------------------------------


def verify_reports(
    summary: DataFrame, sealed_at: str, active: str, archive: str, namespace: str = S.NAMESPACE
) -> DataFrame:
    """(ledger_id, report): the verification report document of each ledger."""
    body = F.struct(
        F.lit(S.schema_id(S.ARCHIVE_VERIFY_REPORT, namespace)).alias("schema_version"),
        F.lit(sealed_at).alias("generated_at"),
        F.lit(active).alias("active_ledger"),
        F.lit(archive).alias("archive_ledger"),
        F.lit(True).alias("seal_eligible"),
        F.array(F.lit(S.PREVIOUS_HASH_MISMATCH)).alias("accepted_error_codes"),
        F.struct(*[c for c in summary.columns if c != "schema_version"]).alias("verification"),
    )
    return summary.select("ledger_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def archive_ids(ledger_id: Column, sealed_at: Column) -> Column:
    return F.concat(
        F.lit("archive_"), F.left(F.sha2(F.concat_ws("\0", ledger_id, sealed_at), 256), F.lit(32))
    )


_LIST = (
    "schema_version string, generated_at string, archive_id string, ledger_id string, ledger_sha256 string,"
    " byte_size bigint, count bigint, rows_sha256 string"
)


def breakpoint_lists(
    summary: DataFrame, digests: DataFrame, breakpoint_digests: DataFrame, sealed_at: str, namespace: str = S.NAMESPACE
) -> DataFrame:
    """(ledger_id, document): the head of each ledger's breakpoint list.

    The list itself stays a table, however long; the head pins its count and the digest
    of its rows, beside the size and digest of the ledger it belongs to.
    """
    rows = (
        summary.select("ledger_id", "byte_size", "breakpoint_count")
        .join(digests.withColumnRenamed("sha256", "_sha"), "ledger_id")
        .join(breakpoint_digests.withColumnRenamed("sha256", "_bp"), "ledger_id", "left")
    )
    body = F.struct(
        F.lit(S.schema_id(S.BREAKPOINT_LIST, namespace)).alias("schema_version"),
        F.lit(sealed_at).alias("generated_at"),
        archive_ids(F.col("ledger_id"), F.lit(sealed_at)).alias("archive_id"),
        "ledger_id",
        F.col("_sha").alias("ledger_sha256"),
        "byte_size",
        F.col("breakpoint_count").alias("count"),
        F.coalesce("_bp", _empty_digest()).alias("rows_sha256"),
    )
    return rows.select("ledger_id", F.to_json(body).alias("document"))


def manifests(
    summary: DataFrame,
    digests: DataFrame,
    reports: DataFrame,
    lists: DataFrame,
    sealed_at: str,
    active: str,
    archive: str,
    namespace: str = S.NAMESPACE,
) -> DataFrame:
    """(ledger_id, archive_id, manifest, manifest_sha256): one document each."""
    rows = (
        summary.join(digests.withColumnRenamed("sha256", "_sha"), "ledger_id")
        .join(reports.select("ledger_id", F.sha2("report", 256).alias("_report")), "ledger_id")
        .join(lists.select("ledger_id", F.sha2("document", 256).alias("_bp")), "ledger_id")
        .withColumn("archive_id", archive_ids(F.col("ledger_id"), F.lit(sealed_at)))
    )
    path = F.concat(F.lit(f"{archive}/lines/ledger_id="), F.col("ledger_id"))
    body = F.struct(
        F.lit(S.schema_id(S.ARCHIVE_MANIFEST, namespace)).alias("schema_version"),
        "archive_id",
        F.lit(sealed_at).alias("sealed_at"),
        F.lit(active).alias("source_active_ledger"),
        F.struct(
            path.alias("path"),
            F.col("ledger_id"),
            "byte_size",
            F.col("_sha").alias("sha256"),
            "event_count",
            "first_content_hash",
            "last_event_id",
            "last_content_hash",
        ).alias("archive"),
        F.struct(
            F.lit(f"{archive}/reports").alias("path"),
            F.col("_report").alias("sha256"),
            F.col("valid").alias("valid_without_breakpoint_policy"),
            "error_count",
            F.col("breakpoint_count").alias("accepted_breakpoint_count"),
            F.lit(0).cast("long").alias("fatal_error_count"),
        ).alias("verification"),
        F.struct(
            F.lit(f"{archive}/breakpoint_lists").alias("path"),
            F.col("_bp").alias("sha256"),
            F.col("breakpoint_count").alias("count"),
        ).alias("breakpoints"),
        F.lit(None).cast("string").alias("state_sidecar"),
        F.lit("sealed_read_only").alias("append_policy"),
        F.lit("explicit_archive_only").alias("query_policy"),
    )
    text = F.to_json(body, {"ignoreNullFields": "false"})
    return rows.select("ledger_id", "archive_id", text.alias("manifest")).withColumn(
        "manifest_sha256", F.sha2("manifest", 256)
    )


_MANIFEST = (
    "schema_version string, archive_id string, sealed_at string, source_active_ledger string,"
    " archive struct<path: string, ledger_id: string, byte_size: bigint, sha256: string,"
    " event_count: bigint, first_content_hash: string, last_event_id: string, last_content_hash: string>,"
    " verification struct<path: string, sha256: string, error_count: bigint,"
    " accepted_breakpoint_count: bigint, fatal_error_count: bigint>,"
    " breakpoints struct<path: string, sha256: string, count: bigint>"
)


def registry_entries(manifest_rows: DataFrame, manifest_path: str) -> DataFrame:
    """The 11-field registry entry of each manifest: rebuildable at any time."""
    m = F.from_json("manifest", _MANIFEST)
    return manifest_rows.withColumn("m", m).select(
        F.col("m.archive_id").alias("archive_id"),
        F.col("m.archive.path").alias("archive_path"),
        F.lit(manifest_path).alias("manifest_path"),
        "manifest_sha256",
        F.col("m.sealed_at").alias("sealed_at"),
        F.col("m.archive.ledger_id").alias("ledger_id"),
        F.col("m.archive.byte_size").alias("byte_size"),
        F.col("m.archive.sha256").alias("ledger_sha256"),
        F.col("m.archive.event_count").alias("event_count"),
        F.col("m.breakpoints.count").alias("breakpoint_count"),
        F.lit("sealed_read_only").alias("status"),
    )


def registry_union(registry: DataFrame, entries: DataFrame) -> DataFrame:
    return registry.unionByName(entries)


def transition_events(
    manifest_rows: DataFrame,
    sealed_at: str,
    *,
    project: Column | None = None,
    cwd: str = "",
    namespace: str = S.NAMESPACE,
) -> DataFrame:
    """First event of each new ledger, pinning the archive it follows."""
    rows = manifest_rows.withColumn("m", F.from_json("manifest", _MANIFEST))
    # The manifests lie beside the reports, in the archive's own folder.
    manifest_path = F.concat(F.regexp_replace("m.verification.path", r"/[^/]+\z", ""), F.lit("/manifests"))
    payload = F.to_json(
        F.struct(
            F.lit(S.schema_id(S.LEDGER_TRANSITION, namespace)).alias("schema_version"),
            F.lit("sealed_archive").alias("transition"),
            "archive_id",
            F.struct(
                F.col("m.archive.path").alias("path"),
                F.col("m.archive.ledger_id").alias("ledger_id"),
                F.col("m.archive.sha256").alias("sha256"),
                F.col("m.archive.byte_size").alias("byte_size"),
            ).alias("archive_ledger_ref"),
            F.struct(manifest_path.alias("path"), F.col("manifest_sha256").alias("sha256")).alias("archive_manifest_ref"),
            F.col("m.breakpoints.count").alias("breakpoint_count"),
        ),
        {"ignoreNullFields": "false"},
    )
    events = build_event(
        rows.withColumn(
            "new_ledger_id",
            F.concat(F.lit("ledger_"), F.left(F.sha2(F.concat("archive_id", "manifest_sha256"), 256), F.lit(32))),
        ).withColumn("seq", F.lit(0).cast("long")),
        source=F.lit(namespace),
        event_type=F.lit("ledger_transition"),
        event_id=X.event_id(F.lit("transition"), F.col("archive_id")),
        ts=F.lit(sealed_at),
        project=project if project is not None else F.lit("ledgers"),
        cwd=F.lit(cwd),
        summary=F.lit("Started a new active ledger after sealing the previous ledger."),
        tags=F.array(F.lit("ledger"), F.lit("transition"), F.lit("sealed-archive")),
        payload=payload,
        keep=("new_ledger_id", "seq"),
        namespace=namespace,
    )
    return chain_build(events.withColumnRenamed("new_ledger_id", "ledger_id"))


# -- seal --------------------------------------------------------------------


def seal(
    lines: DataFrame,
    archive: str,
    *,
    sealed_at: str,
    active: str = "",
    strict: bool = True,
    namespace: str = S.NAMESPACE,
) -> DataFrame:
    """Seal every ledger of ``lines``; returns their manifest rows.

    Only breaks in the previous-hash chain may enter an archive, and each is
    recorded.  With ``strict`` any other error stops the whole call before
    anything is written; otherwise the refused ledgers stay active.
    """
    spark = lines.sparkSession
    # Each line is digested as it is verified; the frozen copy is held against that below.
    digested = lines.withColumn("line_sha", F.unhex(D.line_digest(F.col("value"), F.col("terminated"))))
    # Only the errors need the links; the digests and sums read the lines' own facts.
    facts = line_table(digested, _VERIFIED)
    errors = materialize(V.verify_errors(table_facts(digested, flat=facts), namespace, facts), "seal-errors")
    refused = V.seal_gate(errors)
    first = refused.orderBy("ledger_id").first()
    if first is not None and strict:
        raise LedgerNotSealableError(first["message"])
    sealed = lines
    if first is not None:
        refused = broadcast_if_small(refused.select("ledger_id"))
        sealed = lines.join(refused, "ledger_id", "left_anti")
        facts = facts.join(refused, "ledger_id", "left_anti")
        errors = errors.join(refused, "ledger_id", "left_anti")

    # Range partitioning by (ledger, offset) splits a hot ledger over files
    # and gives offset reads row groups they can skip.  Its width follows the rows, so that
    # no task sorts more text as ledgers grow, whatever shuffle width the session has.
    width = task_width(spark, facts.count())
    (
        sealed.select("ledger_id", "line", "byte_offset", "byte_len", "terminated", "value")
        .repartitionByRange(width, "ledger_id", "byte_offset")
        .sortWithinPartitions("ledger_id", "byte_offset")
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .partitionBy("ledger_id")
        .parquet(f"{archive}/lines")
    )
    frozen = materialize(snapshot_digest(archive_lines(spark, archive)), "seal-digests")
    seen = D.scanned_digest(facts).withColumnRenamed("sha256", "_seen")
    changed = seen.join(frozen, "ledger_id", "full_outer").where(~F.col("_seen").eqNullSafe(F.col("sha256")))
    other = changed.orderBy("ledger_id").first()
    if other is not None:
        raise SealedArchiveError(f"ledger changed while it was sealed: {other['ledger_id']}")
    breaks = V.verify_breakpoints(errors)
    breaks.write.mode("errorifexists").parquet(f"{archive}/breakpoints")
    breaks = spark.read.schema(breaks.schema).parquet(f"{archive}/breakpoints")
    summary = materialize(V.verify_summary(facts, errors), "seal-summary")
    reports = verify_reports(summary, sealed_at, active, archive, namespace)
    reports.write.mode("errorifexists").parquet(f"{archive}/reports")
    lists = breakpoint_lists(summary, frozen, breakpoint_digest(breaks), sealed_at, namespace)
    lists.write.mode("errorifexists").parquet(f"{archive}/breakpoint_lists")
    rows = manifests(
        summary,
        frozen,
        spark.read.schema(reports.schema).parquet(f"{archive}/reports"),
        spark.read.schema(lists.schema).parquet(f"{archive}/breakpoint_lists"),
        sealed_at,
        active,
        archive,
        namespace,
    )
    rows.write.mode("errorifexists").parquet(f"{archive}/manifests")
    return spark.read.schema(rows.schema).parquet(f"{archive}/manifests")


def archive_lines(spark: SparkSession, archive: str) -> DataFrame:
    return spark.read.schema(
        "line bigint, byte_offset bigint, byte_len bigint, terminated boolean, value binary, ledger_id string"
    ).parquet(f"{archive}/lines")


def start_new_ledgers(
    manifest_rows: DataFrame, sealed_at: str, namespace: str = S.NAMESPACE
) -> DataFrame:
    """Lines of the ledgers that continue after a seal."""
    return chain_lines(transition_events(manifest_rows, sealed_at, namespace=namespace))


# -- sealing as one transaction ------------------------------------------------


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it is there already; of several writers one succeeds."""
    target, fs = _hadoop(spark, path)
    fs.mkdirs(target.getParent())
    local = target.toUri().getPath() if fs.getScheme() == "file" else None
    if local is not None:
        # A local rename replaces, a link does not.
        staged = f"{local}.{uuid.uuid4().hex}"
        with open(staged, "w") as file:
            file.write(text)
        try:
            os.link(staged, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(staged)
        return True
    try:
        out = fs.create(target, False)
    except Exception:
        if fs.exists(target):
            return False
        raise
    out.write(text.encode())
    out.close()
    return True


def committed_seals(spark: SparkSession, registry: str) -> list[str]:
    """Folders of the committed seals, oldest first.  A commit that is not written out yet is none."""
    target, fs = _hadoop(spark, f"{registry}/commits")
    found = {}
    for status in fs.listStatus(target) if fs.exists(target) else []:
        name = status.getPath().getName()
        if re.fullmatch(r"[0-9]{12}\.json", name):
            stream = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(status.getPath()), "UTF-8")
            with contextlib.suppress(ValueError):
                found[name] = json.loads(stream)["seal"]
    return [found[name] for name in sorted(found)]


def registered_archives(spark: SparkSession, registry: str) -> DataFrame:
    """Registry entries of all committed seals; an absent registry reads as empty."""
    seals = committed_seals(spark, registry)
    if not seals:
        return list_archives(spark, f"{registry}/none")
    return spark.read.parquet(*[f"{s}/registry" for s in seals])


def continued_ledgers(spark: SparkSession, registry: str) -> DataFrame | None:
    """First lines of the ledgers that the committed seals opened and none of them sealed since."""
    seals = committed_seals(spark, registry)
    if not seals:
        return None
    lines = spark.read.parquet(*[f"{s}/next" for s in seals])
    return lines.join(registered_archives(spark, registry).select("ledger_id"), "ledger_id", "left_anti")


def seal_and_continue(
    lines: DataFrame,
    archives: str,
    registry: str,
    *,
    sealed_at: str,
    active: str = "",
    strict: bool = True,
    namespace: str = S.NAMESPACE,
) -> DataFrame:
    """Seal ledgers, register their archives and open their successors: all of it or nothing.

    Everything is staged in a folder of this attempt.  One small file, created only if no
    other seal took its number, then makes it part of the registry: lines, report,
    breakpoints, manifest, entry and transition event become visible together.  A
    crash before leaves a folder that nobody reads.  If another seal was committed
    meanwhile, ledgers that it sealed refuse this one.  Returns the entries.
    """
    spark = lines.sparkSession
    target = f"{archives}/seal-{uuid.uuid4().hex}"
    try:
        rows = seal(lines, target, sealed_at=sealed_at, active=active, strict=strict, namespace=namespace)
        registry_entries(rows, f"{target}/manifests").write.mode("errorifexists").parquet(f"{target}/registry")
        start_new_ledgers(rows, sealed_at, namespace).write.mode("errorifexists").parquet(f"{target}/next")
        entries = spark.read.parquet(f"{target}/registry")
        while True:
            others = committed_seals(spark, registry)
            if others:
                known = spark.read.parquet(*[f"{s}/registry" for s in others])
                twice = entries.join(known, "ledger_id", "left_semi").orderBy("ledger_id").first()
                if twice is not None:
                    raise LedgerAlreadySealedError(f"ledger is sealed already: {twice['ledger_id']}")
            document = json.dumps({"seal": target, "sealed_at": sealed_at, "after": len(others)})
            if create_once(spark, f"{registry}/commits/{len(others) + 1:012d}.json", document):
                return entries
    except Exception:
        folder, fs = _hadoop(spark, target)
        fs.delete(folder, True)
        raise


# -- reading archives --------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def is_sealed(spark: SparkSession, path: str) -> bool:
    """Any committed manifest marks a folder as sealed, even a damaged one."""
    return _exists(spark, f"{path}/manifests/_SUCCESS")


def assert_active(spark: SparkSession, path: str) -> None:
    if is_sealed(spark, path):
        raise SealedArchiveError(f"sealed archive is read-only and must be queried explicitly: {path}")


def load_manifests(spark: SparkSession, archive: str) -> DataFrame:
    if not is_sealed(spark, archive):
        raise SealedArchiveError(f"not a sealed archive (manifest missing): {archive}")
    return spark.read.parquet(f"{archive}/manifests")


def list_archives(spark: SparkSession, registry: str) -> DataFrame:
    """The registry; an absent one reads as empty and is not created."""
    empty = (
        "archive_id string, archive_path string, manifest_path string, manifest_sha256 string,"
        " sealed_at string, ledger_id string, byte_size bigint, ledger_sha256 string,"
        " event_count bigint, breakpoint_count bigint, status string"
    )
    if not _exists(spark, registry):
        return spark.createDataFrame([], empty)
    return spark.read.schema(empty).parquet(registry)


_HEX = r"\A[0-9a-f]{64}\z"


def manifest_checks(
    manifest_rows: DataFrame, lines: DataFrame, archive: str, namespace: str = S.NAMESPACE
) -> DataFrame:
    """Structural checks of each manifest: (ledger_id, check, ok)."""
    sizes = lines.groupBy("ledger_id").agg(F.sum("byte_len").alias("_size"))
    rows = (
        manifest_rows.withColumn("m", F.from_json("manifest", _MANIFEST))
        .join(sizes, "ledger_id", "left")
        .withColumn("_expected_path", F.concat(F.lit(f"{archive}/lines/ledger_id="), F.col("ledger_id")))
    )
    checks = {
        "schema": F.col("m.schema_version") == S.schema_id(S.ARCHIVE_MANIFEST, namespace),
        "archive": F.col("m.archive").isNotNull(),
        "ledger_id": F.col("m.archive.ledger_id") == F.col("ledger_id"),
        "byte_size": F.col("m.archive.byte_size") >= 0,
        "path": F.col("m.archive.path") == F.col("_expected_path"),
        "digest_form": F.lower(F.trim("m.archive.sha256")).rlike(_HEX),
        "size_matches": F.col("m.archive.byte_size") == F.coalesce("_size", F.lit(0)),
    }
    return _check_rows(rows, checks)


def _check_rows(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("check"), F.coalesce(test, F.lit(False)).alias("ok"))
            for name, test in checks.items()
        ]
    )
    return rows.select("ledger_id", F.inline(entries))


def archive_context(
    spark: SparkSession, archive: str, namespace: str = S.NAMESPACE, ledger_id: str | None = None
) -> DataFrame:
    """Every pin of an archive re-checked: (ledger_id, check, ok)."""
    rows = load_manifests(spark, archive)
    lines = archive_lines(spark, archive)
    breaks = spark.read.parquet(f"{archive}/breakpoints")
    reports = spark.read.parquet(f"{archive}/reports")
    lists = spark.read.parquet(f"{archive}/breakpoint_lists")
    if ledger_id is not None:
        only = F.col("ledger_id") == ledger_id
        rows, lines, breaks, reports, lists = (t.where(only) for t in (rows, lines, breaks, reports, lists))
    counted = breaks.groupBy("ledger_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(F.col("code") == S.PREVIOUS_HASH_MISMATCH).alias("_codes"),
        F.bool_and(F.col("byte_offset").isNotNull() & (F.col("byte_offset") >= 0)).alias("_offsets"),
        F.countDistinct("byte_offset").alias("_distinct"),
    )
    pins = (
        rows.withColumn("m", F.from_json("manifest", _MANIFEST))
        .join(snapshot_digest(lines).withColumnRenamed("sha256", "_sha"), "ledger_id", "left")
        .join(reports.select("ledger_id", F.sha2("report", 256).alias("_report")), "ledger_id", "left")
        .join(breakpoint_digest(breaks).withColumnRenamed("sha256", "_bp"), "ledger_id", "left")
        .join(lists.groupBy("ledger_id").agg(F.min("document").alias("_list"), F.count("*").alias("_lists")), "ledger_id", "left")
        .withColumn("_head", F.from_json("_list", _LIST))
        .join(counted, "ledger_id", "left")
    )
    zero = F.lit(0).cast("long")
    head, counted_rows = F.col("_head"), F.coalesce("_n", zero)
    checks = {
        "manifest_digest": F.sha2("manifest", 256) == F.col("manifest_sha256"),
        "archive_digest": F.col("_sha") == F.col("m.archive.sha256"),
        "report_digest": F.col("_report") == F.col("m.verification.sha256"),
        "breakpoint_list": (F.col("_lists") == 1) & (F.sha2("_list", 256) == F.col("m.breakpoints.sha256")),
        "breakpoint_schema": head["schema_version"] == S.schema_id(S.BREAKPOINT_LIST, namespace),
        "breakpoint_owner": (head["archive_id"] == F.col("archive_id"))
        & (head["ledger_sha256"] == F.col("m.archive.sha256"))
        & (head["byte_size"] == F.col("m.archive.byte_size")),
        "breakpoint_digest": F.coalesce("_bp", _empty_digest()) == head["rows_sha256"],
        "breakpoint_count": (counted_rows == F.col("m.breakpoints.count")) & (counted_rows == head["count"]),
        "breakpoint_codes": F.coalesce("_codes", F.lit(True)),
        "breakpoint_offsets": F.coalesce("_offsets", F.lit(True))
        & (F.coalesce("_n", zero) == F.coalesce("_distinct", zero)),
    }
    return manifest_checks(rows, lines, archive, namespace).unionByName(_check_rows(pins, checks))


def require_intact(checks: DataFrame) -> None:
    """Fail closed on the first broken pin."""
    bad = checks.where(~F.col("ok")).orderBy("ledger_id", "check").first()
    if bad is not None:
        raise SealedArchiveError(f"sealed archive check failed for {bad['ledger_id']}: {bad['check']}")


def refused_ledgers(checks: DataFrame) -> DataFrame:
    """Ledgers with a broken pin and the names of their failed checks."""
    broken = checks.where(~F.coalesce("ok", F.lit(False)))
    return broken.groupBy("ledger_id").agg(F.array_sort(F.collect_set("check")).alias("failed_checks"))


def archive_batches(
    spark: SparkSession,
    archive: str,
    cursors: DataFrame | None = None,
    *,
    projection: str = "metadata",
    namespace: str = S.NAMESPACE,
    **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cursor reads of every sealed ledger whose pins hold.

    A damaged ledger is left out and does not keep the others from being read;
    `refused_ledgers` of `archive_context` names it.
    """
    refused = materialize(refused_ledgers(archive_context(spark, archive, namespace)), "refused")
    lines = archive_lines(spark, archive)
    if not refused.isEmpty():
        lines = lines.join(broadcast_if_small(refused.select("ledger_id")), "ledger_id", "left_anti")
    return R.read_batches(
        lines,
        R.zero_cursors(lines) if cursors is None else cursors,
        projection=projection,
        recorded_breakpoints=spark.read.parquet(f"{archive}/breakpoints"),
        **options,
    )


def archive_read(
    spark: SparkSession, archive: str, ledger_id: str, *, projection: str = "metadata", namespace: str = S.NAMESPACE, **options
) -> R.EventBatch:
    """Cursor read of one sealed ledger, after all its pins hold."""
    rows = load_manifests(spark, archive).where(F.col("ledger_id") == ledger_id)
    if rows.limit(1).count() == 0:
        raise SealedArchiveError(f"not a sealed archive (manifest missing): {ledger_id}")
    require_intact(archive_context(spark, archive, namespace, ledger_id))
    breaks = spark.read.parquet(f"{archive}/breakpoints").where(F.col("ledger_id") == ledger_id)
    return R.read_incremental(
        archive_lines(spark, archive),
        ledger_id,
        projection=projection,
        recorded_breakpoints=breaks,
        namespace=namespace,
        **options,
    )


def archive_tail(
    spark: SparkSession,
    archive: str,
    n: int,
    *,
    source: str | None = None,
    event_type: str | None = None,
    project: str | None = None,
    projection: str = "metadata",
    namespace: str = S.NAMESPACE,
) -> DataFrame:
    """Last ``n`` matches of every sealed ledger: one scan, no paging."""
    events, envelopes, _ = archive_batches(
        spark,
        archive,
        projection=projection,
        sources=[source] if source else None,
        event_types=[event_type] if event_type else None,
        projects=[project] if project else None,
        max_bytes=1 << 62,
        namespace=namespace,
    )
    failed = envelopes.where((F.col("cursor_status") != "ok") | (F.col("chain_status") == "failed"))
    bad = failed.orderBy("ledger_id").first()
    if bad is not None:
        raise SealedArchiveError("sealed archive query failed: " + "; ".join(bad["warnings"]))
    newest = W.partitionBy("ledger_id").orderBy(F.desc("byte_offset"))
    # Spark keeps n rows per ledger before the shuffle for this shape.
    return (
        events.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")
    )


def breakpoint_set_equal(actual: DataFrame, recorded: DataFrame) -> DataFrame:
    """Per ledger: do both breakpoint sets agree in every column?"""
    fields = [f.name for f in S.BREAKPOINT_TYPE.fields if f.name != "byte_offset"]
    a = actual.select("ledger_id", "byte_offset", F.struct(*fields).alias("_a"))
    b = recorded.select("ledger_id", "byte_offset", F.struct(*fields).alias("_b"))
    joined = a.join(b, ["ledger_id", "byte_offset"], "full_outer")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))
    return joined.groupBy("ledger_id").agg(F.bool_and(same).alias("breakpoints_match"))


def registry_pin_match(manifest_rows: DataFrame, registry: DataFrame | None) -> DataFrame:
    """Exactly one registry row with the same pins; null without a registry."""
    if registry is None:
        return manifest_rows.select("ledger_id", F.lit(None).cast("boolean").alias("registry_match"))
    m = manifest_rows.select(
        "ledger_id",
        "archive_id",
        F.col("manifest_sha256").alias("_sha"),
        F.get_json_object("manifest", "$.archive.path").alias("_path"),
    )
    found = registry.groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.first("manifest_sha256").alias("_rsha"),
        F.first("archive_path").alias("_rpath"),
    )
    return m.join(found, "archive_id", "left").select(
        "ledger_id",
        F.coalesce(
            (F.col("_rows") == 1) & (F.col("_rsha") == F.col("_sha")) & (F.col("_rpath") == F.col("_path")),
            F.lit(False),
        ).alias("registry_match"),
    )


def verify_archive(
    spark: SparkSession, archive: str, registry: DataFrame | None = None, namespace: str = S.NAMESPACE
) -> DataFrame:
    """Status row per sealed ledger: verified again and compared with its pins.

    Each ledger is judged on its own; a broken pin makes its row invalid.
    """
    sound = F.coalesce("ok", F.lit(False))
    pins = archive_context(spark, archive, namespace).groupBy("ledger_id").agg(
        F.bool_and(sound).alias("intact"),
        F.bool_and(F.when(F.col("check") == "archive_digest", sound)).alias("digest_ok"),
    )
    rows = load_manifests(spark, archive)
    lines = archive_lines(spark, archive)
    facts = line_table(lines, _VERIFIED)
    errors = materialize(V.verify_errors(table_facts(lines, flat=facts), namespace, facts), "archive-errors")
    recorded = spark.read.parquet(f"{archive}/breakpoints")
    counts = errors.groupBy("ledger_id").agg(
        F.count_if(F.col("code") != S.PREVIOUS_HASH_MISMATCH).alias("fatal"),
        F.count_if(F.col("code") == S.PREVIOUS_HASH_MISMATCH).alias("accepted"),
    )
    zero = F.lit(0).cast("long")
    out = (
        rows.join(counts, "ledger_id", "left")
        .join(breakpoint_set_equal(V.verify_breakpoints(errors), recorded), "ledger_id", "left")
        .join(registry_pin_match(rows, registry), "ledger_id", "left")
        .join(pins, "ledger_id", "left")
    )
    fatal = F.coalesce("fatal", zero)
    match = F.coalesce("breakpoints_match", F.lit(True))
    return out.select(
        "ledger_id",
        "archive_id",
        "manifest_sha256",
        F.coalesce("digest_ok", F.lit(False)).alias("ledger_sha256_matches_manifest"),
        F.col("registry_match").alias("manifest_sha256_matches_registry"),
        F.lit(None).cast("boolean").alias("state_sidecar_matches_manifest"),
        match.alias("recorded_breakpoints_match"),
        fatal.alias("fatal_error_count"),
        F.coalesce("accepted", zero).alias("accepted_breakpoint_count"),
        (
            F.coalesce("intact", F.lit(False)) & (fatal == 0) & match & F.coalesce("registry_match", F.lit(True))
        ).alias("valid"),
    )
