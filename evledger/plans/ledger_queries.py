"""Chains, raw ledger text, verification, cursor reads and archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from evledger import positions
from evledger.functions import text as X
from evledger.operators import archive as A
from evledger.operators import chain as H
from evledger.operators import policy as P
from evledger.operators import read as R
from evledger.operators import segments as G
from evledger.operators import verify as V
from evledger.plans import base as B
from evledger.plans.base import CHAIN, DAMAGED, GAPPED, LINES, query, table
from evledger.session import materialize, scratch_path
from evledger.sources import lines as L
from evledger.sources.tail import plain_path

# Small on purpose: at test scale every ordered operator crosses segments.
ROWS = 500
BYTES = 64 * 1024

_SUMMARY = ("ledger_id", "event_count", "first_content_hash", "last_content_hash", "error_count", "valid")


@query(
    "capture_and_verify",
    f"""{CHAIN} SELECT ledger_id, count(*) AS event_count, min_by(content_hash, seq) AS first_content_hash,
    max_by(content_hash, seq) AS last_content_hash, 0::BIGINT AS error_count, true AS valid
    FROM chain GROUP BY ledger_id""".replace(
        "payload\":' || replace(props, ': ', ':') || '",
        "payload\":{\"capture_policy\":{\"artifact_mode\":\"references_only\","
        "\"schema_version\":\"evledger.capture_policy.v1\"},' || ltrim(replace(props, ': ', ':'), '{') || '",
    ),
)
def capture_and_verify(spark, d):
    """Flagship: envelope, policy, chain per ledger, ledger text, verification."""
    events = B.envelope(spark, d)
    accepted = P.apply_policy(events, P.CapturePolicy()).where("accepted")
    chained = H.chain_build(accepted.drop("accepted", "reason", "redaction_count"))
    path = scratch_path(spark, "captured")
    H.write_ledger(materialize(chained, "captured-events"), path)
    summary, _ = V.verify_ledger(spark, path)
    return summary.select(*_SUMMARY)


# -- chains ------------------------------------------------------------------

_LINKS = "ledger_id, seq, previous_hash, content_hash"


@query("chain_build", f"{CHAIN} SELECT {_LINKS} FROM chain")
def chain_build(spark, d):
    return H.chain_build(B.envelope(spark, d)).select("ledger_id", "seq", "previous_hash", "content_hash")


@query("ledger_append", f"{CHAIN} SELECT {_LINKS} FROM chain")
def ledger_append(spark, d):
    """A second batch appended to the heads of a first one, in bounded rounds."""
    events = B.envelope(spark, d)
    cut = table(spark, d, "events").agg(F.floor(F.avg("event_id"))).first()[0]
    first = materialize(H.chain_build(events.where(F.col("seq") <= cut)), "first-batch")
    rest = H.chain_build(events.where(F.col("seq") > cut), heads=H.chain_heads(first), round_rows=4_000_000)
    return first.unionByName(rest).select("ledger_id", "seq", "previous_hash", "content_hash")


@query(
    "chain_links",
    f"""{CHAIN} SELECT ledger_id, seq, expected_previous_hash,
      previous_hash IS NOT DISTINCT FROM expected_previous_hash AS link_ok
    FROM (SELECT *, lag(content_hash) OVER (PARTITION BY ledger_id ORDER BY seq) AS expected_previous_hash
          FROM chain WHERE seq % 71 <> 3)""",
)
def chain_links(spark, d):
    kept = B.chained(spark, d).where(F.col("seq") % 71 != 3)
    return H.chain_links(kept, width=ROWS).select("ledger_id", "seq", "expected_previous_hash", "link_ok")


@query(
    "chain_adjacency",
    f"""{DAMAGED} SELECT ledger_id, line, event_id, previous_event_id, expected_previous_hash FROM good""",
)
def chain_adjacency(spark, d):
    lines = B.damaged_facts(spark, d).select("ledger_id", "line", "byte_offset", "byte_len", "value")
    return (
        L.table_facts(lines, BYTES)
        .where(F.col("kind") == "event")
        .select("ledger_id", "line", "event_id", "previous_event_id", "expected_previous_hash")
    )


# -- raw text ----------------------------------------------------------------

_POS = "ledger_id, rn AS line, byte_offset, byte_len"


@query("ledger_scan", f"{LINES} SELECT ledger_id, rn AS line, byte_offset, line_text AS event FROM lines")
def ledger_scan(spark, d):
    return L.read_events(L.ledger_lines(spark, B.ledger_files(spark, d)))


@query("ledger_lines", f"{LINES} SELECT {_POS}, true AS terminated FROM lines")
def ledger_lines(spark, d):
    return L.ledger_lines(spark, B.ledger_files(spark, d)).select(
        "ledger_id", "line", "byte_offset", "byte_len", "terminated"
    )


@query("byte_positions", f"{LINES} SELECT {_POS} FROM lines")
def byte_positions(spark, d):
    """Positions by running sums over a table that only has line order."""
    rows = B.ledger_table(spark, d).select("ledger_id", "line", "byte_len")
    return G.running_sum(rows, ["ledger_id"], "line", F.col("byte_len"), "byte_offset", ROWS)


@query(
    "boundary_event",
    f"""{LINES} SELECT 'first' AS edge, ledger_id, min(rn) AS line, min(byte_offset) AS byte_offset FROM lines GROUP BY ledger_id
    UNION ALL SELECT 'last', ledger_id, max(rn), max(byte_offset) FROM lines GROUP BY ledger_id
    UNION ALL SELECT 'before', ledger_id, max(rn), max(byte_offset) FROM lines
      WHERE byte_offset + byte_len <= 100000 GROUP BY ledger_id""",
)
def boundary_event(spark, d):
    lines = B.ledger_table(spark, d)
    parts = {"first": L.first_event(lines), "last": L.last_event(lines), "before": L.last_event(lines, 100_000)}
    frames = [
        rows.select(F.lit(edge).alias("edge"), "ledger_id", "line", "byte_offset") for edge, rows in parts.items()
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "recent_events",
    f"""{LINES} SELECT ledger_id, rn AS line, line_text AS event FROM lines
    QUALIFY row_number() OVER (PARTITION BY ledger_id ORDER BY rn DESC) <= 5""",
)
def recent_events(spark, d):
    return L.recent_events(B.ledger_table(spark, d), 5).select(
        "ledger_id", "line", F.col("value").cast("string").alias("event")
    )


# -- verification ------------------------------------------------------------


def _tree(lines: str, at: str, text: str) -> str:
    """SQL of the digest tree over ``lines``, as ``digests``."""
    return f"""
t0 AS (SELECT ledger_id, {at} // 1048576 AS up, sha256(string_agg(sha256({text} || chr(10)), '' ORDER BY {at})) AS h
       FROM {lines} GROUP BY ledger_id, up),
t1 AS (SELECT ledger_id, up // 4096 AS v, sha256(string_agg(h, '' ORDER BY up)) AS h FROM t0 GROUP BY ledger_id, v),
t2 AS (SELECT ledger_id, v // 4096 AS w, sha256(string_agg(h, '' ORDER BY v)) AS h FROM t1 GROUP BY ledger_id, w),
digests AS (SELECT ledger_id, sha256(string_agg(h, '' ORDER BY w)) AS sha256 FROM t2 GROUP BY ledger_id)"""


@query(
    "verify_ledger",
    f"""{LINES}, {_tree("lines", "byte_offset", "line_text")}
    SELECT ledger_id, count(*) AS event_count, sum(byte_len)::BIGINT AS byte_size,
      min_by(content_hash, seq) AS first_content_hash, max_by(event_id, seq) AS last_event_id,
      max_by(content_hash, seq) AS last_content_hash, 0::BIGINT AS error_count, 0::BIGINT AS breakpoint_count,
      true AS valid, any_value(sha256) AS snapshot_sha256,
      CASE right(ledger_id, 2)::INT % 3 WHEN 0 THEN 'known:' || ledger_id ELSE 'derived' END AS known_as
    FROM lines JOIN digests USING (ledger_id) GROUP BY ledger_id""",
)
def verify_ledger(spark, d):
    """One scan: counts, errors, the digest of the bytes, and the id each ledger is known by."""
    paths = B.ledger_files(spark, d)
    files = V.file_versions(spark, paths).select(plain_path(F.col("path")).alias("path"))
    first = files.groupBy(L.ledger_of_path(F.col("path")).alias("_ledger")).agg(F.min("path").alias("path"))
    named = first.where(F.right("_ledger", F.lit(2)).cast("int") % 3 == 0)
    named = named.select("path", F.concat(F.lit("known:"), "_ledger").alias("ledger_id"))
    summary, _ = V.verify_ledger(spark, paths, states=named)
    derived = X.derived_ledger_id(F.col("path"), F.col("snapshot_sha256"))
    known_as = F.when(F.col("known_id") == derived, "derived").otherwise(F.col("known_id"))
    return summary.withColumn("known_as", known_as).drop("path", "known_id")


@query("verify_errors", f"{DAMAGED} SELECT ledger_id, line, byte_offset, code, event_id FROM errors")
def verify_errors(spark, d):
    return B.damaged_errors(spark, d).select("ledger_id", "line", "byte_offset", "code", "event_id")


@query(
    "verify_table",
    f"""{DAMAGED} SELECT ledger_id, code, count(*) AS n, min(line) AS first_line FROM errors GROUP BY ledger_id, code""",
)
def verify_table(spark, d):
    """The same checks on a table of lines instead of text files."""
    lines = B.damaged_facts(spark, d).select("ledger_id", "line", "byte_offset", "byte_len", "value")
    errors = V.verify_errors(L.table_facts(lines, BYTES))
    return errors.groupBy("ledger_id", "code").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query(
    "verify_breakpoints",
    f"""{DAMAGED} SELECT ledger_id, line, byte_offset, event_id, previous_event_id, expected_previous_hash,
      previous_hash AS actual_previous_hash, content_hash FROM good
    WHERE previous_hash IS DISTINCT FROM expected_previous_hash""",
)
def verify_breakpoints(spark, d):
    return V.verify_breakpoints(B.damaged_errors(spark, d)).drop("code", "message")


@query(
    "verify_summary",
    f"""{DAMAGED}, e AS (SELECT ledger_id, count(*) AS error_count,
        count(*) FILTER (WHERE code = 'previous_hash_mismatch') AS breakpoint_count FROM errors GROUP BY ledger_id)
    SELECT ledger_id, event_count, byte_size, first_content_hash, last_event_id, last_content_hash,
      coalesce(error_count, 0) AS error_count, coalesce(breakpoint_count, 0) AS breakpoint_count,
      error_count IS NULL AS valid
    FROM (SELECT ledger_id, count(*) AS event_count, min_by(content_hash, seq) AS first_content_hash,
            arg_max_null(event_id, seq) AS last_event_id, max_by(content_hash, seq) AS last_content_hash
          FROM good GROUP BY ledger_id)
    JOIN (SELECT ledger_id, sum(strlen(line_text) + 1)::BIGINT AS byte_size FROM placed GROUP BY ledger_id) USING (ledger_id)
    LEFT JOIN e USING (ledger_id)""",
)
def verify_summary(spark, d):
    return V.verify_summary(B.damaged_facts(spark, d), B.damaged_errors(spark, d))


@query(
    "error_codes",
    f"""{DAMAGED} SELECT ledger_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM errors
    WHERE code <> 'previous_hash_mismatch' GROUP BY ledger_id""",
)
def error_codes(spark, d):
    return V.error_codes(B.damaged_errors(spark, d)).select(
        "ledger_id", F.array_join("codes", ",").alias("codes")
    )


@query(
    "seal_gate",
    f"""{DAMAGED} SELECT ledger_id, 'ledger has non-archivable integrity errors: '
      || string_agg(DISTINCT code, ', ' ORDER BY code) AS message FROM errors
    WHERE code <> 'previous_hash_mismatch' GROUP BY ledger_id""",
)
def seal_gate(spark, d):
    return V.seal_gate(B.damaged_errors(spark, d))


@query(
    "duplicate_ids",
    """SELECT ledger_id, event_id, byte_offset FROM (
      SELECT 'ledger_' || event_type AS ledger_id, 'evt_' || user_id AS event_id, event_id AS byte_offset,
        row_number() OVER (PARTITION BY event_type, user_id ORDER BY events.event_id) AS n FROM events) WHERE n > 1""",
)
def duplicate_ids(spark, d):
    rows = table(spark, d, "events").select(
        F.concat(F.lit("ledger_"), "event_type").alias("ledger_id"),
        F.concat(F.lit("evt_"), F.col("user_id").cast("string")).alias("_id"),
        F.col("event_id").alias("byte_offset"),
        F.col("event_id").alias("line"),
        F.lit("event").alias("kind"),
    )
    copies = V.duplicate_ids(rows.withColumnRenamed("_id", "event_id"))
    return copies.select("ledger_id", "event_id", "byte_offset")


@query(
    "verify_ledger_id",
    """SELECT '/l/' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'manifest:' || doc_id
      WHEN doc_id % 5 = 0 THEN 'state-' || doc_id
      ELSE 'ledger_' || left(sha256('/l/' || doc_id || chr(0) || sha256(text)), 32) END AS ledger_id FROM documents""",
)
def verify_ledger_id(spark, d):
    n = F.col("doc_id").cast("string")
    path = F.concat(F.lit("/l/"), n).alias("path")
    docs = table(spark, d, "documents")
    ledgers = docs.select(path, F.sha2("text", 256).alias("snapshot_sha256"))
    manifests = docs.where(F.col("doc_id") % 3 < 2).select(
        path, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" manifest:"), n)).otherwise("not an id!").alias("ledger_id")
    )
    states = docs.where(F.col("doc_id") % 5 == 0).select(path, F.concat(F.lit("state-"), n).alias("ledger_id"))
    return V.verify_ledger_id(ledgers, manifests, states).select("path", "ledger_id")


@query(
    "verify_changed",
    """SELECT 'f' || o_orderkey AS path, 'ledger_changed_during_verification' AS code FROM orders
    WHERE o_orderkey % 9 = 1 OR o_orderkey % 10 = 2 OR o_orderkey % 11 = 3""",
)
def verify_changed(spark, d):
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        key,
        F.concat(F.lit("f"), key.cast("string")).alias("path"),
        F.floor(F.col("o_totalprice") * 100).alias("length"),
        F.col("o_orderdate").cast("timestamp").alias("modificationTime"),
    )
    after = (
        rows.where(key % 11 != 3)
        .withColumn("length", F.when(key % 9 == 1, F.col("length") + 1).otherwise(F.col("length")))
        .withColumn(
            "modificationTime",
            F.when(key % 10 == 2, F.col("modificationTime") + F.expr("INTERVAL 1 SECOND")).otherwise(
                F.col("modificationTime")
            ),
        )
    )
    return V.verify_changed(rows.drop("o_orderkey"), after.drop("o_orderkey")).select("path", "code")


@query(
    "active_guard",
    f"""{GAPPED} SELECT DISTINCT ledger_id, true AS sealed FROM gapped""",
)
def active_guard(spark, d):
    """Active calls refuse a sealed folder; its ledgers are listed instead."""
    path = B.sealed_archive(spark, d)
    try:
        A.assert_active(spark, path)
        refused = False
    except A.SealedArchiveError:
        refused = True
    return A.load_manifests(spark, path).select("ledger_id", F.lit(refused).alias("sealed"))


# -- cursor reads ------------------------------------------------------------


@query(
    "read_incremental",
    f"""{LINES} SELECT ledger_id, rn AS line, byte_offset, event_id, source, event_type, project, summary, content_hash
    FROM lines WHERE source IN ('codex', 'cursor') AND byte_offset + byte_len <= 200000
    QUALIFY row_number() OVER (PARTITION BY ledger_id ORDER BY seq) <= 120""",
)
def read_incremental(spark, d):
    lines = B.indexed_ledger(spark, d)
    events, _, _ = R.read_batches(
        lines,
        R.zero_cursors(lines),
        sources=["codex", "cursor"],
        limit=120,
        max_bytes=200_000,
        projection="summary",
        width=BYTES,
    )
    return events.select(
        "ledger_id", "line", "byte_offset", "event_id", "source", "event_type", "project", "summary", "content_hash"
    )


# One cursor per ledger: fresh, resumed, too far, foreign, unnamed, tampered.
def mixed_cursors(lines):
    at = (F.col("byte_offset") + F.col("byte_len")).alias("end")
    edge = (
        lines.where(F.col("byte_offset") + F.col("byte_len") <= 60_000)
        .groupBy("ledger_id")
        .agg(F.max_by(F.struct(at, F.col("value").cast("string").alias("text")), "byte_offset").alias("e"))
    )
    kind = F.substring("ledger_id", 8, 2).cast("int") % 6
    event_id = F.get_json_object("e.text", "$.event_id")
    digest = F.get_json_object("e.text", "$.content_hash")
    return edge.select(
        "ledger_id",
        F.when(kind == 3, F.lit("ledger_other")).otherwise(F.col("ledger_id")).alias("cursor_ledger_id"),
        F.when(kind == 0, F.lit(0)).when(kind == 2, F.lit(1 << 40)).otherwise(F.col("e.end")).cast("bigint").alias("cursor_offset"),
        F.when(kind.isin(1, 2, 3, 5), event_id).alias("cursor_event_id"),
        F.when(kind.isin(1, 2, 3), digest).when(kind == 5, F.sha2(digest, 256)).alias("cursor_hash"),
    )


_STATUS = f"""{LINES},
edge AS (SELECT ledger_id, right(ledger_id, 2)::INT % 6 AS kind, max(byte_offset + byte_len) AS edge_end FROM lines
         WHERE byte_offset + byte_len <= 60000 GROUP BY ledger_id),
sized AS (SELECT ledger_id, max(byte_offset + byte_len) AS size FROM lines GROUP BY ledger_id),
begin AS (SELECT *, CASE kind WHEN 0 THEN 0 ELSE edge_end END AS start FROM edge JOIN sized USING (ledger_id)),
ends AS (SELECT b.ledger_id, max(l.byte_offset + l.byte_len) AS stop, max_by(l.event_id, l.byte_offset) AS last_event_id,
           max_by(l.content_hash, l.byte_offset) AS last_hash
         FROM begin b JOIN lines l ON l.ledger_id = b.ledger_id AND l.byte_offset + l.byte_len <= b.start + 90000
         GROUP BY b.ledger_id)
SELECT ledger_id, CASE WHEN kind IN (0, 1) THEN stop ELSE 0 END::BIGINT AS byte_offset,
  CASE WHEN kind IN (0, 1) THEN last_event_id END AS last_event_id,
  CASE kind WHEN 0 THEN CASE WHEN stop = size THEN 'verified' ELSE 'partial' END
    WHEN 1 THEN 'partial' WHEN 2 THEN 'not_checked' WHEN 3 THEN 'not_checked' ELSE 'failed' END AS chain_status,
  CASE kind WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'truncated' WHEN 3 THEN 'ledger_changed'
    ELSE 'invalid' END AS cursor_status,
  kind IN (0, 1) AND stop < size AS truncated,
  CASE WHEN kind IN (0, 1) THEN stop - start ELSE 0 END::BIGINT AS bytes_read, size::BIGINT AS ledger_size
FROM begin JOIN ends USING (ledger_id)"""


@query("cursor_status", _STATUS)
def cursor_status(spark, d):
    lines = B.ledger_table(spark, d)
    _, envelopes, _ = R.read_batches(lines, mixed_cursors(lines), max_bytes=90_000, width=BYTES)
    return envelopes.drop("last_content_hash", "warnings")


@query(
    "cursor_boundary_check",
    f"""{LINES}, edge AS (SELECT DISTINCT ledger_id, right(ledger_id, 2)::INT % 6 AS kind FROM lines)
    SELECT ledger_id, kind IN (0, 1) AS boundary_ok FROM edge""",
)
def cursor_boundary_check(spark, d):
    lines = B.ledger_table(spark, d)
    return R.cursor_boundary_check(lines, mixed_cursors(lines))


@query(
    "budget_cut",
    f"""{LINES} SELECT ledger_id, max(byte_offset + byte_len)::BIGINT AS byte_offset,
      max_by(content_hash, seq) AS last_content_hash FROM lines
    WHERE byte_offset + byte_len <= 50000 GROUP BY ledger_id""",
)
def budget_cut(spark, d):
    lines = B.ledger_table(spark, d)
    _, envelopes, _ = R.read_batches(lines, R.zero_cursors(lines), max_bytes=50_000, width=BYTES)
    return envelopes.select("ledger_id", "byte_offset", "last_content_hash")


@query(
    "first_failure_cut",
    f"""{DAMAGED}, firsts AS (SELECT ledger_id, min(byte_offset) AS fail FROM (
        SELECT ledger_id, byte_offset FROM placed WHERE harm <> 'none'
        UNION ALL SELECT ledger_id, byte_offset FROM good WHERE previous_hash IS DISTINCT FROM expected_previous_hash)
      GROUP BY ledger_id)
    SELECT p.ledger_id, coalesce(min(fail), max(p.byte_offset + strlen(p.line_text) + 1))::BIGINT AS byte_offset,
      count(*) FILTER (WHERE fail IS NULL OR p.byte_offset < fail) AS events,
      CASE WHEN min(fail) IS NULL THEN 'verified' ELSE 'failed' END AS chain_status
    FROM placed p LEFT JOIN firsts f USING (ledger_id) GROUP BY p.ledger_id""",
)
def first_failure_cut(spark, d):
    facts = B.damaged_facts(spark, d)
    lines = facts.select("ledger_id", "line", "byte_offset", "byte_len", "terminated", "value")
    events, envelopes, _ = R.read_batches(lines, R.zero_cursors(lines), max_bytes=1 << 40, width=BYTES)
    counts = events.groupBy("ledger_id").agg(F.count("*").alias("events"))
    return envelopes.join(counts, "ledger_id", "left").select(
        "ledger_id", "byte_offset", F.coalesce("events", F.lit(0).cast("bigint")).alias("events"), "chain_status"
    )


@query(
    "cursor_state",
    f"""{LINES} SELECT ledger_id, max(byte_offset + byte_len)::BIGINT AS cursor_offset,
      max_by(event_id, seq) AS cursor_event_id, max_by(content_hash, seq) AS cursor_hash
    FROM lines WHERE byte_offset + byte_len <= 70000 GROUP BY ledger_id""",
)
def cursor_state(spark, d):
    """Positions after one batch, saved and loaded again."""
    from evledger.streaming.live import save_cursors

    lines = B.ledger_table(spark, d)
    _, envelopes, _ = R.read_batches(lines, R.zero_cursors(lines), max_bytes=70_000, width=BYTES)
    path = scratch_path(spark, "cursor-state")
    save_cursors(envelopes, path)
    saved, _ = positions.load(spark, path)
    return saved.drop("cursor_ledger_id")


@query(
    "export_jsonl",
    f"{LINES} SELECT line_text AS value FROM lines WHERE event_type = 'click'",
)
def export_jsonl(spark, d):
    lines = B.ledger_table(spark, d)
    events = lines.select("ledger_id", "byte_offset", F.col("value").cast("string").alias("event"))
    chosen = events.where(F.get_json_object("event", "$.event_type") == "click")
    path = scratch_path(spark, "export")
    R.export_jsonl(chosen, path)
    return spark.read.text(path)


# -- archives ----------------------------------------------------------------

_ARCHIVE_ID = f"'archive_' || left(sha256(ledger_id || chr(0) || '{B.SEALED_AT}'), 32)"

# Digest tree: lines, 1 MiB ranges, three levels of 4096.
_TREE = f"""{GAPPED},{_tree("gapped", "pos", "line_text")}"""

_COUNTS = """counts AS (SELECT g.ledger_id, count(*) AS event_count, sum(byte_len)::BIGINT AS byte_size,
    min_by(content_hash, seq) AS first_content_hash, max_by(content_hash, seq) AS last_content_hash,
    max_by(event_id, seq) AS last_event_id,
    count(*) FILTER (WHERE previous_hash IS DISTINCT FROM expected_previous_hash) AS breakpoint_count
  FROM gapped g GROUP BY g.ledger_id)"""


@query("snapshot_digest", f"{_TREE} SELECT ledger_id, sha256 FROM digests")
def snapshot_digest(spark, d):
    return A.snapshot_digest(B.gapped_table(spark, d))


@query(
    "seal",
    f"""{_TREE}, {_COUNTS} SELECT ledger_id, {_ARCHIVE_ID} AS archive_id, event_count, byte_size, sha256, first_content_hash,
      last_content_hash, last_event_id, breakpoint_count, 'sealed_read_only' AS status, true AS entry_pins_manifest,
      'ledger_transition' AS next_event_type, true AS next_pins_manifest, true AS next_starts_chain
    FROM counts JOIN digests USING (ledger_id)""",
)
def seal(spark, d):
    """Archives, registry entries and successors of all ledgers, committed together."""
    root, registry = scratch_path(spark, "seals"), scratch_path(spark, "seal-registry")
    A.seal_and_continue(B.gapped_table(spark, d), root, registry, sealed_at=B.SEALED_AT, active="/ledgers/active")
    archive = A.committed_seals(spark, registry)[0]
    rows = A.load_manifests(spark, archive).withColumn("m", F.from_json("manifest", A._MANIFEST))
    entries = A.registered_archives(spark, registry).select(
        "archive_id", "status", F.col("manifest_sha256").alias("_entry"), F.col("ledger_sha256").alias("_sha")
    )
    p = F.from_json("payload", "archive_id string, archive_manifest_ref struct<sha256: string>")
    opened = A.continued_ledgers(spark, registry).withColumn("p", p).select(
        F.col("p.archive_id").alias("archive_id"),
        F.col("event_type").alias("next_event_type"),
        F.col("p.archive_manifest_ref.sha256").alias("_next"),
        F.col("previous_hash").isNull().alias("next_starts_chain"),
    )
    return rows.join(entries, "archive_id").join(opened, "archive_id").select(
        "ledger_id",
        "archive_id",
        *[
            F.col(f"m.archive.{n}").alias(n)
            for n in ("event_count", "byte_size", "sha256", "first_content_hash", "last_content_hash", "last_event_id")
        ],
        F.col("m.breakpoints.count").alias("breakpoint_count"),
        "status",
        ((F.col("_entry") == F.col("manifest_sha256")) & (F.col("_sha") == F.col("m.archive.sha256"))).alias("entry_pins_manifest"),
        "next_event_type",
        (F.col("_next") == F.col("manifest_sha256")).alias("next_pins_manifest"),
        "next_starts_chain",
    )


@query(
    "archive_manifest",
    f"""{GAPPED}, c AS (SELECT unnest(['schema', 'archive', 'ledger_id', 'byte_size', 'path', 'digest_form', 'size_matches']) AS "check")
    SELECT DISTINCT ledger_id, "check", true AS ok FROM gapped, c""",
)
def archive_manifest(spark, d):
    path = B.sealed_archive(spark, d)
    return A.manifest_checks(A.load_manifests(spark, path), A.archive_lines(spark, path), path)


@query(
    "archive_context",
    f"""{GAPPED}, c AS (SELECT unnest(['schema', 'archive', 'ledger_id', 'byte_size', 'path', 'digest_form', 'size_matches',
      'manifest_digest', 'archive_digest', 'report_digest', 'breakpoint_list', 'breakpoint_schema', 'breakpoint_owner',
      'breakpoint_digest', 'breakpoint_count', 'breakpoint_codes', 'breakpoint_offsets']) AS "check")
    SELECT DISTINCT ledger_id, "check", true AS ok FROM gapped, c""",
)
def archive_context(spark, d):
    return A.archive_context(spark, B.sealed_archive(spark, d))


@query(
    "archive_registry",
    f"""{_TREE}, {_COUNTS} SELECT {_ARCHIVE_ID} AS archive_id, '{B.SEALED_AT}' AS sealed_at, ledger_id, byte_size,
      sha256 AS ledger_sha256, event_count, breakpoint_count, 'sealed_read_only' AS status
    FROM counts JOIN digests USING (ledger_id)""",
)
def archive_registry(spark, d):
    """Registry rebuilt from the manifests, written and listed."""
    path = B.sealed_archive(spark, d)
    target = scratch_path(spark, "registry")
    A.registry_entries(A.load_manifests(spark, path), f"{path}/manifests").write.parquet(target)
    return A.list_archives(spark, target).drop("archive_path", "manifest_path", "manifest_sha256")


@query(
    "registry_union",
    f"""{GAPPED}, l AS (SELECT DISTINCT ledger_id FROM gapped)
    SELECT ledger_id, 'sealed_read_only' AS status FROM l UNION ALL
    SELECT 'other_' || ledger_id, 'sealed_read_only' FROM l""",
)
def registry_union(spark, d):
    path = B.sealed_archive(spark, d)
    entries = A.registry_entries(A.load_manifests(spark, path), path)
    other = entries.withColumn("ledger_id", F.concat(F.lit("other_"), "ledger_id"))
    return A.registry_union(entries, other).select("ledger_id", "status")


@query(
    "registry_append",
    f"""{_TREE}, {_COUNTS} SELECT ledger_id, {_ARCHIVE_ID} AS archive_id, breakpoint_count FROM counts""",
)
def registry_append(spark, d):
    """Entries appended in two steps to one registry table."""
    path = B.sealed_archive(spark, d)
    target = scratch_path(spark, "registry")
    entries = A.registry_entries(A.load_manifests(spark, path), path)
    odd = F.pmod(F.substring("ledger_id", 8, 2).cast("int"), F.lit(2)) == 1
    entries.where(odd).write.mode("append").parquet(target)
    entries.where(~odd).write.mode("append").parquet(target)
    return A.list_archives(spark, target).select("ledger_id", "archive_id", "breakpoint_count")


@query(
    "registry_pin_match",
    f"""{GAPPED} SELECT DISTINCT ledger_id, CASE right(ledger_id, 2)::INT % 4 WHEN 0 THEN true ELSE false END AS registry_match
    FROM gapped""",
)
def registry_pin_match(spark, d):
    """One good entry, a wrong digest, a repeated entry and a missing one."""
    path = B.sealed_archive(spark, d)
    rows = A.load_manifests(spark, path)
    entries = A.registry_entries(rows, path)
    kind = F.substring("ledger_id", 8, 2).cast("int") % 4
    wrong = entries.withColumn(
        "manifest_sha256", F.when(kind == 1, F.sha2("manifest_sha256", 256)).otherwise(F.col("manifest_sha256"))
    )
    registry = wrong.where(kind != 3).unionByName(wrong.where(kind == 2))
    return A.registry_pin_match(rows, registry)


@query(
    "manifest_write",
    f"""{_TREE}, {_COUNTS} SELECT ledger_id, 'evledger.archive_manifest.v1' AS schema_version, byte_size, event_count, 10::BIGINT AS fields
    FROM counts""",
)
def manifest_write(spark, d):
    rows = A.load_manifests(spark, B.sealed_archive(spark, d))
    m = F.from_json("manifest", A._MANIFEST)
    return rows.select(
        "ledger_id",
        m["schema_version"].alias("schema_version"),
        m["archive"]["byte_size"].alias("byte_size"),
        m["archive"]["event_count"].alias("event_count"),
        F.json_object_keys("manifest").alias("k"),
    ).select("ledger_id", "schema_version", "byte_size", "event_count", F.size("k").cast("bigint").alias("fields"))


@query(
    "breakpoint_write",
    f"""{GAPPED} SELECT ledger_id, line, pos AS byte_offset, event_id, previous_event_id, expected_previous_hash,
      previous_hash AS actual_previous_hash, content_hash FROM breaks""",
)
def breakpoint_write(spark, d):
    path = B.sealed_archive(spark, d)
    return spark.read.parquet(f"{path}/breakpoints").drop("code", "message")


@query(
    "verify_report_write",
    f"""{_TREE}, {_COUNTS} SELECT ledger_id, breakpoint_count AS error_count, breakpoint_count = 0 AS valid, true AS seal_eligible
    FROM counts""",
)
def verify_report_write(spark, d):
    path = B.sealed_archive(spark, d)
    r = F.from_json(
        "report", "seal_eligible boolean, verification struct<error_count: bigint, valid: boolean>"
    )
    return spark.read.parquet(f"{path}/reports").select(
        "ledger_id",
        r["verification"]["error_count"].alias("error_count"),
        r["verification"]["valid"].alias("valid"),
        r["seal_eligible"].alias("seal_eligible"),
    )


@query(
    "transition_event",
    f"""{_TREE}, {_COUNTS} SELECT ledger_id, {_ARCHIVE_ID} AS archive_id, 'ledger_transition' AS event_type,
      'sealed_archive' AS transition, sha256, byte_size, breakpoint_count, true AS starts_chain, true AS hash_ok, true AS manifest_ref_ok
    FROM counts JOIN digests USING (ledger_id)""",
)
def transition_event(spark, d):
    from evledger.functions.canonical import content_hash

    rows = A.load_manifests(spark, B.sealed_archive(spark, d))
    events = H.chain_lines(A.transition_events(rows, B.SEALED_AT))
    p = F.from_json(
        "payload",
        "transition string, archive_id string, breakpoint_count bigint,"
        " archive_ledger_ref struct<ledger_id: string, sha256: string, byte_size: bigint>,"
        " archive_manifest_ref struct<path: string, sha256: string>",
    )
    pinned = F.broadcast(rows.select(F.col("ledger_id").alias("_of"), F.col("manifest_sha256").alias("_pin")))
    ref = F.col("p.archive_manifest_ref")
    joined = events.withColumn("p", p).join(pinned, F.col("p.archive_ledger_ref.ledger_id") == F.col("_of"))
    return joined.select(
        (ref["path"].endswith("/manifests") & (ref["sha256"] == F.col("_pin"))).alias("manifest_ref_ok"),
        F.col("p.archive_ledger_ref.ledger_id").alias("ledger_id"),
        F.col("p.archive_id").alias("archive_id"),
        "event_type",
        F.col("p.transition").alias("transition"),
        F.col("p.archive_ledger_ref.sha256").alias("sha256"),
        F.col("p.archive_ledger_ref.byte_size").alias("byte_size"),
        F.col("p.breakpoint_count").alias("breakpoint_count"),
        F.col("previous_hash").isNull().alias("starts_chain"),
        (content_hash(F.col("value")) == F.col("content_hash")).alias("hash_ok"),
    )


@query(
    "archive_read",
    f"""{GAPPED} SELECT ledger_id, line, pos AS byte_offset, event_id, source, event_type, project, content_hash FROM gapped
    WHERE source = 'browser'""",
)
def archive_read(spark, d):
    events, _, _ = A.archive_batches(
        spark, B.sealed_archive(spark, d), sources=["browser"], max_bytes=1 << 40, width=BYTES
    )
    return events.select(
        "ledger_id", "line", "byte_offset", "event_id", "source", "event_type", "project", "content_hash"
    )


@query(
    "breakpoint_match",
    f"""{GAPPED} SELECT ledger_id, 'previous_hash_mismatch' AS code, pos AS byte_offset, line, event_id, true AS recorded FROM breaks""",
)
def breakpoint_match(spark, d):
    _, _, warnings = A.archive_batches(spark, B.sealed_archive(spark, d), max_bytes=1 << 40, width=BYTES)
    return warnings.drop("message")


@query(
    "archive_tail",
    f"""{GAPPED} SELECT ledger_id, line, event_id, event_type FROM gapped WHERE event_type = 'view'
    QUALIFY row_number() OVER (PARTITION BY ledger_id ORDER BY seq DESC) <= 7""",
)
def archive_tail(spark, d):
    return A.archive_tail(spark, B.sealed_archive(spark, d), 7, event_type="view").select(
        "ledger_id", "line", "event_id", "event_type"
    )


@query(
    "breakpoint_set_equal",
    f"""{GAPPED} SELECT ledger_id, bool_and(NOT (line % 2 = 0 AND right(ledger_id, 1) = '7')) AS breakpoints_match
    FROM breaks GROUP BY ledger_id""",
)
def breakpoint_set_equal(spark, d):
    """Recorded breaks against themselves with a few of one kind altered."""
    breaks = spark.read.parquet(f"{B.sealed_archive(spark, d)}/breakpoints")
    altered = breaks.withColumn(
        "event_id",
        F.when((F.col("line") % 2 == 0) & F.col("ledger_id").endswith("7"), F.lit("evt_x")).otherwise(
            F.col("event_id")
        ),
    )
    return A.breakpoint_set_equal(altered, breaks)


#: Ledgers whose sealed text `damaged_archive` leaves alone.
_SOUND = "(right(ledger_id, 2)::INT % 5 <> 3)"


def damaged_archive(spark, d):
    """An archive of its own; after the seal the second line of every fifth ledger changed."""

    def make():
        path = scratch_path(spark, "archive-damaged")
        A.seal(B.gapped_table(spark, d), path, sealed_at=B.SEALED_AT, active="/ledgers/active")
        # Only the folders of the ledgers that change are written again.
        fifth = F.right("ledger_id", F.lit(2)).cast("int") % 5 == 3
        other = F.replace(F.col("value").cast("string"), F.lit("/work/"), F.lit("/Work/")).cast("binary")
        value = F.when(F.col("line") == 2, other).otherwise(F.col("value"))
        lines = materialize(A.archive_lines(spark, path).where(fifth).withColumn("value", value), "damaged-lines")
        writer = lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        writer.partitionBy("ledger_id").parquet(f"{path}/lines")
        return path

    return B.shared(spark, d, "archive-damaged", make)


@query(
    "verify_archive",
    f"""{_TREE}, {_COUNTS} SELECT ledger_id, {_ARCHIVE_ID} AS archive_id, {_SOUND} AS ledger_sha256_matches_manifest,
      true AS manifest_sha256_matches_registry, true AS recorded_breakpoints_match,
      CASE WHEN {_SOUND} THEN 0 ELSE 1 END::BIGINT AS fatal_error_count,
      breakpoint_count AS accepted_breakpoint_count, {_SOUND} AS valid FROM counts""",
)
def verify_archive(spark, d):
    """Every fifth ledger was changed after sealing; the others still verify."""
    path = damaged_archive(spark, d)
    registry = A.registry_entries(A.load_manifests(spark, path), path)
    return A.verify_archive(spark, path, registry).drop("manifest_sha256", "state_sidecar_matches_manifest")
