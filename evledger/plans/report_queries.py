"""Metrics, health, audit and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evledger.operators import audit as U
from evledger.operators import health as K
from evledger.operators import read as R
from evledger.operators.policy import CapturePolicy
from evledger.plans import base as B
from evledger.plans import source_queries as Q
from evledger.plans.base import CHAIN, ENV, LINES, query, table
from evledger.session import materialize, scratch_path, spread
from evledger.sources import transcripts as A
from evledger.sources.growing import line_stream
from evledger.streaming import live as V

# -- metrics -----------------------------------------------------------------


def polls(spark, d):
    n = F.col("event_id")
    failed = (F.col("event_type") == "error") & (n % 97 == 5)
    return table(spark, d, "events").select(
        F.col("event_type").alias("name"),
        n.alias("run"),
        (F.col("user_id") % 5).alias("events"),
        (n % 3).alias("skipped"),
        (n % 2).alias("redactions"),
        (n % 100).alias("tracked_files"),
        (n % 90).alias("available_files"),
        F.when(failed, F.concat(F.lit("ValueError: "), n.cast("string"))).alias("error"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
    )


_METRICS = """polls AS (SELECT event_type AS name, event_id AS run, user_id % 5 AS events, event_id % 3 AS skipped, event_id % 2 AS redactions,
    event_id % 100 AS tracked, event_id % 90 AS available,
    CASE WHEN event_type = 'error' AND event_id % 97 = 5 THEN 'ValueError: ' || event_id END AS error,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events),
metrics AS (SELECT name, count(*) AS runs, sum(events)::BIGINT AS events, sum(skipped)::BIGINT AS skipped, sum(redactions)::BIGINT AS redactions,
    arg_max(tracked, run) FILTER (WHERE error IS NULL) AS tracked_files, arg_max(available, run) FILTER (WHERE error IS NULL) AS available_files,
    count(error) AS errors, arg_max(error, run) AS last_error, arg_max(ts, run) AS last_run_ts FROM polls GROUP BY name),
coverage AS (SELECT count(*) AS source_count, count(*) FILTER (WHERE errors = 0) AS healthy_source_count, sum(events)::BIGINT AS events,
    sum(skipped)::BIGINT AS skipped, sum(redactions)::BIGINT AS redactions, sum(tracked_files)::BIGINT AS tracked_files,
    sum(available_files)::BIGINT AS available_files FROM metrics)"""


@query("source_metrics", f"WITH {_METRICS} SELECT * FROM metrics")
def source_metrics(spark, d):
    return K.source_metrics(polls(spark, d))


@query("source_coverage", f"WITH {_METRICS} SELECT * FROM coverage")
def source_coverage(spark, d):
    return K.source_coverage(K.source_metrics(polls(spark, d)))


@query(
    "source_metrics_write",
    f"""WITH {_METRICS} SELECT name, runs, events, errors FROM metrics
    UNION ALL SELECT 'total', source_count, events, source_count - healthy_source_count FROM coverage""",
)
def source_metrics_write(spark, d):
    """Per-source rows and the totals, written and read back."""
    metrics = materialize(K.source_metrics(polls(spark, d)), "metrics")
    total = K.source_coverage(metrics).select(
        F.lit("total").alias("name"),
        F.col("source_count").alias("runs"),
        "events",
        (F.col("source_count") - F.col("healthy_source_count")).alias("errors"),
    )
    path = scratch_path(spark, "status")
    metrics.select("name", "runs", "events", "errors").unionByName(total).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query(
    "latency_percentile",
    """WITH l AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, max(value) AS max FROM events GROUP BY event_type)
    SELECT event_type, (v[(floor((n - 1) / 2) + 1)::INT] + v[(ceil((n - 1) / 2) + 1)::INT]) / 2 AS p50,
      v[(round_even((n - 1) * 0.95, 0) + 1)::INT] AS p95, max FROM l""",
)
def latency_percentile(spark, d):
    return K.latency_report(table(spark, d, "events"), "value", ("event_type",))


@query(
    "distinct_sources",
    f"""WITH {ENV} SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
    string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types FROM env""",
)
def distinct_sources(spark, d):
    return K.distinct_sources(B.envelope(spark, d)).select(
        F.array_join("sources", ",").alias("sources"), F.array_join("event_types", ",").alias("event_types")
    )


@query("latest_label", f"WITH {ENV} SELECT ts, source || '/' || event_type AS label FROM env ORDER BY seq DESC LIMIT 1")
def latest_label(spark, d):
    return K.latest_label(B.envelope(spark, d))


# -- health ------------------------------------------------------------------

_HEALTH_CURSOR = """SELECT 'cursor protocol' AS name, 'PASS' AS status, 'ledger_id=' || ledger_id || '; chain=' ||
  CASE WHEN count(*) = 1 THEN 'verified' ELSE 'partial' END AS detail FROM lines GROUP BY ledger_id"""
_HEALTH_RECENT = """SELECT 'recent events' AS name, 'PASS' AS status, 'sampled ' || least(5, (SELECT count(*) FROM env)) || '; latest '
  || ts || ' ' || source || '/' || event_type AS detail FROM (SELECT * FROM env ORDER BY seq DESC LIMIT 1)"""
_HEALTH_COVERAGE = """SELECT 'source coverage' AS name, CASE WHEN healthy_source_count = source_count THEN 'PASS' ELSE 'WARN' END AS status,
  'healthy ' || healthy_source_count || '/' || source_count || '; tracked_files=' || tracked_files || '; skipped=' || skipped
  || '; redactions=' || redactions AS detail FROM coverage"""


@query("health_cursor", f"{LINES} {_HEALTH_CURSOR}")
def health_cursor(spark, d):
    lines = B.ledger_table(spark, d)
    _, envelopes, _ = R.read_batches(lines, R.zero_cursors(lines), limit=1)
    return K.health_cursor(envelopes)


@query("health_recent", f"WITH {ENV} {_HEALTH_RECENT}")
def health_recent(spark, d):
    return K.health_recent(B.envelope(spark, d))


@query("health_coverage", f"WITH {_METRICS} {_HEALTH_COVERAGE}")
def health_coverage(spark, d):
    return K.health_coverage(K.source_coverage(K.source_metrics(polls(spark, d))))


_NOW = "2024-01-02T00:00:00Z"


@query(
    "health_freshness",
    f"""WITH s AS (SELECT event_id, greatest(0, epoch(TIMESTAMP '2024-01-02') - epoch(date_trunc('second', ts)))::BIGINT AS age FROM events)
    SELECT 'daemon status' AS name, CASE WHEN event_id % 7 = 0 THEN 'WARN' WHEN age <= 30 THEN 'PASS' ELSE 'WARN' END AS status,
      CASE WHEN event_id % 7 = 0 THEN 'unreadable: missing updated_ts' WHEN age <= 30 THEN 'updated ' || age || 's ago'
        ELSE 'stale: updated ' || age || 's ago (expected <= 30s)' END AS detail FROM s""",
)
def health_freshness(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    status = table(spark, d, "events").select(
        F.when(F.col("event_id") % 7 != 0, stamp).otherwise("").alias("updated_ts")
    )
    return K.health_freshness(status, F.to_timestamp(F.lit(_NOW)))


@query(
    "health_rollup",
    f"""{LINES}, {_METRICS}, c AS ({_HEALTH_CURSOR} UNION ALL {_HEALTH_RECENT} UNION ALL {_HEALTH_COVERAGE})
    SELECT 'normal' AS mode, max((status = 'FAIL')::INT) AS exit_code FROM c
    UNION ALL SELECT 'strict', max((status IN ('FAIL', 'WARN'))::INT) FROM c""",
)
def health_rollup(spark, d):
    checks = [health_cursor(spark, d), health_recent(spark, d), health_coverage(spark, d)]
    normal = K.health_rollup(*checks).withColumn("mode", F.lit("normal"))
    return normal.unionByName(K.health_rollup(*checks, strict=True).withColumn("mode", F.lit("strict")))


# -- audit -------------------------------------------------------------------

_PATH = """CASE doc_id % 7 WHEN 0 THEN '.evledger/d' || doc_id WHEN 1 THEN 'src/d' || doc_id || '.py' WHEN 2 THEN 'tests/d' || doc_id || '.md'
  WHEN 3 THEN 'docs/d' || doc_id || '.TXT' WHEN 4 THEN 'app/server.py' WHEN 5 THEN 'app/settings.py' ELSE 'x' || doc_id || '/LICENSE' END"""
_TEXT = r"""CASE doc_id % 4 WHEN 0 THEN text || ' sk-abcdefghijklmnopqrst' || doc_id WHEN 1 THEN text || ' api_key: ''abcdefghijkl' || doc_id || ''''
  WHEN 2 THEN text || ' /Home/mira/private/x' ELSE text || ' f:\vault\y' END"""
_R1 = r"sk-[A-Za-z0-9_-]{20,}"
_R2 = r"""(?i)\b(api[_-]?key|secret|password)\s*[:=]\s*['\"]?[A-Za-z0-9_./+=-]{12,}"""
_SQL_R2 = _R2.replace("'", "''")
_P = [r"(?i)/home/[a-z]+/private", r"(?i)F:\\vault"]

_AUDIT = (
    f"""WITH t AS (SELECT doc_id, {_PATH} AS path, {_TEXT} AS body FROM documents),
open AS (SELECT * FROM t WHERE doc_id % 7 NOT IN (0, 3))
SELECT path, 'private tracked path: ' || path AS issue FROM t WHERE doc_id % 7 = 0
UNION ALL SELECT path, 'possible secret in ' || path || ': {_R1}' FROM open WHERE regexp_matches(body, '{_R1}')
UNION ALL SELECT path, 'possible secret in ' || path || ': {_SQL_R2}' FROM open WHERE regexp_matches(body, '{_SQL_R2}')
"""
    + "\n".join(
        f"UNION ALL SELECT path, 'private workstation path in ' || path || ': {p}' FROM open WHERE doc_id % 7 <> 2 AND regexp_matches(body, '{p}')"
        for p in _P
    )
    + """
UNION ALL SELECT path, 'unsafe safety guard in ' || path || ': no keys' FROM open WHERE path = 'app/server.py' AND contains(body, 'sk-')
UNION ALL SELECT path, 'missing safety guard in ' || path || ': token needed' FROM open WHERE path = 'app/settings.py' AND NOT contains(body, 'api_key')"""
)

GUARDS = (
    U.Guard("app/server.py", "sk-", "no keys"),
    U.Guard("app/settings.py", "api_key", "token needed", must_match=True),
)


@query("audit_scan", _AUDIT)
def audit_scan(spark, d):
    n = F.col("doc_id").cast("string")
    rest, kind = F.col("doc_id") % 7, F.col("doc_id") % 4
    path = (
        F.when(rest == 0, F.concat(F.lit(".evledger/d"), n))
        .when(rest == 1, F.concat(F.lit("src/d"), n, F.lit(".py")))
        .when(rest == 2, F.concat(F.lit("tests/d"), n, F.lit(".md")))
        .when(rest == 3, F.concat(F.lit("docs/d"), n, F.lit(".TXT")))
        .when(rest == 4, "app/server.py")
        .when(rest == 5, "app/settings.py")
        .otherwise(F.concat(F.lit("x"), n, F.lit("/LICENSE")))
    )
    text = (
        F.when(kind == 0, F.concat("text", F.lit(" sk-abcdefghijklmnopqrst"), n))
        .when(kind == 1, F.concat("text", F.lit(" api_key: 'abcdefghijkl"), n, F.lit("'")))
        .when(kind == 2, F.concat("text", F.lit(" /Home/mira/private/x")))
        .otherwise(F.concat("text", F.lit(" f:\\vault\\y")))
    )
    texts = spread(table(spark, d, "documents")).select(path.alias("path"), text.alias("text"))
    return U.audit_scan(texts, guards=GUARDS, private_paths=_P)


# -- streaming ---------------------------------------------------------------


def event_stream(spark, d):
    """``events`` as a stream of envelopes, all of it in one batch."""
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return B.to_envelope(rows)


@query("append_stream", f"{CHAIN} SELECT ledger_id, seq, previous_hash, content_hash FROM chain")
def append_stream(spark, d):
    ledger = scratch_path(spark, "stream-ledger")
    V.single_pass(V.append_stream(event_stream(spark, d), ledger, scratch_path(spark, "stream-cp"), once=True))
    return V.read_ledger(spark, ledger).select("ledger_id", "seq", "previous_hash", "content_hash")


@query(
    "stream_metrics",
    f"""WITH {ENV}, m AS (SELECT source, count(*) FILTER (WHERE project NOT LIKE 'user_1%') AS events,
        count(*) FILTER (WHERE project LIKE 'user_1%') AS skipped FROM env GROUP BY source)
    SELECT count(*) AS source_count, count(*) AS healthy_source_count, sum(events)::BIGINT AS events, sum(skipped)::BIGINT AS skipped,
      0::BIGINT AS redactions, 7 * count(*)::BIGINT AS tracked_files, 5 * count(*)::BIGINT AS available_files FROM m""",
)
def stream_metrics(spark, d):
    """One stream a source; its counts are observed while it appends and kept by a listener."""
    names = {"codex", "cursor", "browser"}
    path = scratch_path(spark, "metrics")
    listener = V.attach_metrics(spark, path, names, lambda name: (7, 5))
    policy = CapturePolicy(project_denylist=("user_1*",), redaction_enabled=False)
    try:
        running = [
            V.append_stream(
                event_stream(spark, d).where(F.col("source") == name), scratch_path(spark, f"metered-{name}"),
                scratch_path(spark, "metered-cp"), policy=policy, once=True, name=name,
            )
            for name in sorted(names)
        ]
        V.single_pass(*running)
        for query_ in running:
            listener.wait(query_)
    finally:
        spark.streams.removeListener(listener)
    return K.source_coverage(K.source_metrics(V.read_metrics(spark, path)))


@query(
    "clip_change_stream",
    f"WITH {Q._CLIPS} SELECT clip_key, pos, text AS raw_text, length(text)::VARCHAR AS chars FROM changes",
)
def clip_change_stream(spark, d):
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    clips = rows.select(
        F.col("user_id").cast("string").alias("clip_key"),
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "error", " ").otherwise(F.repeat("event_type", F.lit(3))).alias("text"),
    )
    out = scratch_path(spark, "clips")
    V.single_pass(V.clip_change_stream(clips, out, scratch_path(spark, "clips-cp"), once=True, width=500, ts=Q.AT))
    return V.read_clip_changes(spark, out).select(
        F.col("clip_key").cast("bigint").alias("clip_key"), "pos", "raw_text", *Q._payload("chars")
    )


@query(
    "tail_stream",
    f"SELECT event_type, project, count(*) AS n, sum(length(raw_text))::BIGINT AS chars, count(*) AS ids FROM ({Q._CLAUDE}) GROUP BY event_type, project",
)
def tail_stream(spark, d):
    """Lines that files gained, batch by batch, parsed in the stream; bad lines drop out."""
    source = scratch_path(spark, "segments")
    lines = Q.claude_lines(spark, d).select(F.xxhash64("path", "byte_offset").alias("byte_offset"), "text")
    broken = lines.select((-F.col("byte_offset") - 1).alias("byte_offset"), F.left("text", F.lit(20)).alias("text"))
    # Segment lines carry their place, as a shipper that cuts logs writes it.
    marked = lines.unionByName(broken).select(F.concat_ws("\t", F.col("byte_offset").cast("string"), "text").alias("value"))
    marked.write.text(source)
    # A third of a file a batch: budgets cut inside lines, and every pass restarts from the checkpoint.
    budget = spark.read.format("binaryFile").load(source).agg(F.max("length")).first()[0] // 3 + 1
    out, checkpoint = scratch_path(spark, "turns"), scratch_path(spark, "turns-cp")
    for _ in range(3):
        lines = line_stream(spark, source, f"{checkpoint}/places", glob="part-*", backfill=True, max_bytes=budget)
        rows = lines.select(
            "path",
            F.substring_index("text", "\t", 1).cast("long").alias("byte_offset"),
            F.expr("substr(text, instr(text, '\t') + 1)").alias("text"),
        )
        turns = A.claude_code_turns(rows, include_sidechain=True, max_chars=Q.MAX, ts=Q.AT)
        writer = turns.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        V.single_pass(writer.trigger(availableNow=True).start(out))
    return spark.read.parquet(out).groupBy("event_type", "project").agg(
        F.count("*").alias("n"), F.sum(F.length("raw_text")).alias("chars"), F.countDistinct("event_id").alias("ids")
    )


@query(
    "single_pass",
    f"""{CHAIN} SELECT 'a' AS ledger, ledger_id, count(*) AS n, max_by(content_hash, seq) AS last_hash FROM chain GROUP BY ledger_id
    UNION ALL SELECT 'b', ledger_id, count(*), max_by(content_hash, seq) FROM chain GROUP BY ledger_id""",
)
def single_pass(spark, d):
    """Two sources, one pass each, running side by side."""
    ledgers = {name: scratch_path(spark, f"pass-{name}") for name in ("a", "b")}
    running = [
        V.append_stream(event_stream(spark, d), path, scratch_path(spark, "pass-cp"), once=True)
        for path in ledgers.values()
    ]
    V.single_pass(*running)
    frames = [
        V.read_ledger(spark, path)
        .groupBy("ledger_id")
        .agg(F.count("*").alias("n"), F.max_by("content_hash", "seq").alias("last_hash"))
        .withColumn("ledger", F.lit(name))
        for name, path in ledgers.items()
    ]
    return frames[0].unionByName(frames[1])


@query(
    "cursor_stream",
    f"{LINES} SELECT ledger_id, rn AS line, event_id, content_hash FROM lines WHERE source = 'codex'",
)
def cursor_stream(spark, d):
    """Consumers of all ledgers resumed batch by batch until they caught up."""
    out = scratch_path(spark, "consumed")

    def consume(events, number):
        events.select("ledger_id", "line", "event_id", "content_hash").write.parquet(f"{out}/round={number}")

    lines = B.indexed_ledger(spark, d)
    size = lines.sizes().agg(F.max("ledger_size")).first()[0]
    V.cursor_stream(
        lines,
        scratch_path(spark, "positions"),
        consume,
        sources=["codex"],
        max_bytes=max(20_000, size // 3),
        projection="metadata",
    )
    return spark.read.parquet(out).drop("round")
