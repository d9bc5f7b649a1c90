"""Envelope, projection, filter, limit and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evledger.functions import canonical as C
from evledger.functions import redact as D
from evledger.functions import text as X
from evledger.operators import chain as H
from evledger.operators import policy as P
from evledger.operators import read as R
from evledger.operators.envelope import union_sources
from evledger.plans.base import CHAIN, ENV, LINES, chained, envelope, query, table
from evledger.session import spread

_FLAT = """ledger_id, seq, schema, event_id, ts, source, event_type, project, cwd, summary, raw_text,
  event_type || ',' || source AS tags, '[]' AS artifacts, props AS payload, 'local_only' AS scope,
  true AS review_required"""


def _flat(events):
    return events.select(
        *[c for c in events.columns if c not in ("tags", "privacy", "previous_hash")],
        F.array_join("tags", ",").alias("tags"),
        F.col("privacy.scope").alias("scope"),
        F.col("privacy.review_required").alias("review_required"),
    )


@query("build_event", f"WITH {ENV} SELECT {_FLAT} FROM env")
def build_event(spark, d):
    return _flat(envelope(spark, d))


@query("project_full", f"{CHAIN} SELECT {_FLAT}, previous_hash, content_hash FROM chain")
def project_full(spark, d):
    events = R.project_event(chained(spark, d), "full")
    return _flat(events).join(events.select("seq", "previous_hash"), "seq")


_META = """schema, event_id, ts, source, event_type, project, event_type || ',' || source AS tags,
  'local_only' AS scope, true AS review_required, previous_hash, content_hash"""


def _meta(events):
    return events.withColumns(
        {
            "tags": F.array_join("tags", ","),
            "scope": F.col("privacy.scope"),
            "review_required": F.col("privacy.review_required"),
        }
    ).drop("privacy")


@query("project_metadata", f"{CHAIN} SELECT {_META} FROM chain")
def project_metadata(spark, d):
    return _meta(R.project_event(chained(spark, d), "metadata"))


@query("project_summary", f"{CHAIN} SELECT {_META}, summary FROM chain")
def project_summary(spark, d):
    return _meta(R.project_event(chained(spark, d), "summary"))


_ID = "ledger_id, seq, event_id, source, event_type, project"
_IDS = ("ledger_id", "seq", "event_id", "source", "event_type", "project")


@query(
    "filter_events",
    f"""WITH {ENV} SELECT {_ID} FROM env
    WHERE source IN ('codex', 'browser') AND event_type IN ('click', 'error', 'view')""",
)
def filter_events(spark, d):
    return R.filter_events(
        envelope(spark, d), sources=["codex", "browser"], event_types=["click", "error", "view"]
    ).select(*_IDS)


@query(
    "tail_filter",
    f"""WITH {ENV} SELECT {_ID} FROM env WHERE source = 'cursor' AND event_type = 'click'
    ORDER BY seq DESC LIMIT 50""",
)
def tail_filter(spark, d):
    return R.tail_filter(envelope(spark, d), 50, source="cursor", event_type="click").select(*_IDS)


@query("limit_events", f"WITH {ENV} SELECT {_ID} FROM env ORDER BY seq LIMIT 100")
def limit_events(spark, d):
    return R.limit_events(envelope(spark, d), 100).select(*_IDS)


@query("tail_n", f"WITH {ENV} SELECT {_ID} FROM env ORDER BY seq DESC LIMIT 25")
def tail_n(spark, d):
    return R.tail_n(envelope(spark, d), 25).select(*_IDS)


@query(
    "union_sources",
    f"""WITH {ENV} SELECT {_ID} FROM env UNION ALL
    SELECT 'docs' AS ledger_id, doc_id AS seq, 'evt_doc_' || doc_id AS event_id, 'documents' AS source,
           'document' AS event_type, source AS project FROM documents""",
)
def union(spark, d):
    docs = table(spark, d, "documents").select(
        F.lit("docs").alias("ledger_id"),
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("evt_doc_"), F.col("doc_id").cast("string")).alias("event_id"),
        F.lit("documents").alias("source"),
        F.lit("document").alias("event_type"),
        F.col("source").alias("project"),
    )
    return union_sources(envelope(spark, d).select(*_IDS), docs)


# -- scalar functions --------------------------------------------------------

# White space as the engine sees it, spelled for RE2.
_WS = (
    r"[\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_CLEAN = f"trim(regexp_replace(text, '{_WS}+', ' ', 'g'), ' ')"


@query(
    "summarize",
    f"""SELECT doc_id, CASE WHEN length({_CLEAN}) <= 120 THEN {_CLEAN}
    ELSE left({_CLEAN}, 119) || '...' END AS summary FROM documents""",
)
def summarize(spark, d):
    return table(spark, d, "documents").select("doc_id", X.summarize(F.col("text")).alias("summary"))


@query(
    "optional_text",
    f"""SELECT doc_id, nullif(regexp_replace(regexp_replace(CASE WHEN doc_id % 9 = 0 THEN repeat(' ', (doc_id % 5)::INT)
      ELSE repeat(chr(10), (doc_id % 4)::INT) || text || repeat(' ', (doc_id % 3)::INT) END, '^{_WS}+', ''), '{_WS}+$', ''), '')
    AS value FROM documents""",
)
def optional_text(spark, d):
    """Whole texts with blanks around them, and texts of blanks only."""
    some = lambda mark, n: F.repeat(F.lit(mark), (F.col("doc_id") % n).cast("int"))
    padded = F.concat(some("\n", 4), "text", some(" ", 3))
    value = F.when(F.col("doc_id") % 9 == 0, some(" ", 5)).otherwise(padded)
    return table(spark, d, "documents").select("doc_id", X.optional_text(value).alias("value"))


_NAME = "CASE WHEN doc_id % 2 = 0 THEN source || ':' || lang || '-' || doc_id ELSE text END"


@query(
    "safe_identifier",
    f"""WITH v AS (SELECT doc_id, nullif(regexp_replace(regexp_replace({_NAME}, '^{_WS}+', ''), '{_WS}+$', ''), '') AS t
      FROM documents)
    SELECT doc_id, CASE WHEN t IS NULL THEN NULL
      WHEN length(t) <= 128 AND regexp_full_match(t, '[\\p{{L}}\\p{{N}}_.:\\-]+') THEN t
      ELSE 'invalid_identifier_sha256:' || sha256(t) END AS safe FROM v""",
)
def safe_identifier(spark, d):
    even = F.concat_ws("", "source", F.lit(":"), "lang", F.lit("-"), F.col("doc_id").cast("string"))
    name = F.when(F.col("doc_id") % 2 == 0, even).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.safe_identifier(name).alias("safe"))


@query(
    "safe_hash",
    """WITH v AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN upper(sha256(text)) WHEN 1 THEN left(sha256(text), 60)
      ELSE sha256(text) || 'g' END AS t FROM documents)
    SELECT doc_id, CASE WHEN regexp_full_match(t, '[0-9a-fA-F]{64}') THEN lower(t)
      ELSE 'invalid_hash_sha256:' || sha256(t) END AS safe FROM v""",
)
def safe_hash(spark, d):
    own = F.sha2("text", 256)
    given = (
        F.when(F.col("doc_id") % 3 == 0, F.upper(own))
        .when(F.col("doc_id") % 3 == 1, F.left(own, F.lit(60)))
        .otherwise(F.concat(own, F.lit("g")))
    )
    return table(spark, d, "documents").select("doc_id", X.safe_hash(given).alias("safe"))


@query(
    "derived_ledger_id",
    """SELECT doc_id, 'ledger_' || left(sha256('/ledgers/' || source || chr(0) || sha256(text)), 32) AS ledger_id
    FROM documents""",
)
def derived_ledger_id(spark, d):
    path = F.concat(F.lit("/ledgers/"), F.col("source"))
    return table(spark, d, "documents").select(
        "doc_id", X.derived_ledger_id(path, F.sha2("text", 256)).alias("ledger_id")
    )


@query(
    "truncate_text",
    "SELECT doc_id, left(text, 500) AS body, length(text) > 500 AS truncated FROM documents",
)
def truncate_text(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", X.truncate_text(text, 500).alias("body"), X.is_truncated(text, 500).alias("truncated")
    )


@query("tail_text", "SELECT doc_id, right(text, 4000) AS tail FROM documents")
def tail_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.tail_text(F.col("text")).alias("tail"))


@query(
    "basename_project",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'p' || o_custkey WHEN 1 THEN 'p' || o_custkey
      WHEN 2 THEN 'unknown' ELSE o_orderpriority END AS project FROM orders""",
)
def basename_project(spark, d):
    key = F.concat(F.lit("p"), F.col("o_custkey").cast("string"))
    rest = F.col("o_orderkey") % 4
    cwd = (
        F.when(rest == 0, F.concat(F.lit("/work/"), key))
        .when(rest == 1, F.concat(F.lit("D:\\work\\"), key, F.lit("\\")))
        .when(rest == 2, F.lit(""))
        .otherwise(F.concat(F.lit("/a\\b/"), F.col("o_orderpriority"), F.lit("//")))
    )
    return table(spark, d, "orders").select("o_orderkey", X.basename_project(cwd).alias("project"))


@query(
    "parse_key_values",
    """SELECT o_orderkey, o_orderstatus || '=x' AS status, o_orderpriority AS priority, 2::BIGINT AS n FROM orders""",
)
def parse_key_values(spark, d):
    pairs = F.array(
        F.concat(F.lit("priority="), F.col("o_orderstatus")),
        F.concat(F.lit(" status ="), F.col("o_orderstatus"), F.lit("=x")),
        F.concat(F.lit("priority="), F.col("o_orderpriority")),
    )
    kv = table(spark, d, "orders").select("o_orderkey", X.parse_key_values(pairs).alias("kv"))
    return kv.select(
        "o_orderkey",
        F.col("kv")["status"].alias("status"),
        F.col("kv")["priority"].alias("priority"),
        F.size("kv").cast("bigint").alias("n"),
    )


@query(
    "utc_iso",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso,
    epoch_us(date_trunc('second', ts))::BIGINT AS micros FROM events""",
)
def utc_iso(spark, d):
    iso = table(spark, d, "events").select("event_id", X.utc_iso(F.col("ts")).alias("iso"))
    return iso.withColumn("micros", F.unix_micros(X.parse_utc(F.col("iso"))))


@query(
    "event_id",
    """SELECT conv_id, turn, 'evt_' || left(sha256('conversations' || chr(0) || conv_id || chr(0) || turn), 32) AS event_id
    FROM conversations""",
)
def event_id(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", X.event_id(F.lit("conversations"), F.col("conv_id"), F.col("turn")).alias("event_id")
    )


@query(
    "extract_text_blocks",
    """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || chr(10) || role
      ELSE '' END AS body FROM conversations""",
)
def extract_text_blocks(spark, d):
    block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit("run").alias("text"))
    blank = F.struct(F.lit("text").alias("type"), F.lit(" \n").alias("text"))
    role = F.struct(F.lit("text").alias("type"), F.col("role").alias("text"))
    rest = F.col("turn") % 3
    content = (
        F.when(rest == 0, F.to_json(F.struct(F.col("text").alias("c"))))
        .when(rest == 1, F.to_json(F.struct(F.array(block, tool, blank, role).alias("c"))))
        .otherwise(F.to_json(F.struct(block.alias("c"))))
    )
    return (
        table(spark, d, "conversations")
        .withColumn("_v", F.try_variant_get(F.parse_json(content), "$.c", "variant"))
        .select("conv_id", "turn", X.extract_text_blocks(F.col("_v")).alias("body"))
    )


@query(
    "canonical_json",
    """SELECT event_id, '{"a":[1,2.50e3,null],"b":{"id":' || event_id || ',"é":"' || event_type || '"},"n":-0.0,"p":'
      || replace(props, ': ', ':') || '}' AS canonical FROM (SELECT * FROM events)""".replace("2.50e3", "2500.0"),
)
def canonical_json(spark, d):
    raw = F.concat(
        F.lit('{ "p" : '),
        F.col("props"),
        F.lit(', "n":-0.0, "b":{"\\u00e9":"'),
        F.col("event_type"),
        F.lit('", "id": '),
        F.col("event_id").cast("string"),
        F.lit('}, "a":[1, 2.50e3,null]}'),
    )
    return table(spark, d, "events").select("event_id", C.canonical_json(raw).alias("canonical"))


@query("content_hash", f"{CHAIN} SELECT ledger_id, seq, content_hash FROM chain")
def content_hash(spark, d):
    lines = H.chain_lines(chained(spark, d))
    return lines.select("ledger_id", "seq", C.content_hash(F.col("value")).alias("content_hash"))


@query("event_line", f"{LINES} SELECT ledger_id, seq, line_text AS line FROM lines")
def event_line(spark, d):
    lines = H.chain_lines(chained(spark, d))
    canonical = C.canonical_json(F.col("value"))
    return lines.select("ledger_id", "seq", C.event_line(canonical).alias("line"))


# -- redaction and policy ----------------------------------------------------

TOKEN_PATTERN = r'token = "[0-9a-f]+"'

_PLANTED = r"""CASE doc_id % 4
  WHEN 0 THEN text || ' API_KEY=k' || doc_id || '; Bearer abcdefghijkl' || doc_id
  WHEN 1 THEN 'password: p' || doc_id || ', ' || text || ' token = "abc' || doc_id || '"'
  WHEN 2 THEN text || chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'x' || chr(10) || '-----END RSA PRIVATE KEY-----'
  ELSE text END"""

_P0 = r"(?i)\b(api[_-]?key|access[_-]?token|refresh[_-]?token|password|secret)\s*[:=]\s*([^\s,;]+)"
_P1 = r"(?i)\bbearer\s+[a-z0-9._~+/=-]{12,}"
_P2 = r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"

REDACTED = rf"""planted AS (SELECT *, {_PLANTED} AS t FROM documents),
r0 AS (SELECT *, regexp_replace(t, '{_P0}', '\1=[REDACTED]', 'g') AS t0,
         len(regexp_extract_all(t, '{_P0}')) AS c0 FROM planted),
r1 AS (SELECT *, regexp_replace(t0, '{_P1}', 'Bearer [REDACTED]', 'g') AS t1,
         len(regexp_extract_all(t0, '{_P1}')) AS c1 FROM r0),
r2 AS (SELECT *, regexp_replace(t1, '{_P2}', '[REDACTED_PRIVATE_KEY]', 'g') AS t2,
         len(regexp_extract_all(t1, '{_P2}')) AS c2 FROM r1),
redacted AS (SELECT *, regexp_replace(t2, '{TOKEN_PATTERN}', '[REDACTED]', 'g') AS clean,
         (c0 + c1 + c2 + len(regexp_extract_all(t2, '{TOKEN_PATTERN}')))::BIGINT AS hits FROM r2)"""


def planted(spark, d):
    """Documents with secrets of every default shape planted."""
    n = F.col("doc_id").cast("string")
    rest = F.col("doc_id") % 4
    text = (
        F.when(rest == 0, F.concat("text", F.lit(" API_KEY=k"), n, F.lit("; Bearer abcdefghijkl"), n))
        .when(rest == 1, F.concat(F.lit("password: p"), n, F.lit(", "), "text", F.lit(' token = "abc'), n, F.lit('"')))
        .when(
            rest == 2,
            F.concat("text", F.lit("\n-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----")),
        )
        .otherwise(F.col("text"))
    )
    return spread(table(spark, d, "documents")).withColumn("planted", text)


@query("redact_text", f"WITH {REDACTED} SELECT doc_id, clean, hits FROM redacted")
def redact_text(spark, d):
    r = D.redact_text(F.col("planted"), (TOKEN_PATTERN,))
    return planted(spark, d).select("doc_id", r["text"].alias("clean"), r["count"].alias("hits"))


def document_events(spark, d):
    """Documents as events: project = source, a path and a scope by id."""
    from evledger.operators.envelope import build_event as build

    n = F.col("doc_id").cast("string")
    rows = planted(spark, d)
    rest = F.col("doc_id") % 6
    path = F.concat(F.lit("/Docs/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), n, F.lit(".txt"))
    payload = (
        F.when(rest == 0, F.concat(F.lit('{"transcript": "'), path, F.lit('"}')))
        .when(rest == 1, F.concat(F.lit('{"transcript": "", "path": "'), path, F.lit('"}')))
        .when(rest == 2, F.concat(F.lit('{"note": {"deep": ["secret=s'), n, F.lit('", "ok"]}}')))
        .otherwise(F.lit("{}"))
    )
    artifacts = F.when(
        rest == 3,
        F.concat(
            F.lit('[{"kind": "file", "path": "a'), n, F.lit('", "size": 20, "content": "b"}, 7]')
        ),
    ).otherwise(F.lit("[]"))
    return build(
        rows,
        source=F.lit("documents"),
        event_type=F.lit("document"),
        event_id=F.concat(F.lit("evt_doc_"), n),
        ts=F.lit("2024-01-01T00:00:00Z"),
        project=F.col("source"),
        cwd=path,
        summary=F.lit("document"),
        raw_text=F.col("planted"),
        tags=F.array(F.lit("doc"), F.concat(F.lit("secret=t"), n)),
        artifacts=artifacts,
        payload=payload,
        privacy_scope=F.when(F.col("doc_id") % 11 == 10, "cloud"),
        keep=("doc_id",),
    )


POLICY = P.CapturePolicy(
    project_allowlist=("SRC*",),
    project_denylist=("src1?",),
    path_allowlist=("/docs/*",),
    path_denylist=("*/en/src[57]/*",),
    custom_patterns=(TOKEN_PATTERN,),
    artifact_max_size=10,
)

_REASON = """CASE WHEN doc_id % 11 = 10 THEN 'privacy_scope_not_allowed:cloud'
  WHEN NOT lower(source) LIKE 'src%' THEN 'project_not_allowlisted'
  WHEN regexp_full_match(lower(source), 'src1.') THEN 'project_denied'
  WHEN NOT lower('/Docs/' || lang || '/') LIKE '/docs/%' THEN 'path_not_allowlisted'
  WHEN lang = 'en' AND source IN ('src5', 'src7') THEN 'path_denied' END"""


@query(
    "policy_decide",
    f"SELECT doc_id, {_REASON} AS reason, {_REASON} IS NULL AS accepted FROM documents",
)
def policy_decide(spark, d):
    return P.policy_decide(document_events(spark, d), POLICY).select("doc_id", "reason", "accepted")


@query(
    "glob_match",
    """SELECT doc_id, (lower(source) LIKE 'src1_' OR lower(source) = 'src3' OR regexp_full_match(source, 'src[^0-7]'))
    AS hit FROM documents""",
)
def glob_match(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.glob_match(F.upper("source"), ("SRC1?", "src3", "src[!0-7]")).alias("hit")
    )


@query(
    "source_path",
    "SELECT doc_id, '/Docs/' || lang || '/' || source || '/' || doc_id || '.txt' AS path FROM documents",
)
def source_path(spark, d):
    events = document_events(spark, d)
    other = F.when(F.col("doc_id") % 6 < 2, F.lit("/elsewhere")).otherwise(F.col("cwd"))
    return events.select("doc_id", X.source_path(F.col("payload"), other).alias("path"))


_PAYLOAD = """CASE doc_id % 6
  WHEN 0 THEN '{"transcript": "/Docs/' || lang || '/' || source || '/' || doc_id || '.txt"}'
  WHEN 1 THEN '{"transcript": "", "path": "/Docs/' || lang || '/' || source || '/' || doc_id || '.txt"}'
  WHEN 2 THEN '{"note": {"deep": ["secret=[REDACTED]", "ok"]}}' ELSE '{}' END"""
_ARTIFACTS = """CASE WHEN doc_id % 6 = 3
  THEN '[{"kind": "file", "path": "a' || doc_id || '", "size": 20, "policy_status": "oversize_reference"}]' ELSE '[]' END"""
# one hit in the tags of every document, one in the payload of every sixth
_HITS = "hits + 1 + CASE WHEN doc_id % 6 = 2 THEN 1 ELSE 0 END"


@query(
    "redact_event",
    f"""WITH {REDACTED} SELECT doc_id, clean AS raw_text, 'doc,secret=[REDACTED]' AS tags, {_PAYLOAD} AS payload,
    {_ARTIFACTS} AS artifacts, ({_HITS})::BIGINT AS redaction_count FROM redacted""",
)
def redact_event(spark, d):
    return P.redact_event(document_events(spark, d), POLICY).select(
        "doc_id", "raw_text", F.array_join("tags", ",").alias("tags"), "payload", "artifacts", "redaction_count"
    )


@query(
    "policy_annotations",
    f"""WITH {REDACTED} SELECT doc_id,
      rtrim({_PAYLOAD}, '}}') IS NOT NULL AND accepted AS annotated, hits AS n, policy
    FROM (SELECT *, {_REASON} IS NULL AS accepted, CASE WHEN {_REASON} IS NULL THEN
      'evledger.redaction.v1/' || ({_HITS})::VARCHAR || '/configured_secret_patterns/evledger.capture_policy.v1/references_only'
      END AS policy FROM redacted)""",
)
def policy_annotations(spark, d):
    done = P.apply_policy(document_events(spark, d), POLICY)
    doc = F.from_json(
        "payload",
        "redaction struct<schema_version: string, count: string, policy: string>,"
        " capture_policy struct<schema_version: string, artifact_mode: string>",
    )
    raw = D.redact_text(F.col("planted"), (TOKEN_PATTERN,))["count"]
    hits = planted(spark, d).select("doc_id", raw.alias("n"))
    return done.join(hits, "doc_id").select(
        "doc_id",
        F.col("accepted").alias("annotated"),
        "n",
        F.when(
            F.col("accepted"),
            F.concat_ws(
                "/",
                doc["redaction"]["schema_version"],
                doc["redaction"]["count"],
                doc["redaction"]["policy"],
                doc["capture_policy"]["schema_version"],
                doc["capture_policy"]["artifact_mode"],
            ),
        ).alias("policy"),
    )


@query(
    "redaction_totals",
    f"""WITH {REDACTED} SELECT project, count(*) FILTER (WHERE ok) AS events, count(*) FILTER (WHERE NOT ok) AS skipped,
      coalesce(sum(CASE WHEN ok THEN {_HITS} ELSE 0 END), 0)::BIGINT AS redactions
    FROM (SELECT *, lang AS project, {_REASON} IS NULL AS ok FROM redacted) GROUP BY project""",
)
def redaction_totals(spark, d):
    langs = table(spark, d, "documents").select("doc_id", F.col("lang"))
    decided = P.apply_policy(document_events(spark, d), POLICY).drop("project")
    return P.redaction_totals(
        decided.join(langs, "doc_id").withColumnRenamed("lang", "project"), ("project",)
    )


@query(
    "artifact_policy",
    """SELECT o_orderkey, 'file,a' || o_orderkey || ',true,' || (o_orderkey * 7)::VARCHAR || ',' ||
      CASE WHEN o_orderkey * 7 > 1000 THEN 'oversize_reference' ELSE 'none' END AS kept, 1::BIGINT AS n FROM orders""",
)
def artifact_policy(spark, d):
    item = F.struct(
        F.lit("file").alias("kind"),
        F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("path"),
        F.lit(True).alias("exists"),
        (F.col("o_orderkey") * 7).alias("size"),
        F.lit(None).cast("string").alias("sha256"),
        F.lit("stale").alias("policy_status"),
    )
    missing = F.lit(None).cast("struct<kind:string,path:string,exists:boolean,size:bigint,sha256:string,policy_status:string>")
    kept = table(spark, d, "orders").select(
        "o_orderkey", P.artifact_policy(F.array(item, missing), max_size=1000).alias("a")
    )
    a = F.col("a")[0]
    return kept.select(
        "o_orderkey",
        F.concat_ws(
            ",",
            a["kind"],
            a["path"],
            a["exists"].cast("string"),
            a["size"].cast("string"),
            F.coalesce(a["policy_status"], F.lit("none")),
        ).alias("kept"),
        F.size("a").cast("bigint").alias("n"),
    )


@query(
    "event_policy",
    f"WITH {ENV} SELECT {_ID} FROM env WHERE event_type <> 'error' AND seq % 5 <> 0",
)
def event_policy(spark, d):
    """A user callback ``DataFrame -> DataFrame`` placed in front of a ledger."""

    def drop_errors(events):
        return events.where((F.col("event_type") != "error") & (F.col("seq") % 5 != 0))

    return envelope(spark, d).transform(drop_errors).select(*_IDS)


@query(
    "custom_redaction_patterns",
    f"""SELECT doc_id, regexp_replace(text, '(?i)[a-z0-9]+@[a-z0-9.]+', '[REDACTED]', 'g') AS clean,
    len(regexp_extract_all(text, '(?i)[a-z0-9]+@[a-z0-9.]+'))::BIGINT AS hits FROM
    (SELECT doc_id, regexp_replace(text, '{_P0}|{_P1}|{_P2}', '', 'g') AS text FROM documents)""",
)
def custom_redaction_patterns(spark, d):
    java = "|".join((r"(?i)\b(api[_-]?key|access[_-]?token|refresh[_-]?token|password|secret)\s*[:=]\s*([^\s,;]+)", _P1, _P2))
    bare = F.regexp_replace("text", java, "")
    r = D.redact_text(bare, ("(?i)[a-z0-9]+@[a-z0-9.]+",))
    return table(spark, d, "documents").select("doc_id", r["text"].alias("clean"), r["count"].alias("hits"))
