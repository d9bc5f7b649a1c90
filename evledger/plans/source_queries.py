"""Transcripts, shell history, clips, pages, adapters, notes and files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from evledger.operators.envelope import union_sources
from evledger.plans.base import query, table
from evledger.plans.event_queries import _WS
from evledger.session import scratch_path, spread
from evledger.sources import capture as C
from evledger.sources import files as T
from evledger.sources import tail as L
from evledger.sources import transcripts as A
from evledger.streaming import incremental as I
from evledger.streaming import watch
from evledger.streaming.live import read_ledger

MAX = 500
AT = "2024-01-01T00:00:00Z"


def _summary_sql(text: str) -> str:
    clean = f"trim(regexp_replace({text}, '{_WS}+', ' ', 'g'), ' ')"
    return f"CASE WHEN length({clean}) <= 120 THEN {clean} ELSE left({clean}, 119) || '...' END"


def _real(text: str) -> str:
    return f"regexp_replace({text}, '{_WS}+', '', 'g') <> ''"


_FLAT = ("event_type", "project", "cwd", "summary", "raw_text")


def _payload(*names: str):
    return [F.get_json_object("payload", f"$.{n}").alias(n) for n in names]


# -- transcripts -------------------------------------------------------------


def _json(**fields):
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def claude_lines(spark, d):
    """Conversations as agent transcript lines, string or block content."""
    block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit("run").alias("text"))
    n = F.col("conv_id").cast("string")
    cwd = F.when(F.col("conv_id") % 13 != 0, F.concat(F.lit("D:\\Work\\p"), (F.col("conv_id") % 11).cast("string")))

    def line(content):
        return _json(
            type=F.col("role"),
            isSidechain=F.col("conv_id") % 5 == 0,
            isMeta=F.col("turn") % 7 == 6,
            message=F.struct(F.col("role").alias("role"), content.alias("content")),
            cwd=cwd,
            sessionId=F.concat(F.lit("s"), n),
            uuid=F.concat_ws("-", F.lit("u"), n, F.col("turn").cast("string")),
            timestamp=F.lit("t0"),
            gitBranch=F.lit("main"),
        )

    text = F.when(F.col("turn") % 2 == 0, line(F.col("text"))).otherwise(line(F.array(tool, block)))
    return spread(table(spark, d, "conversations")).select(
        F.concat(F.lit("/claude/p/c"), n, F.lit(".jsonl")).alias("path"), F.col("turn").alias("byte_offset"), text.alias("text")
    )


_CLAUDE = f"""SELECT '/claude/p/c' || conv_id || '.jsonl' AS path, turn AS byte_offset, 'agent_' || role || '_turn' AS event_type,
  CASE WHEN conv_id % 13 = 0 THEN 'unknown' ELSE 'p' || conv_id % 11 END AS project,
  CASE WHEN conv_id % 13 = 0 THEN '/home' ELSE 'D:\\Work\\p' || conv_id % 11 END AS cwd,
  {_summary_sql(f'left(text, {MAX})')} AS summary, left(text, {MAX}) AS raw_text,
  's' || conv_id AS session_id, 'u-' || conv_id || '-' || turn AS uuid, 'main' AS git_branch,
  (length(text) > {MAX})::VARCHAR AS truncated, 'agent,claude-code' || CASE WHEN conv_id % 5 = 0 THEN ',sidechain' ELSE '' END AS tags
FROM conversations WHERE role IN ('user', 'assistant') AND turn % 7 <> 6 AND {_real('text')}"""


def claude(spark, d):
    return A.claude_code_turns(
        claude_lines(spark, d), include_sidechain=True, max_chars=MAX, home="/home", ts=AT
    )


@query("transcripts_claude_code", _CLAUDE)
def transcripts_claude_code(spark, d):
    return claude(spark, d).select(
        "path",
        "byte_offset",
        *_FLAT,
        *_payload("session_id", "uuid", "git_branch", "truncated"),
        F.array_join("tags", ",").alias("tags"),
    )


@query(
    "transcript_filters",
    f"""SELECT conv_id, turn FROM conversations
    WHERE role = 'user' AND turn % 7 <> 6 AND conv_id % 5 <> 0 AND {_real('text')}""",
)
def transcript_filters(spark, d):
    """Users only, no side chains."""
    turns = A.claude_code_turns(claude_lines(spark, d), include_assistant=False, ts=AT)
    return turns.select(
        F.regexp_extract("path", r"c(\d+)\.jsonl", 1).cast("bigint").alias("conv_id"),
        F.col("byte_offset").alias("turn"),
    )


def codex_lines(spark, d):
    """A session header before every fourth turn, then one message per turn."""
    n = F.col("conv_id").cast("string")
    session = F.concat_ws("_", F.lit("s"), n, (F.col("turn") - F.col("turn") % 4).cast("string"))
    header = F.when(
        F.col("turn") % 4 == 0,
        _json(
            timestamp=F.lit("t0"),
            type=F.lit("session_meta"),
            payload=F.struct(session.alias("id"), F.concat(F.lit("/work/q"), n).alias("cwd")),
        ),
    )
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "agent_message").otherwise(
        "token_count"
    )
    message = _json(
        timestamp=F.concat(F.lit("t"), F.col("turn").cast("string")),
        type=F.lit("event_msg"),
        payload=F.struct(kind.alias("type"), F.col("text").alias("message")),
    )
    rows = spread(table(spark, d, "conversations")).select(
        F.concat(F.lit("/codex/"), n, F.lit(".jsonl")).alias("path"),
        "turn",
        F.posexplode(F.array(header, message)).alias("part", "text"),
    )
    return rows.where(F.col("text").isNotNull()).select(
        "path", (F.col("turn") * 2 + F.col("part")).alias("byte_offset"), "text"
    )


_CODEX_WHERE = f"role IN ('user', 'assistant') AND {_real('text')}"
_CODEX = f"""SELECT '/codex/' || conv_id || '.jsonl' AS path, turn * 2 + 1 AS byte_offset,
  'agent_' || role || '_turn' AS event_type, 'q' || conv_id AS project, '/work/q' || conv_id AS cwd,
  {_summary_sql(f'left(text, {MAX})')} AS summary, left(text, {MAX}) AS raw_text,
  's_' || conv_id || '_' || (turn - turn % 4) AS session_id, 't' || turn AS orig_ts FROM conversations WHERE {_CODEX_WHERE}"""


def codex(spark, d):
    # a width of 8 positions makes sessions cross segments
    return A.codex_turns(codex_lines(spark, d), max_chars=MAX, ts=AT, width=8)


@query("transcripts_codex", _CODEX)
def transcripts_codex(spark, d):
    return codex(spark, d).select("path", "byte_offset", *_FLAT, *_payload("session_id", "orig_ts"))


@query(
    "session_ffill",
    """SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN role || turn END IGNORE NULLS)
      OVER (PARTITION BY conv_id ORDER BY turn) AS session FROM conversations""",
)
def session_ffill(spark, d):
    header = F.when(F.col("turn") % 3 == 0, F.concat("role", F.col("turn").cast("string")))
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("path"), F.col("turn").alias("byte_offset"), "role", "turn"
    )
    return A.session_ffill(rows, header, "session", width=2).select(F.col("path").alias("conv_id"), "turn", "session")


@query(
    "session_enrich",
    f"""SELECT conv_id, turn, 's_' || conv_id || '_' || (turn - turn % 4) AS session_id FROM conversations WHERE {_CODEX_WHERE}""",
)
def session_enrich(spark, d):
    return codex(spark, d).select(
        F.regexp_extract("path", r"(\d+)\.jsonl", 1).cast("bigint").alias("conv_id"),
        F.expr("(byte_offset - 1) div 2").alias("turn"),
        *_payload("session_id"),
    )


def cursor_lines(spark, d):
    n = F.col("conv_id").cast("string")
    path = F.concat(
        F.lit("/cursor/proj_"), (F.col("conv_id") % 9).cast("string"), F.lit("/agent-transcripts/x/c"), n, F.lit(".jsonl")
    )
    nested = _json(
        role=F.upper("role"), message=F.struct(F.col("text").alias("content")), timestamp=F.lit("t1")
    )
    flat = _json(
        role=F.col("role"),
        content=F.col("text"),
        sessionId=F.when(F.col("turn") % 3 == 0, F.concat(F.lit("own"), n)),
        ts=F.lit("t2"),
    )
    return spread(table(spark, d, "conversations")).select(
        path.alias("path"),
        F.col("turn").alias("byte_offset"),
        F.when(F.col("turn") % 2 == 0, nested).otherwise(flat).alias("text"),
    )


def cursor(spark, d):
    return A.cursor_turns(cursor_lines(spark, d), root="/cursor", max_chars=MAX, ts=AT)


_CURSOR = f"""SELECT '/cursor/proj_' || conv_id % 9 || '/agent-transcripts/x/c' || conv_id || '.jsonl' AS path,
  turn AS byte_offset, 'agent_' || role || '_turn' AS event_type, 'proj_' || conv_id % 9 AS project,
  '' AS cwd, {_summary_sql(f'left(text, {MAX})')} AS summary, left(text, {MAX}) AS raw_text,
  CASE WHEN turn % 6 = 3 THEN 'own' || conv_id ELSE 'c' || conv_id END AS session_id,
  CASE WHEN turn % 2 = 0 THEN 't1' ELSE 't2' END AS orig_ts, 'proj_' || conv_id % 9 AS workspace_key
FROM conversations WHERE {_CODEX_WHERE}"""


@query("transcripts_cursor", _CURSOR)
def transcripts_cursor(spark, d):
    return cursor(spark, d).select(
        "path", "byte_offset", *_FLAT, *_payload("session_id", "orig_ts", "workspace_key")
    )


@query(
    "tailer_plugin",
    f"""SELECT source, event_type, count(*) AS n, count(DISTINCT path) AS files FROM (
      SELECT 'claude-code' AS source, event_type, path FROM ({_CLAUDE}) UNION ALL
      SELECT 'codex', event_type, path FROM ({_CODEX}) UNION ALL
      SELECT 'cursor', event_type, path FROM ({_CURSOR})) GROUP BY source, event_type""",
)
def tailer_plugin(spark, d):
    """Every parser is ``DataFrame -> DataFrame``; their union shares one envelope."""
    events = union_sources(claude(spark, d), codex(spark, d), cursor(spark, d))
    return events.groupBy("source", "event_type").agg(
        F.count("*").alias("n"), F.countDistinct("path").alias("files")
    )


# -- shell history and clips -------------------------------------------------

_SHELL = f"""hist AS (SELECT conv_id, turn, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS line, turn % 3 = 1 AS more FROM conversations),
isl AS (SELECT *, coalesce(count(*) FILTER (WHERE NOT more) OVER (PARTITION BY conv_id ORDER BY turn
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM hist),
commands AS (SELECT conv_id, min(turn) AS first_turn, string_agg(line, chr(10) ORDER BY turn) AS command FROM isl GROUP BY conv_id, island),
kept AS (SELECT * FROM commands WHERE {_real('command')} AND NOT contains(command, 'the'))"""


def history_lines(spark, d):
    line = F.regexp_replace("text", r"[\r\n]+", " ")
    return table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("path"),
        F.lit(0).alias("poll"),
        F.col("turn").alias("byte_offset"),
        F.when(F.col("turn") % 3 == 1, F.concat(line, F.lit("`"))).otherwise(line).alias("text"),
    )


@query("join_continuations", f"WITH {_SHELL} SELECT conv_id::VARCHAR AS path, first_turn AS byte_offset, command FROM commands")
def join_continuations(spark, d):
    return C.join_continuations(history_lines(spark, d)).select("path", "byte_offset", "command")


@query("self_noise_filter", f"WITH {_SHELL} SELECT conv_id::VARCHAR AS path, first_turn AS byte_offset FROM kept")
def self_noise_filter(spark, d):
    commands = C.join_continuations(history_lines(spark, d))
    return C.self_noise_filter(commands, "the").select("path", "byte_offset")


_SHELL_EVENTS = f"""WITH {_SHELL}, n AS (SELECT conv_id, count(*) AS n FROM kept GROUP BY conv_id)
SELECT conv_id::VARCHAR AS path, 'shell_history_batch' AS event_type, 'Shell history batch: ' || count(*) || ' commands' AS summary,
  string_agg(command, chr(10) ORDER BY first_turn) AS raw_text, count(*)::VARCHAR AS count FROM kept JOIN n USING (conv_id) WHERE n > 2
GROUP BY conv_id
UNION ALL SELECT conv_id::VARCHAR, 'shell_command', {_summary_sql('command')}, command, NULL FROM kept JOIN n USING (conv_id) WHERE n <= 2"""


@query("shell_history", _SHELL_EVENTS)
def shell_history(spark, d):
    events = C.shell_history(history_lines(spark, d), own_name="the", batch_threshold=2, ts=AT)
    return events.select("path", "event_type", "summary", "raw_text", *_payload("count"))


@query(
    "shell_batch",
    f"SELECT path, count, raw_text FROM ({_SHELL_EVENTS}) WHERE event_type = 'shell_history_batch'",
)
def shell_batch(spark, d):
    events = C.shell_history(history_lines(spark, d), own_name="the", batch_threshold=2, ts=AT)
    batches = events.where(F.col("event_type") == "shell_history_batch")
    return batches.select("path", *_payload("count"), "raw_text")


_CLIPS = """clips AS (SELECT user_id AS clip_key, event_id AS pos, CASE event_type WHEN 'error' THEN ' ' ELSE
    repeat(event_type, 3) END AS text FROM events),
changes AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY clip_key ORDER BY pos) AS before FROM clips WHERE text <> ' ')
  WHERE before <> text)"""


def clips(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("clip_key"),
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "error", " ").otherwise(F.repeat("event_type", F.lit(3))).alias("text"),
    )


@query("consecutive_dedupe", f"WITH {_CLIPS} SELECT clip_key, pos, text FROM changes")
def consecutive_dedupe(spark, d):
    return C.consecutive_dedupe(clips(spark, d), ["clip_key"], "pos", "text", width=500)


@query(
    "clip_changes",
    f"""WITH {_CLIPS} SELECT clip_key, pos, left(text, 10) AS raw_text, length(text)::VARCHAR AS chars,
    (length(text) > 10)::VARCHAR AS truncated FROM changes""",
)
def clip_changes(spark, d):
    events = C.clip_changes(clips(spark, d), width=500, max_chars=10, ts=AT)
    return events.select("clip_key", "pos", "raw_text", *_payload("chars", "truncated"))


# -- pages, adapters, notes --------------------------------------------------

_TAGS = "'<[^>]*>'"
_PAGES = f"""p AS (SELECT page_id, url, regexp_replace(html, {_TAGS}, ' ', 'g') AS page_text, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  CASE WHEN page_id % 3 = 0 THEN 'picked ' || page_id ELSE ' ' END AS selection FROM pages)"""


def page_records(spark, d):
    return spread(table(spark, d, "pages")).select(
        "page_id",
        "url",
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("url", r"://([^/]+)", 1).alias("host"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("picked "), F.col("page_id").cast("string"))).otherwise(" ").alias("selection"),
        F.regexp_replace("html", r"<[^>]*>", " ").alias("page_text"),
    )


@query(
    "web_clips",
    f"""WITH {_PAGES}, e AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN selection ELSE left(page_text, 300) END AS raw_text FROM p)
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'web_clip' ELSE 'web_page' END AS event_type, raw_text,
      CASE WHEN title <> '' THEN title ELSE {_summary_sql('raw_text')} END AS summary,
      regexp_extract(url, '://([^/]+)', 1) AS host, url,
      CASE WHEN page_id % 3 = 0 THEN 'browser,extension,selection' ELSE 'browser,extension,page' END AS tags
    FROM e WHERE {_real('raw_text')}""",
)
def web_clips(spark, d):
    events = C.web_clips(page_records(spark, d), limit=300, ts=AT, keep=("page_id",))
    return events.select(
        "page_id", "event_type", "raw_text", "summary", *_payload("host", "url"), F.array_join("tags", ",").alias("tags")
    )


_KIND = "event_id % 4"


def adapter_documents(spark, d):
    """Single objects and arrays; with payload, loose keys, aliases, one tag."""
    n = F.col("event_id").cast("string")
    one = F.concat(F.lit('{"source": "feed", "event_type": "'), "event_type", F.lit('", "raw_text": "r'), n,
                   F.lit('", "tags": ["a", "b"], "payload": '), "props", F.lit(', "event_id": "evt_given", "content_hash": "x"}'))
    loose = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "text": "r'), n,
                     F.lit('", "tags": "solo", "rate": 1.50, "id": '), n, F.lit(', "privacy": {"scope": "team"}}'))
    rest = F.col("event_id") % 4
    doc = (
        F.when(rest == 0, one)
        .when(rest == 1, loose)
        .when(rest == 2, F.concat(F.lit("["), one, F.lit(", "), loose, F.lit("]")))
        .otherwise(F.lit("[]"))
    )
    return spread(table(spark, d, "events")).select(F.col("event_id").alias("doc_key"), doc.alias("document"))


@query(
    "adapter_ingest",
    f"""WITH r AS (SELECT event_id AS doc_key, 0 AS idx, 'one' AS shape, * FROM events WHERE {_KIND} IN (0, 2)
      UNION ALL SELECT event_id, CASE WHEN {_KIND} = 2 THEN 1 ELSE 0 END, 'loose', * FROM events WHERE {_KIND} IN (1, 2))
    SELECT doc_key, idx::INT AS idx, CASE shape WHEN 'one' THEN 'feed' ELSE 'adapter' END AS source, event_type, 'r' || event_id AS raw_text,
      CASE shape WHEN 'one' THEN 'a,b' ELSE 'solo' END AS tags,
      CASE shape WHEN 'one' THEN props ELSE '{{"rate": 1.5, "id": ' || event_id || '}}' END AS payload,
      CASE shape WHEN 'one' THEN 'local_only' ELSE 'team' END AS scope, true AS review_required, true AS minted FROM r""",
)
def adapter_ingest(spark, d):
    return C.adapter_ingest(adapter_documents(spark, d), ts=AT).select(
        "doc_key",
        F.col("index").alias("idx"),
        "source",
        "event_type",
        "raw_text",
        F.array_join("tags", ",").alias("tags"),
        "payload",
        F.col("privacy.scope").alias("scope"),
        F.col("privacy.review_required").alias("review_required"),
        F.col("event_id").rlike("^evt_[0-9a-f]{32}$").alias("minted"),
    )


@query(
    "manual_events",
    f"""SELECT doc_id AS note_id, 'note' AS source, lang AS event_type, source AS project, {_summary_sql('text')} AS summary,
      text AS raw_text, lang || '=x' AS lang, doc_id::VARCHAR AS n FROM documents""",
)
def manual_events(spark, d):
    notes = spread(table(spark, d, "documents")).select(
        F.col("doc_id").alias("note_id"),
        F.lit("note").alias("source"),
        F.col("lang").alias("event_type"),
        F.col("source").alias("project"),
        F.lit("/notes").alias("cwd"),
        F.lit("").alias("summary"),
        "text",
        F.array(F.lit("n")).alias("tags"),
        F.array(F.concat(F.lit("lang="), "lang", F.lit("=x")), F.concat(F.lit("n="), F.col("doc_id").cast("string"))).alias("fields"),
    )
    return C.manual_events(notes, ts=AT).select(
        "note_id", "source", "event_type", "project", "summary", "raw_text", *_payload("lang", "n")
    )


@query(
    "saved_clip_events",
    f"""SELECT page_id AS clip_id, CASE WHEN page_id % 2 = 0 THEN 'Title ' || page_id ELSE {_summary_sql('html')} END AS summary,
      url, CASE WHEN page_id % 2 = 0 THEN 'Title ' || page_id END AS title FROM pages""",
)
def saved_clip_events(spark, d):
    rows = spread(table(spark, d, "pages")).select(
        F.col("page_id").alias("clip_id"),
        F.lit("clip").alias("source"),
        F.lit("web").alias("project"),
        F.lit("/clips").alias("cwd"),
        F.col("html").alias("text"),
        "url",
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Title "), F.col("page_id").cast("string"))).otherwise("").alias("title"),
    )
    return C.saved_clip_events(rows, ts=AT).select("clip_id", "summary", *_payload("url", "title"))


@query(
    "command_run_events",
    f"""SELECT doc_id AS run_id, '$ run --doc ' || doc_id || chr(10) || 'exit_code=' || doc_id % 3 AS raw_text,
      '$ run --doc ' || doc_id || ' exit_code=' || doc_id % 3 AS summary, right(text, 4000) AS stdout_tail, lang AS stderr_tail,
      (doc_id % 3)::VARCHAR AS exit_code FROM documents""",
)
def command_run_events(spark, d):
    runs = spread(table(spark, d, "documents")).select(
        F.col("doc_id").alias("run_id"),
        F.col("source").alias("project"),
        F.lit("/work").alias("cwd"),
        F.array(F.lit("run"), F.lit("--doc"), F.col("doc_id").cast("string")).alias("command"),
        F.lit(False).alias("shell"),
        (F.col("doc_id") % 3).alias("exit_code"),
        F.col("n_chars").alias("duration_ms"),
        F.col("text").alias("stdout"),
        F.col("lang").alias("stderr"),
    )
    return C.command_run_events(runs, ts=AT).select(
        "run_id", "raw_text", "summary", *_payload("stdout_tail", "stderr_tail", "exit_code")
    )


@query(
    "git_snapshot_events",
    """SELECT o_orderkey AS state_id, 'Git snapshot for ' || CASE WHEN o_orderkey % 5 = 0 THEN 'here' ELSE 'r' || o_custkey END
      || ' on ' || CASE WHEN o_orderkey % 4 = 0 THEN 'detached' ELSE o_orderstatus END AS summary,
      'git_root=' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '/src/r' || o_custkey END || chr(10) || 'branch=' ||
      CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END || chr(10) || 'head=h' || o_orderkey || chr(10) || chr(10) ||
      '## s' || chr(10) || 'M' || chr(9) || o_orderpriority || chr(10) || '1 file' AS raw_text,
      CASE WHEN o_orderkey % 5 = 0 THEN '/tmp/here' ELSE '/src/r' || o_custkey END AS cwd FROM orders""",
)
def git_snapshot_events(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    states = table(spark, d, "orders").select(
        key.alias("state_id"),
        F.lit("git").alias("project"),
        F.lit("/tmp/here").alias("cwd"),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("/src/r"), cust)).alias("git_root"),
        F.when(key % 4 == 0, "").otherwise(F.col("o_orderstatus")).alias("branch"),
        F.concat(F.lit("h"), key.cast("string")).alias("head"),
        F.lit("## s").alias("status"),
        F.concat(F.lit("M\t"), "o_orderpriority").alias("names"),
        F.lit("1 file\n").alias("stat"),
        F.lit("").alias("cached_stat"),
    )
    return C.git_snapshot_events(states, ts=AT).select("state_id", "summary", "raw_text", "cwd")


# -- file snapshots ----------------------------------------------------------

_ORDERS = """f AS (SELECT o_orderkey AS k, 'root_' || o_custkey % 20 AS root, 'd' || o_custkey % 7 || '/o' || o_orderkey || '.txt' AS path,
    floor(o_totalprice * 100)::BIGINT AS size, epoch_us(o_orderdate)::BIGINT * 1000 AS mtime_ns FROM orders),
prev AS (SELECT * FROM f WHERE k % 10 <> 3),
cur AS (SELECT k, root, path, size + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS size,
          mtime_ns + CASE WHEN k % 11 = 4 THEN 1 ELSE 0 END AS mtime_ns FROM f WHERE k % 10 <> 7),
diff AS (SELECT root, path, change FROM (SELECT coalesce(p.root, c.root) AS root, coalesce(p.path, c.path) AS path,
    CASE WHEN p.path IS NULL THEN 'created' WHEN c.path IS NULL THEN 'deleted'
         WHEN p.size <> c.size OR p.mtime_ns <> c.mtime_ns THEN 'modified' END AS change
  FROM prev p FULL JOIN cur c ON p.root = c.root AND p.path = c.path) WHERE change IS NOT NULL)"""


def snapshots(spark, d):
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        key.alias("k"),
        F.concat(F.lit("root_"), (F.col("o_custkey") % 20).cast("string")).alias("root"),
        F.concat(F.lit("d"), (F.col("o_custkey") % 7).cast("string"), F.lit("/o"), key.cast("string"), F.lit(".txt")).alias("path"),
        F.floor(F.col("o_totalprice") * 100).alias("size"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("mtime_ns"),
    )
    k = F.col("k")
    current = rows.where(k % 10 != 7).withColumns(
        {
            "size": F.col("size") + F.when(k % 5 == 0, 1).otherwise(0),
            "mtime_ns": F.col("mtime_ns") + F.when(k % 11 == 4, 1).otherwise(0),
        }
    )
    return rows.where(k % 10 != 3), current


def changes(spark, d):
    previous, current = snapshots(spark, d)
    return T.snapshot_diff(previous, current, ("root", "path"))


@query("snapshot_diff", f"WITH {_ORDERS} SELECT root, path, change FROM diff")
def snapshot_diff(spark, d):
    return changes(spark, d)


@query("sorted_changes", f"WITH {_ORDERS} SELECT root, path, change FROM diff")
def sorted_changes(spark, d):
    return T.sorted_changes(changes(spark, d))


@query("paths_created", f"WITH {_ORDERS} SELECT path FROM cur EXCEPT SELECT path FROM prev")
def paths_created(spark, d):
    return T.paths_created(*snapshots(spark, d))


@query("paths_deleted", f"WITH {_ORDERS} SELECT path FROM prev EXCEPT SELECT path FROM cur")
def paths_deleted(spark, d):
    return T.paths_deleted(*snapshots(spark, d))


@query("paths_common", f"WITH {_ORDERS} SELECT path FROM prev INTERSECT SELECT path FROM cur")
def paths_common(spark, d):
    return T.paths_common(*snapshots(spark, d))


def _listed(sign: str, kind: str) -> str:
    return f"coalesce(string_agg('{sign} ' || path, chr(10) ORDER BY path) FILTER (WHERE change = '{kind}') || chr(10), '')"


@query(
    "change_batch",
    f"""WITH {_ORDERS} SELECT root, 'file_change_batch' AS event_type, 'File change batch: ' || count(*) || ' paths' AS summary,
      rtrim('watch_root=' || root || chr(10) || 'changed=' || count(*) || chr(10) || 'created=' || count(*) FILTER (WHERE change = 'created')
      || chr(10) || 'modified=' || count(*) FILTER (WHERE change = 'modified') || chr(10) || 'deleted='
      || count(*) FILTER (WHERE change = 'deleted') || chr(10) || chr(10) || {_listed('+', 'created')} || {_listed('~', 'modified')}
      || {_listed('-', 'deleted')}, chr(10)) AS raw_text, count(*) FILTER (WHERE change = 'created') AS created FROM diff GROUP BY root
    UNION ALL SELECT root, 'watch_baseline', 'Watch baseline for ' || count(*) || ' files',
      'watch_root=' || root || chr(10) || 'files=' || count(*), NULL FROM prev GROUP BY root""",
)
def change_batch(spark, d):
    previous, _ = snapshots(spark, d)
    batches = T.change_batches(changes(spark, d), ts=AT)
    base = T.watch_baseline(previous, ts=AT)
    created = F.size(F.from_json(F.get_json_object("payload", "$.changes.created"), "array<string>"))
    return (
        batches.unionByName(base)
        .withColumn("created", F.when(F.col("event_type") == "file_change_batch", created).cast("bigint"))
        .select("root", "event_type", "summary", "raw_text", "created")
    )


@query(
    "watch_stream",
    """WITH f AS (SELECT DISTINCT 'd' || doc_id // 50 AS folder, doc_id % 10 = 3 AS late FROM documents)
    SELECT 1::BIGINT AS version, 'watch_baseline' AS event_type, 'Watch baseline for ' || count(*) || ' files' AS summary,
      NULL::BIGINT AS created FROM f WHERE NOT late
    UNION ALL SELECT 2, 'file_change_batch', 'File change batch: ' || count(*) || ' paths', count(*) FROM f WHERE late HAVING count(*) > 0""",
)
def watch_stream(spark, d):
    """Three triggers over a folder that gains files after the first; each is a restart from the checkpoint."""
    root = scratch_path(spark, "watched")
    rows = spread(table(spark, d, "documents")).select(
        F.concat(F.lit("d"), F.floor(F.col("doc_id") / 50).cast("string")).alias("folder"), "doc_id", "text"
    )
    late = F.col("doc_id") % 10 == 3
    paths = [scratch_path(spark, f"watch-{name}") for name in ("state", "out", "checkpoint")]
    snapshot = lambda: T.tree_snapshot(spark, root, ["_SUCCESS", "*.crc"]).withColumn("root", F.lit("documents"))
    for added in (rows.where(~late), rows.where(late), None):
        if added is not None:
            added.repartition("folder").select("folder", F.concat("text", F.lit("")).alias("value")).write.mode("append").partitionBy(
                "folder"
            ).text(root)
        watch.watch_stream(spark, snapshot, *paths, once=True, ts=AT).awaitTermination()
    created = F.size(F.from_json(F.get_json_object("payload", "$.changes.created"), "array<string>"))
    return spark.read.parquet(paths[1]).select(
        (F.col("batch") + 1).cast("bigint").alias("version"),
        "event_type",
        "summary",
        F.when(F.col("event_type") == "file_change_batch", created).cast("bigint").alias("created"),
    )


_IGNORED = """CASE o_orderkey % 8 WHEN 0 THEN '.git/x' || o_custkey WHEN 1 THEN 'src/a' || o_custkey || '.pyc' WHEN 2 THEN 'node_modules'
  WHEN 3 THEN 'a/node_modules/x' || o_custkey WHEN 4 THEN 'deep/b.log' WHEN 5 THEN 'build2/x' || o_custkey
  WHEN 6 THEN 'own/x' || o_custkey ELSE 'src/m' || o_custkey || '.py' END"""


@query(
    "ignore_paths",
    f"""SELECT o_orderkey, {_IGNORED} AS path FROM orders WHERE o_orderkey % 8 IN (3, 5, 6, 7)""",
)
def ignore_paths(spark, d):
    rest, cust = F.col("o_orderkey") % 8, F.col("o_custkey").cast("string")
    path = (
        F.when(rest == 0, F.concat(F.lit(".git/x"), cust))
        .when(rest == 1, F.concat(F.lit("src/a"), cust, F.lit(".pyc")))
        .when(rest == 2, F.lit("node_modules"))
        .when(rest == 3, F.concat(F.lit("a/node_modules/x"), cust))
        .when(rest == 4, F.lit("deep/b.log"))
        .when(rest == 5, F.concat(F.lit("build2/x"), cust))
        .when(rest == 6, F.concat(F.lit("own\\x"), cust))
        .otherwise(F.concat(F.lit("src/m"), cust, F.lit(".py")))
    )
    files = table(spark, d, "orders").select("o_orderkey", path.alias("path"))
    return T.ignore_paths(files).select("o_orderkey", F.replace("path", F.lit("\\"), F.lit("/")).alias("path"))


def document_tree(spark, d):
    """Documents as files: 50 per folder, so a file stays small at any scale."""
    from evledger.plans.base import shared

    def make():
        path = scratch_path(spark, "tree")
        rows = spread(table(spark, d, "documents")).select(
            F.concat(F.lit("d"), F.floor(F.col("doc_id") / 50).cast("string")).alias("folder"), "doc_id", "text"
        )
        (
            rows.repartition("folder")
            .sortWithinPartitions("folder", "doc_id")
            .select("folder", F.concat("text", F.lit("")).alias("value"))
            .write.partitionBy("folder")
            .text(path)
        )
        return path

    return shared(spark, d, "tree", make)


@query(
    "tree_snapshot",
    "SELECT 'd' || doc_id // 50 AS folder, sum(strlen(text) + 1)::BIGINT AS size, 1::BIGINT AS files FROM documents GROUP BY folder",
)
def tree_snapshot(spark, d):
    files = T.tree_snapshot(spark, document_tree(spark, d), ["_SUCCESS", "*.crc"])
    folder = F.regexp_extract("path", r"folder=([^/]+)/", 1).alias("folder")
    return files.groupBy(folder).agg(F.sum("size").alias("size"), F.count("*").alias("files"))


@query(
    "file_artifacts",
    """SELECT 'd' || doc_id // 50 AS folder, true AS "exists", sum(strlen(text) + 1)::BIGINT AS size,
      sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY folder
    UNION ALL SELECT DISTINCT 'gone' || doc_id // 50, false, NULL, NULL FROM documents""",
)
def file_artifacts(spark, d):
    root = document_tree(spark, d)
    listed = L.discover_files(spark, root, "part-*").select("path")
    folder = F.regexp_extract("path", r"folder=([^/]+)/", 1)
    gone = listed.select(F.concat(F.lit("/nowhere/folder=gone"), F.substring(folder, 2, 20), F.lit("/f")).alias("path"))
    requested = listed.unionByName(gone).withColumn("kind", F.lit("file"))
    return T.file_artifacts(spark, requested, root).select(folder.alias("folder"), "exists", "size", "sha256")


@query(
    "discover_files",
    "SELECT DISTINCT 'd' || doc_id // 50 AS folder FROM documents",
)
def discover_files(spark, d):
    files = L.discover_files(spark, document_tree(spark, d), "part-*")
    return files.select(F.regexp_extract("path", r"folder=([^/]+)/", 1).alias("folder"))


# -- incremental tails -------------------------------------------------------


def line_files(spark, d):
    """Single-line documents as text files, 50 per file."""
    from evledger.plans.base import shared

    def make():
        path = scratch_path(spark, "lines")
        rows = spread(table(spark, d, "documents")).select(
            F.concat(F.lit("d"), F.floor(F.col("doc_id") / 50).cast("string")).alias("folder"),
            "doc_id",
            F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("value"),
        )
        rows.repartition("folder").sortWithinPartitions("folder", "doc_id").select("folder", "value").write.partitionBy(
            "folder"
        ).text(path)
        return path

    return shared(spark, d, "line-files", make)


_TAIL = """l AS (SELECT 'd' || doc_id // 50 AS folder, doc_id, doc_id || ':' || sha256(text) AS line FROM documents),
pos AS (SELECT *, (sum(strlen(line) + 1) OVER (PARTITION BY folder ORDER BY doc_id))::BIGINT AS fin FROM l)"""


@query(
    "tail_new_lines",
    f"""WITH {_TAIL} SELECT folder, doc_id, line FROM pos WHERE fin > 500 AND fin <= 500 + 1500 AND fin - strlen(line) - 1 >= 500
    UNION ALL SELECT folder, doc_id, substr(line, (500 - (fin - strlen(line) - 1) + 1)::BIGINT) FROM pos
    WHERE fin > 501 AND fin - strlen(line) - 1 < 500""",
)
def tail_new_lines(spark, d):
    """New lines past byte 500 of every file, within a byte budget."""
    root = line_files(spark, d)
    lines = L.source_lines(spark, root, "part-*")
    starts = lines.select("path").distinct().withColumn("start", F.lit(500).cast("bigint"))
    pieces, _ = L.tail_new_lines(lines, starts, 1500)
    folder = F.regexp_extract("path", r"folder=([^/]+)/", 1).alias("folder")
    whole = lines.select(
        "path", F.col("byte_offset").alias("_at"), F.col("byte_len"), F.col("value").cast("string").alias("_line")
    )
    joined = pieces.join(whole, "path").where(
        (F.col("byte_offset") >= F.col("_at")) & (F.col("byte_offset") < F.col("_at") + F.col("byte_len"))
    )
    doc = F.regexp_extract("_line", r"^(\d+):", 1).cast("bigint").alias("doc_id")
    return joined.select(folder, doc, F.col("text").alias("line"))


@query(
    "capture_incremental",
    """SELECT 'agent_' || role || '_turn' AS event_type, 'conv_' || conv_id AS project, 's' || conv_id AS session_id,
      left(text, 6000) AS raw_text, 1 AS ids FROM conversations
    WHERE role IN ('user', 'assistant') AND regexp_matches(text, '[^\\s]')""",
)
def capture_incremental(spark, d):
    """Session files taken in several polls of a few kilobytes into one chained ledger.

    Each conversation follows its session header; most polls start between a header
    and its messages.  ``ids`` counts events of an id.
    """
    rows = table(spark, d, "conversations")
    cwd = F.concat(F.lit("/work/conv_"), F.col("conv_id").cast("string")).alias("cwd")
    session = F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("id")
    header = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(cwd, session).alias("payload")))
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "agent_message").otherwise("other")
    message = F.struct(kind.alias("type"), F.col("text").alias("message"))
    turn = F.to_json(F.struct(F.lit("event_msg").alias("type"), message.alias("payload")))
    folder = (F.col("conv_id") % 16).alias("folder")
    lines = rows.select(folder, "conv_id", "turn", turn.alias("line")).unionByName(
        rows.select(folder, "conv_id", F.lit(-1).cast("long").alias("turn"), header.alias("line")).distinct()
    )
    root = scratch_path(spark, "sessions")
    parted = lines.repartition(16, "folder").sortWithinPartitions("folder", "conv_id", "turn")
    parted.select("folder", "line").write.partitionBy("folder").text(root)
    size = lines.groupBy("folder").agg(F.sum(F.octet_length("line") + 1).alias("n")).agg(F.max("n")).first()[0]
    longest = lines.agg(F.max(F.octet_length("line") + 1)).first()[0]
    spec = replace(I.codex(root), layout=".*", glob="part-*")
    state, ledger = scratch_path(spark, "capture-state"), scratch_path(spark, "capture-ledger")
    while not I.capture_once(
        spark, [spec], state, ledger, backfill=True, max_bytes=max(longest, size // 2 + 1)
    ).isEmpty():
        pass
    events = read_ledger(spark, ledger)
    counts = events.groupBy(F.col("event_id").alias("_id")).agg(F.count("*").cast("int").alias("ids"))
    return events.join(counts, F.col("event_id") == F.col("_id")).select(
        "event_type", "project", F.get_json_object("payload", "$.session_id").alias("session_id"), "raw_text", "ids"
    )


@query(
    "source_state_save",
    f"""WITH {_TAIL} SELECT folder, max(fin) AS "offset" FROM pos WHERE fin <= 2000 GROUP BY folder""",
)
def source_state_save(spark, d):
    """Offsets after one budgeted read, saved and loaded."""
    root = line_files(spark, d)
    lines = L.source_lines(spark, root, "part-*")
    starts = lines.select("path").distinct().withColumn("start", F.lit(500).cast("bigint"))
    _, moved = L.tail_new_lines(lines, starts, 1500)
    path = scratch_path(spark, "state")
    L.save_source_state(moved.withColumn("tailer", F.lit("lines")), path)
    return L.load_source_state(spark, path)[0].select(F.regexp_extract("path", r"folder=([^/]+)/", 1).alias("folder"), "offset")


@query(
    "state_lookup",
    """SELECT o_orderkey, o_orderkey % 3 = 0 AS seen, CASE WHEN o_orderkey % 3 = 0 THEN
      CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END ELSE o_custkey END::BIGINT AS start FROM orders""",
)
def state_lookup(spark, d):
    """Saved offsets (some past the end: truncated files); new files baseline."""
    orders = table(spark, d, "orders")
    path = F.col("o_orderkey").cast("string").alias("path")
    files = orders.select(path, F.col("o_custkey").alias("size"))
    known = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 9)
    state = orders.where(F.col("o_orderkey") % 3 == 0).select(
        F.lit("t").alias("tailer"), path, known.alias("offset")
    )
    rows = L.start_offsets(L.state_lookup(files, state, "t"), first_run=True)
    return rows.select(F.col("path").cast("bigint").alias("o_orderkey"), "seen", "start")


@query(
    "baseline_start",
    """SELECT o_orderkey, o_custkey AS first_run, 0::BIGINT AS backfill, 0::BIGINT AS later FROM orders""",
)
def baseline_start(spark, d):
    orders = table(spark, d, "orders")
    files = orders.select(
        F.col("o_orderkey").cast("string").alias("path"),
        F.col("o_custkey").alias("size"),
        F.lit(None).cast("bigint").alias("offset"),
        F.lit(False).alias("seen"),
    )
    out = L.start_offsets(files, first_run=True).withColumnRenamed("start", "first_run")
    out = L.start_offsets(out, first_run=True, backfill=True).withColumnRenamed("start", "backfill")
    out = L.start_offsets(out, first_run=False).withColumnRenamed("start", "later")
    return out.select(F.col("path").cast("bigint").alias("o_orderkey"), "first_run", "backfill", "later")


@query(
    "truncation_reset",
    """SELECT o_orderkey, CASE WHEN o_custkey < o_orderkey % 2000 THEN 0 ELSE o_orderkey % 2000 END::BIGINT AS start FROM orders""",
)
def truncation_reset(spark, d):
    files = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("path"),
        F.col("o_custkey").alias("size"),
        (F.col("o_orderkey") % 2000).alias("offset"),
        F.lit(True).alias("seen"),
    )
    return L.start_offsets(files, first_run=False).select(F.col("path").cast("bigint").alias("o_orderkey"), "start")


@query(
    "partial_line_hold",
    f"""WITH {_TAIL} SELECT folder, doc_id FROM pos
    WHERE NOT (doc_id % 50 = 49 AND (doc_id // 50) % 2 = 0) AND doc_id < (SELECT max(doc_id) // 50 * 50 + 50 FROM documents)""",
)
def partial_line_hold(spark, d):
    """The last line of every second file has no newline yet and waits."""
    lines = L.source_lines(spark, line_files(spark, d), "part-*")
    doc = F.regexp_extract(F.col("value").cast("string"), r"^(\d+):", 1).cast("bigint")
    unfinished = (doc % 50 == 49) & (F.floor(doc / 50) % 2 == 0)
    cut = lines.withColumn("terminated", F.col("terminated") & ~unfinished).withColumn(
        "byte_len", F.col("byte_len") - F.when(unfinished, 1).otherwise(0)
    )
    starts = lines.select("path").distinct().withColumn("start", F.lit(0).cast("bigint"))
    pieces, _ = L.tail_new_lines(cut, starts)
    return pieces.select(
        F.regexp_extract("path", r"folder=([^/]+)/", 1).alias("folder"),
        F.regexp_extract("text", r"^(\d+):", 1).cast("bigint").alias("doc_id"),
    )


@query(
    "file_coverage",
    """SELECT 't' || o_custkey % 5 AS tailer, count(*) AS tracked_files, count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS available_files
    FROM orders GROUP BY tailer""",
)
def file_coverage(spark, d):
    orders = table(spark, d, "orders")
    path = F.col("o_orderkey").cast("string").alias("path")
    state = orders.select(
        F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string")).alias("tailer"), path, F.lit(0).alias("offset")
    )
    return L.file_coverage(state, orders.where(F.col("o_orderkey") % 4 != 0).select(path))
