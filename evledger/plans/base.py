"""Registry of named queries and the derivations they share.

Every query reads the given tables.  Where a ledger is needed it is derived
from ``events``: 32 ledgers by user, one event per row, chained in id order.
The SQL texts spell the same derivation for the correctness check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evledger.functions import text as X
from evledger.operators.archive import seal
from evledger.operators.chain import chain_build, chain_lines, write_ledger
from evledger.operators.envelope import build_event
from evledger.operators.index import IndexedLedger, index_ledger
from evledger.operators.verify import verify_errors
from evledger.session import materialize, scratch_path, ship_package, spread
from evledger.sources.lines import ledger_lines, scan_ledger

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source() -> Column:
    rest = F.col("_n") % 3
    return F.when(rest == 0, "codex").when(rest == 1, "cursor").otherwise("browser")


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as envelopes with (ledger_id, seq)."""
    return to_envelope(spread(table(spark, sf_dir, "events")))


def to_envelope(events: DataFrame) -> DataFrame:
    rows = events.select(
        F.format_string("ledger_%02d", F.col("user_id") % 32).alias("ledger_id"),
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("_n"),
        "ts",
        "event_type",
        "props",
        "user_id",
    )
    user = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    return build_event(
        rows,
        source=_source(),
        event_type=F.col("event_type"),
        event_id=F.concat(F.lit("evt_"), F.lpad(F.col("_n").cast("string"), 12, "0")),
        ts=X.utc_iso(F.col("ts")),
        project=user,
        cwd=F.concat(F.lit("/work/"), user),
        raw_text=F.concat(F.col("event_type"), F.repeat(F.lit(" detail"), (F.col("_n") % 40).cast("int"))),
        tags=F.array(F.col("event_type"), _source()),
        payload=F.col("props"),
        keep=("ledger_id", "seq"),
    )


ENV = """
env AS (
  SELECT 'ledger_' || lpad((user_id % 32)::VARCHAR, 2, '0') AS ledger_id,
         event_id AS seq, user_id, value, props,
         'evledger.event.v1' AS schema,
         'evt_' || lpad(event_id::VARCHAR, 12, '0') AS event_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts,
         CASE event_id % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'cursor' ELSE 'browser' END AS source,
         event_type,
         'user_' || user_id AS project,
         '/work/user_' || user_id AS cwd,
         event_type || repeat(' detail', (event_id % 40)::INT) AS raw_text,
         CASE WHEN length(event_type || repeat(' detail', (event_id % 40)::INT)) <= 120
              THEN event_type || repeat(' detail', (event_id % 40)::INT)
              ELSE left(event_type || repeat(' detail', (event_id % 40)::INT), 119) || '...' END AS summary
  FROM events
)"""

# Canonical text of the derived events, cut at previous_hash.
PARTS = (
    ENV
    + """,
parts AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY seq) AS rn,
    '{"artifacts":[],"cwd":"' || cwd || '","event_id":"' || event_id || '","event_type":"' || event_type
      || '","payload":' || replace(props, ': ', ':') || ',"previous_hash":' AS head,
    ',"privacy":{"review_required":true,"scope":"local_only"},"project":"' || project || '","raw_text":"'
      || raw_text || '","schema":"' || schema || '","source":"' || source || '","summary":"' || summary
      || '","tags":["' || event_type || '","' || source || '"],"ts":"' || ts || '"}' AS tail
  FROM env
)"""
)

CHAIN = (
    "WITH RECURSIVE "
    + PARTS.strip()
    + """,
links AS (
  SELECT ledger_id, rn, NULL::VARCHAR AS previous_hash, sha256(head || 'null' || tail) AS content_hash
  FROM parts WHERE rn = 1
  UNION ALL
  SELECT p.ledger_id, p.rn, l.content_hash, sha256(p.head || '"' || l.content_hash || '"' || p.tail)
  FROM links l JOIN parts p ON p.ledger_id = l.ledger_id AND p.rn = l.rn + 1
),
chain AS MATERIALIZED (
  SELECT p.*, l.previous_hash, l.content_hash FROM parts p JOIN links l USING (ledger_id, rn)
)"""
)

# Stored lines of the derived ledgers with their positions.
LINES = (
    CHAIN
    + """,
texts AS (
  SELECT *, '{"artifacts": [], "content_hash": "' || content_hash || '", "cwd": "' || cwd
    || '", "event_id": "' || event_id || '", "event_type": "' || event_type || '", "payload": ' || props
    || ', "previous_hash": ' || coalesce('"' || previous_hash || '"', 'null')
    || ', "privacy": {"review_required": true, "scope": "local_only"}, "project": "' || project
    || '", "raw_text": "' || raw_text || '", "schema": "' || schema || '", "source": "' || source
    || '", "summary": "' || summary || '", "tags": ["' || event_type || '", "' || source
    || '"], "ts": "' || ts || '"}' AS line_text
  FROM chain
),
lines AS MATERIALIZED (
  SELECT *, strlen(line_text) + 1 AS byte_len,
    (sum(strlen(line_text) + 1) OVER (PARTITION BY ledger_id ORDER BY rn) - strlen(line_text) - 1)::BIGINT AS byte_offset
  FROM texts
)"""
)


_SHARED: dict[tuple[str, str, str], object] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, make):
    """A derivation several queries read: written once per application."""
    key = (spark.conf.get("spark.app.id", "local"), sf_dir, name)
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledgers as a table of chained events."""
    return shared(
        spark, sf_dir, "chained", lambda: materialize(chain_build(envelope(spark, sf_dir)), "chained")
    )


def write_ledger_files(events: DataFrame, spell: Callable[[DataFrame, str], DataFrame] = chain_lines) -> str:
    """Write chained events as JSON lines, one folder per ledger; ``spell`` makes the lines."""
    path = scratch_path(events.sparkSession, "ledger-text")
    write_ledger(events, path, compression="gzip", spell=spell)
    return path


def ledger_files(spark: SparkSession, sf_dir: str) -> str:
    """Ledger text of the clean chain."""
    return shared(spark, sf_dir, "files", lambda: write_ledger_files(chained(spark, sf_dir)))


def ledger_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the clean ledgers lie as a table of lines with positions, in offset order."""

    def make():
        path = scratch_path(spark, "ledger-table")
        ledger_lines(spark, ledger_files(spark, sf_dir)).write.option("compression", "zstd").parquet(path)
        return path

    return shared(spark, sf_dir, "lines", make)


def ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean ledgers as a table of lines with positions."""
    return spark.read.parquet(ledger_path(spark, sf_dir))


def indexed_ledger(spark: SparkSession, sf_dir: str) -> IndexedLedger:
    """The same table with its offset index."""
    path = ledger_path(spark, sf_dir)
    return shared(spark, sf_dir, "lines-index", lambda: index_ledger(spark, path, scratch_path(spark, "ledger-index")))


def kept_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chained events without the rows that are lost."""
    return chained(spark, sf_dir).where(F.col("seq") % 71 != 3)


# Damage by arithmetic on the event id: one kind per row, first match wins.
def damaged_texts(events: DataFrame, order: str) -> DataFrame:
    seq, value = F.col(order), F.col("value")
    own = F.concat(F.lit('"event_id": "evt_'), F.lpad(seq.cast("string"), 12, "0"))
    return chain_lines(events, order).withColumn(
        "value",
        F.when(seq % 89 == 7, F.lit("{invalid"))
        .when(seq % 97 == 5, F.replace(value, F.lit('"review_required": true'), F.lit('"review_required": false')))
        .when(seq % 83 == 11, F.replace(value, F.lit("evledger.event.v1"), F.lit("evledger.event.v9")))
        .when(seq % 79 == 13, F.replace(value, own, F.lit('"event_id": "evt_copy')))
        .when(seq % 67 == 19, F.replace(value, own, F.lit('"event_id": "')))
        .otherwise(value),
    )


DAMAGED = (
    LINES
    + """,
damage AS (
  SELECT ledger_id, seq, previous_hash, content_hash,
    CASE WHEN seq % 89 = 7 THEN 'json' WHEN seq % 97 = 5 THEN 'body' WHEN seq % 83 = 11 THEN 'schema'
         WHEN seq % 79 = 13 THEN 'copy' WHEN seq % 67 = 19 THEN 'noid' ELSE 'none' END AS harm,
    CASE WHEN seq % 89 = 7 THEN '{invalid'
         WHEN seq % 97 = 5 THEN replace(line_text, '"review_required": true', '"review_required": false')
         WHEN seq % 83 = 11 THEN replace(line_text, 'evledger.event.v1', 'evledger.event.v9')
         WHEN seq % 79 = 13 THEN replace(line_text, '"event_id": "' || event_id, '"event_id": "evt_copy')
         WHEN seq % 67 = 19 THEN replace(line_text, '"event_id": "' || event_id, '"event_id": "')
         ELSE line_text END AS line_text,
    CASE WHEN seq % 79 = 13 AND seq % 89 <> 7 AND seq % 97 <> 5 AND seq % 83 <> 11 THEN 'evt_copy'
         WHEN seq % 67 = 19 AND seq % 89 <> 7 AND seq % 97 <> 5 AND seq % 83 <> 11 THEN NULL ELSE event_id END AS event_id
  FROM lines WHERE seq % 71 <> 3
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY seq) AS line,
    (sum(strlen(line_text) + 1) OVER (PARTITION BY ledger_id ORDER BY seq) - strlen(line_text) - 1)::BIGINT AS byte_offset
  FROM damage
),
good AS (
  SELECT *, lag(content_hash) OVER (PARTITION BY ledger_id ORDER BY seq) AS expected_previous_hash,
    lag(event_id) OVER (PARTITION BY ledger_id ORDER BY seq) AS previous_event_id,
    row_number() OVER (PARTITION BY ledger_id, event_id ORDER BY seq) AS copy_no
  FROM placed WHERE harm <> 'json'
),
errors AS (
  SELECT ledger_id, line, byte_offset, 'invalid_json' AS code, NULL AS event_id FROM placed WHERE harm = 'json'
  UNION ALL SELECT ledger_id, line, byte_offset, 'schema_mismatch', NULL FROM good WHERE harm = 'schema'
  UNION ALL SELECT ledger_id, line, byte_offset, 'missing_event_id', NULL FROM good WHERE harm = 'noid'
  UNION ALL SELECT ledger_id, line, byte_offset, 'duplicate_event_id', event_id FROM good
            WHERE event_id IS NOT NULL AND copy_no > 1
  UNION ALL SELECT ledger_id, line, byte_offset, 'previous_hash_mismatch', event_id FROM good
            WHERE previous_hash IS DISTINCT FROM expected_previous_hash
  UNION ALL SELECT ledger_id, line, byte_offset, 'content_hash_mismatch', event_id FROM good WHERE harm <> 'none'
)"""
)


def damaged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the damaged ledger text."""
    return shared(
        spark,
        sf_dir,
        "damaged",
        lambda: scan_ledger(
            spark, write_ledger_files(kept_events(spark, sf_dir), damaged_texts), keep_value=True
        ).lines,
    )


def damaged_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(
        spark,
        sf_dir,
        "errors",
        lambda: materialize(verify_errors(damaged_facts(spark, sf_dir)), "errors"),
    )


# Ledgers with lost rows: broken links only, so they may be sealed.
def gapped_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        # The scan is a written table already; positions are joined to it as it is read.
        return ledger_lines(spark, write_ledger_files(kept_events(spark, sf_dir)))

    return shared(spark, sf_dir, "gapped", make)


GAPPED = (
    LINES
    + """,
gapped AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY seq) AS line,
    (sum(byte_len) OVER (PARTITION BY ledger_id ORDER BY seq) - byte_len)::BIGINT AS pos,
    lag(content_hash) OVER (PARTITION BY ledger_id ORDER BY seq) AS expected_previous_hash,
    lag(event_id) OVER (PARTITION BY ledger_id ORDER BY seq) AS previous_event_id
  FROM (SELECT * FROM lines WHERE seq % 71 <> 3)
),
breaks AS (SELECT * FROM gapped WHERE previous_hash IS DISTINCT FROM expected_previous_hash)"""
)

SEALED_AT = "2024-06-01T00:00:00Z"


def sealed_archive(spark: SparkSession, sf_dir: str) -> str:
    """The gapped ledgers, sealed."""

    def make():
        path = scratch_path(spark, "archive")
        seal(gapped_table(spark, sf_dir), path, sealed_at=SEALED_AT, active="/ledgers/active")
        return path

    return shared(spark, sf_dir, "archive", make)
