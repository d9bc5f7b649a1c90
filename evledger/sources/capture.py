"""Shell history, clips, web pages, adapters, notes, command runs, git states."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evledger import schema as S
from evledger.functions import text as X
from evledger.operators.envelope import build_event
from evledger.operators.segments import SEGMENT_BYTES, SEGMENT_ROWS, lag_value, running_sum
from evledger.session import broadcast_if_small, materialize

CLIP_CHARS = 20_000


def _object(**fields: Column) -> Column:
    return F.to_json(
        F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}
    )


# -- shell history -----------------------------------------------------------


def join_continuations(
    lines: DataFrame, keys: tuple[str, ...] = ("path", "poll"), width: int = SEGMENT_BYTES
) -> DataFrame:
    """Commands from history lines; a trailing backtick continues the command.

    ``lines`` has the keys, ``byte_offset`` and ``text``.  Commands are numbered by a
    running count over segments of ``width`` bytes, so a read of any length is numbered
    without one task holding it; only the lines of one command meet.
    """
    more = F.col("text").endswith("`")
    piece = F.when(more, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    islands = running_sum(lines, list(keys), "byte_offset", (~more).cast("long"), "_command", width)
    return (
        islands.groupBy(*keys, "_command")
        .agg(
            F.min("byte_offset").alias("byte_offset"),
            F.array_sort(F.collect_list(F.struct("byte_offset", piece.alias("piece")))).alias("_parts"),
        )
        .select(
            *keys,
            "byte_offset",
            F.array_join(F.transform("_parts", lambda p: p["piece"]), "\n").alias("command"),
        )
    )


def self_noise_filter(commands: DataFrame, own_name: str, column: str = "command") -> DataFrame:
    """Drop blank commands and those that mention the tool itself."""
    return commands.where(~X.is_blank(F.col(column)) & ~F.contains(F.col(column), F.lit(own_name)))


def shell_history(
    lines: DataFrame,
    *,
    own_name: str = "evledger",
    batch_threshold: int = 20,
    home: str = "",
    ts: Column | str | None = None,
    width: int = SEGMENT_BYTES,
    namespace: str = S.NAMESPACE,
) -> DataFrame:
    """One event per command, or one batch event when a read holds too many.

    Commands are counted per read first.  Those of a read up to the threshold stay
    rows as they are; only a read above it, whose event is one row by its format, is
    gathered.
    """
    commands = materialize(self_noise_filter(join_continuations(lines, width=width), own_name), "commands")
    counts = materialize(commands.groupBy("path", "poll").agg(F.count(F.lit(1)).alias("n")), "reads")
    sized = commands.join(broadcast_if_small(counts), ["path", "poll"])
    big = F.col("n") > batch_threshold
    single = sized.where(~big).select("path", "poll", "n", "byte_offset", "command", F.lit(False).alias("big"))
    gathered = (
        sized.where(big)
        .groupBy("path", "poll", "n")
        .agg(F.array_sort(F.collect_list(F.struct("byte_offset", "command"))).alias("rows"))
        .select(
            "path", "poll", "n",
            F.col("rows")[0]["byte_offset"].alias("byte_offset"),
            F.array_join(F.transform("rows", lambda r: r["command"]), "\n").alias("command"),
            F.lit(True).alias("big"),
        )
    )
    batch = single.unionByName(gathered).withColumn("row", F.struct("byte_offset", "command"))
    text = F.col("row.command")
    return build_event(
        batch.withColumn("at", F.col("row.byte_offset")),
        source=F.lit("powershell-history"),
        event_type=F.when(F.col("big"), "shell_history_batch").otherwise("shell_command"),
        event_id=X.event_id(F.lit("powershell-history"), F.col("path"), F.col("poll"), F.col("row.byte_offset")),
        ts=ts,
        project=F.lit("shell"),
        cwd=F.lit(home),
        summary=F.when(
            F.col("big"),
            F.concat(F.lit("Shell history batch: "), F.col("n").cast("string"), F.lit(" commands")),
        ).otherwise(X.summarize(text)),
        raw_text=text,
        tags=F.array(F.lit("shell"), F.lit("history")),
        payload=F.when(
            F.col("big"), _object(count=F.col("n"), history_file=F.col("path"))
        ).otherwise(_object(history_file=F.col("path"))),
        keep=("path", "poll", "at"),
        namespace=namespace,
    )


# -- clips -------------------------------------------------------------------


def consecutive_dedupe(rows: DataFrame, keys: list[str], order: str, text: str, width: int = SEGMENT_ROWS) -> DataFrame:
    """Rows whose text differs from the one before; the first row is baseline."""
    real = rows.where(~X.is_blank(F.col(text)))
    marked = lag_value(real, keys, order, F.sha2(F.col(text), 256), "_before", width)
    return marked.where(~F.col("_before_first") & (F.col("_before") != F.sha2(F.col(text), 256))).drop(
        "_before", "_before_first"
    )


def clip_events(
    changes: DataFrame,
    *,
    max_chars: int = CLIP_CHARS,
    home: str = "",
    ts: Column | str | None = None,
    keep: tuple[str, ...] = ("clip_key", "pos"),
    namespace: str = S.NAMESPACE,
) -> DataFrame:
    stored = X.truncate_text(F.col("text"), max_chars)
    return build_event(
        changes,
        source=F.lit("clipboard"),
        event_type=F.lit("clipboard_clip"),
        event_id=X.event_id(F.lit("clipboard"), F.col("clip_key"), F.col("pos")),
        ts=ts,
        project=F.lit("clipboard"),
        cwd=F.lit(home),
        summary=X.summarize(stored),
        raw_text=stored,
        tags=F.array(F.lit("clipboard")),
        payload=_object(
            chars=F.length("text").cast("long"), truncated=X.is_truncated(F.col("text"), max_chars)
        ),
        keep=keep,
        namespace=namespace,
    )


def clip_changes(clips: DataFrame, *, width: int = SEGMENT_ROWS, **options) -> DataFrame:
    """Events for each change of a clip stream ``(clip_key, pos, text)``."""
    return clip_events(consecutive_dedupe(clips, ["clip_key"], "pos", "text", width), **options)


# -- web pages ---------------------------------------------------------------


def web_clips(
    pages: DataFrame,
    *,
    mode: str = "auto",
    limit: int = CLIP_CHARS,
    ts: Column | str | None = None,
    keep: tuple[str, ...] = ("url",),
    namespace: str = S.NAMESPACE,
) -> DataFrame:
    """Page or selection records ``(url, title, host, selection, page_text)``.

    A column ``capture`` (a time or number of the capture) tells apart repeated
    captures of the same text; without it they are one event.
    """
    captured = [F.col("capture")] if "capture" in pages.columns else []
    whole = {
        "page": F.lit(True),
        "selection": F.lit(False),
        "auto": X.is_blank(F.col("selection")),
    }[mode]
    rows = (
        pages.withColumn("_page", whole)
        .withColumn("_kind", F.when(F.col("_page"), "page").otherwise("selection"))
        .withColumn(
            "_text",
            F.when(F.col("_page"), X.truncate_text(F.col("page_text"), limit)).otherwise(F.col("selection")),
        )
        .where(~X.is_blank(F.col("_text")))
    )
    return build_event(
        rows,
        source=F.lit("browser"),
        event_type=F.when(F.col("_page"), "web_page").otherwise("web_clip"),
        event_id=X.event_id(F.lit("browser"), F.col("url"), F.sha2(F.col("_text"), 256), *captured),
        ts=ts,
        project=F.lit("browser"),
        summary=F.col("title"),
        raw_text=F.col("_text"),
        tags=F.array(F.lit("browser"), F.lit("extension"), F.col("_kind")),
        payload=_object(url=F.col("url"), title=F.col("title"), host=F.col("host")),
        keep=keep,
        namespace=namespace,
    )


# -- adapters ----------------------------------------------------------------

# Adapter keys with a meaning of their own.
ADAPTER_KEYS = (
    "schema",
    "event_id",
    "ts",
    "source",
    "event_type",
    "type",
    "project",
    "cwd",
    "summary",
    "raw_text",
    "text",
    "tags",
    "artifacts",
    "payload",
    "privacy",
    "previous_hash",
    "content_hash",
)


@F.arrow_udf(T.ArrayType(T.StringType()))
def adapter_records(document: pa.Array) -> pa.Array:
    """Objects of an adapter document (one object or an array of them).

    Text is kept exact, which VARIANT would not do for numbers.
    """
    out = []
    for text in document.to_pylist():
        value = json.loads(text)
        items = value if isinstance(value, list) else [value]
        if not all(isinstance(i, dict) for i in items):
            raise ValueError("adapter payload must be a JSON object")
        out.append([json.dumps(i, ensure_ascii=False) for i in items])
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def adapter_payload(record: pa.Array) -> pa.Array:
    """The payload object, or every key without a meaning of its own."""
    out = []
    for text in record.to_pylist():
        item = json.loads(text)
        payload = item.get("payload")
        if payload is None:
            payload = {k: v for k, v in item.items() if k not in ADAPTER_KEYS}
        out.append(json.dumps(payload or {}, ensure_ascii=False))
    return pa.array(out, pa.string())


_ADAPTER = (
    "source string, event_type string, type string, project string, cwd string, summary string,"
    " raw_text string, text string, tags string, artifacts string, privacy string"
)


def adapter_ingest(
    documents: DataFrame,
    *,
    column: str = "document",
    cwd: str = "",
    ts: Column | str | None = None,
    keep: tuple[str, ...] = (),
    namespace: str = S.NAMESPACE,
) -> DataFrame:
    """Generic JSON to envelopes; ids, times and hashes in the input are ignored.

    ``documents`` has ``document`` and ``doc_key``; each record is identified
    by its document and its index in it.
    """
    rows = documents.select(
        *keep,
        "doc_key",
        F.posexplode(adapter_records(F.col(column))).alias("index", "record"),
    )
    rows = rows.withColumn("payload", adapter_payload(F.col("record"))).withColumn(
        "r", F.from_json("record", _ADAPTER)
    )

    def text(name: str) -> Column:
        return F.nullif(F.col(f"r.{name}"), F.lit(""))

    # A JSON array is kept as text by the string schema; anything else is one tag.
    listed = F.from_json("r.tags", "array<string>")
    tags = (
        F.when(text("tags").isNull(), F.array().cast("array<string>"))
        .when(F.startswith(F.ltrim(F.col("r.tags")), F.lit("[")) & listed.isNotNull(), listed)
        .otherwise(F.array(F.col("r.tags")))
    )
    privacy = F.from_json("r.privacy", "scope string, review_required boolean")
    return build_event(
        rows,
        source=F.coalesce(text("source"), F.lit("adapter")),
        event_type=F.coalesce(text("event_type"), text("type"), F.lit("adapter_event")),
        event_id=X.event_id(F.lit("adapter"), F.col("doc_key"), F.col("index")),
        ts=ts,
        project=text("project"),
        cwd=F.coalesce(text("cwd"), F.lit(cwd)),
        summary=text("summary"),
        raw_text=F.coalesce(text("raw_text"), text("text"), F.lit("")),
        tags=tags,
        artifacts=F.when(F.startswith(F.col("r.artifacts"), F.lit("[")), F.col("r.artifacts")),
        payload=F.col("payload"),
        privacy_scope=privacy["scope"],
        review_required=privacy["review_required"],
        keep=(*keep, "doc_key", "index"),
        namespace=namespace,
    )


# -- notes, commands, git ----------------------------------------------------


def manual_events(
    notes: DataFrame, *, ts: Column | str | None = None, keep: tuple[str, ...] = ("note_id",), namespace: str = S.NAMESPACE
) -> DataFrame:
    """Notes ``(note_id, source, event_type, project, cwd, summary, text, tags, fields)``.

    ``fields`` are KEY=VALUE strings that become the payload.
    """
    return build_event(
        notes,
        source=F.col("source"),
        event_type=F.col("event_type"),
        event_id=X.event_id(F.lit("note"), F.col("note_id")),
        ts=ts,
        project=F.col("project"),
        cwd=F.col("cwd"),
        summary=F.col("summary"),
        raw_text=F.col("text"),
        tags=F.col("tags"),
        payload=F.to_json(X.parse_key_values(F.col("fields"))),
        keep=keep,
        namespace=namespace,
    )


def saved_clip_events(
    clips: DataFrame, *, ts: Column | str | None = None, keep: tuple[str, ...] = ("clip_id",), namespace: str = S.NAMESPACE
) -> DataFrame:
    """Saved clips ``(clip_id, source, project, cwd, text, url, title)``."""
    return build_event(
        clips,
        source=F.col("source"),
        event_type=F.lit("clipboard_clip"),
        event_id=X.event_id(F.lit("clip"), F.col("clip_id")),
        ts=ts,
        project=F.col("project"),
        cwd=F.col("cwd"),
        summary=F.coalesce(F.nullif(F.col("title"), F.lit("")), X.summarize(F.col("text"))),
        raw_text=F.col("text"),
        # url and title are left out of the payload when empty
        payload=F.to_json(
            F.struct(
                F.nullif(F.col("url"), F.lit("")).alias("url"),
                F.nullif(F.col("title"), F.lit("")).alias("title"),
            )
        ),
        keep=keep,
        namespace=namespace,
    )


def command_run_events(
    runs: DataFrame, *, ts: Column | str | None = None, keep: tuple[str, ...] = ("run_id",), namespace: str = S.NAMESPACE
) -> DataFrame:
    """Results ``(run_id, project, cwd, command, shell, exit_code, duration_ms, stdout, stderr)``."""
    text = F.concat(
        F.lit("$ "),
        F.array_join("command", " "),
        F.lit("\nexit_code="),
        F.col("exit_code").cast("string"),
    )
    return build_event(
        runs,
        source=F.lit("command"),
        event_type=F.lit("command_run"),
        event_id=X.event_id(F.lit("run"), F.col("run_id")),
        ts=ts,
        project=F.col("project"),
        cwd=F.col("cwd"),
        summary=X.summarize(text),
        raw_text=text,
        payload=_object(
            command=F.col("command"),
            shell=F.col("shell"),
            exit_code=F.col("exit_code"),
            duration_ms=F.col("duration_ms"),
            stdout_tail=X.tail_text(F.col("stdout")),
            stderr_tail=X.tail_text(F.col("stderr")),
        ),
        keep=keep,
        namespace=namespace,
    )


def git_snapshot_events(
    states: DataFrame, *, ts: Column | str | None = None, keep: tuple[str, ...] = ("state_id",), namespace: str = S.NAMESPACE
) -> DataFrame:
    """States ``(state_id, project, cwd, git_root, branch, head, status, names, stat, cached_stat)``."""
    root = F.nullif(F.col("git_root"), F.lit(""))
    text = X.strip(
        F.concat_ws(
            "\n",
            F.concat(F.lit("git_root="), F.col("git_root")),
            F.concat(F.lit("branch="), F.col("branch")),
            F.concat(F.lit("head="), F.col("head")),
            F.lit(""),
            F.col("status"),
            F.col("names"),
            F.col("stat"),
        )
    )
    return build_event(
        states,
        source=F.lit("git"),
        event_type=F.lit("git_snapshot"),
        event_id=X.event_id(F.lit("git"), F.col("state_id")),
        ts=ts,
        project=F.col("project"),
        cwd=F.coalesce(root, F.col("cwd")),
        summary=F.concat(
            F.lit("Git snapshot for "),
            X.basename(F.coalesce(root, F.col("cwd"))),
            F.lit(" on "),
            F.coalesce(F.nullif(F.col("branch"), F.lit("")), F.lit("detached")),
        ),
        raw_text=text,
        payload=_object(
            git_root=F.col("git_root"),
            branch=F.col("branch"),
            head=F.col("head"),
            status_short=F.col("status"),
            diff_name_status=F.col("names"),
            diff_stat=F.col("stat"),
            cached_diff_stat=F.col("cached_stat"),
        ),
        keep=keep,
        namespace=namespace,
    )
