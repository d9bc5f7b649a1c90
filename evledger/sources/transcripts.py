"""Agent transcripts to events.

Each parser takes lines ``(path, byte_offset, text)`` and returns envelopes;
lines that are not the expected JSON are dropped, as the tailers do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evledger import schema as S
from evledger.functions import text as X
from evledger.operators.envelope import build_event
from evledger.operators.segments import SEGMENT_BYTES, forward_fill

MAX_CHARS = 6000


def _get(doc: str, path: str) -> Column:
    return F.try_variant_get(F.col(doc), path, "variant")


def _text(doc: str, path: str) -> Column:
    return F.try_variant_get(F.col(doc), path, "string")


def _documents(lines: DataFrame) -> DataFrame:
    return lines.withColumn("doc", F.try_parse_json("text")).where(
        F.schema_of_variant("doc").startswith("OBJECT")
    )


def _payload(**fields: Column) -> Column:
    return F.to_json(
        F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}
    )


def _turn(
    rows: DataFrame,
    source: str,
    *,
    role: Column,
    project: Column,
    cwd: Column,
    tags: Column,
    payload: dict[str, Column],
    max_chars: int,
    namespace: str,
    ts: Column | str | None,
    keep: tuple[str, ...],
) -> DataFrame:
    """Shared envelope of all agents; ``body`` holds the untruncated text."""
    text = X.truncate_text(F.col("body"), max_chars)
    payload = payload | {
        "transcript": F.col("path"),
        "truncated": X.is_truncated(F.col("body"), max_chars),
    }
    return build_event(
        rows.where(~X.is_blank(F.col("body"))),
        source=F.lit(source),
        event_type=F.concat(F.lit("agent_"), role, F.lit("_turn")),
        event_id=X.event_id(F.lit(source), *X.position_parts(rows.columns)),
        ts=ts,
        project=project,
        cwd=cwd,
        summary=X.summarize(text),
        raw_text=text,
        tags=tags,
        payload=_payload(**payload),
        keep=keep,
        namespace=namespace,
    )


def claude_code_turns(
    lines: DataFrame,
    *,
    include_assistant: bool = True,
    include_sidechain: bool = False,
    max_chars: int = MAX_CHARS,
    home: str = "",
    ts: Column | str | None = None,
    keep: tuple[str, ...] = ("path", "byte_offset"),
    namespace: str = S.NAMESPACE,
) -> DataFrame:
    roles = ["user", "assistant"] if include_assistant else ["user"]
    side = X.truthy(_get("doc", "$.isSidechain"))
    rows = (
        _documents(lines)
        .where(~X.truthy(_get("doc", "$.isMeta")))
        .withColumn("role", _text("doc", "$.type"))
        .where(F.col("role").isin(roles))
        .withColumn("side", side)
    )
    if not include_sidechain:
        rows = rows.where(~F.col("side"))
    rows = rows.withColumn("body", X.extract_text_blocks(_get("doc", "$.message.content"))).withColumn(
        "folder", F.nullif(_text("doc", "$.cwd"), F.lit(""))
    )
    base = F.array(F.lit("agent"), F.lit("claude-code"))
    return _turn(
        rows,
        "claude-code",
        role=F.col("role"),
        project=F.when(F.col("folder").isNull(), "unknown").otherwise(X.basename(F.col("folder"))),
        cwd=F.coalesce("folder", F.lit(home)),
        tags=F.when(F.col("side"), F.array_append(base, F.lit("sidechain"))).otherwise(base),
        payload={
            "session_id": _text("doc", "$.sessionId"),
            "uuid": _text("doc", "$.uuid"),
            "orig_ts": _text("doc", "$.timestamp"),
            "git_branch": _text("doc", "$.gitBranch"),
        },
        max_chars=max_chars,
        namespace=namespace,
        ts=ts,
        keep=keep,
    )


def session_ffill(rows: DataFrame, value: Column, out: str, width: int = SEGMENT_BYTES) -> DataFrame:
    """Latest session header at or before each line of its file."""
    return forward_fill(rows, ["path"], "byte_offset", value, out, width)


def codex_turns(
    lines: DataFrame,
    *,
    include_assistant: bool = True,
    max_chars: int = MAX_CHARS,
    home: str = "",
    ts: Column | str | None = None,
    keep: tuple[str, ...] = ("path", "byte_offset"),
    namespace: str = S.NAMESPACE,
    width: int = SEGMENT_BYTES,
) -> DataFrame:
    """Session folder and id come from the latest header before each message."""
    kind = _text("doc", "$.type")
    rows = _documents(lines).where(kind.isin("session_meta", "event_msg"))
    header = F.when(
        kind == "session_meta",
        F.struct(
            F.nullif(_text("doc", "$.payload.cwd"), F.lit("")).alias("cwd"),
            F.coalesce(
                X.truthy_text(_get("doc", "$.payload.id")), _text("doc", "$.payload.session_id")
            ).alias("session_id"),
        ),
    )
    speaker = F.when(_text("doc", "$.payload.type") == "user_message", "user").when(
        _text("doc", "$.payload.type") == "agent_message", "assistant"
    )
    message = _get("doc", "$.payload.message")
    # Only narrow text columns pass the window; VARIANT stays below it.
    rows = rows.select(
        *lines.columns,
        header.alias("header"),
        F.when(kind == "event_msg", speaker).alias("role"),
        F.when(F.schema_of_variant(message) == "STRING", _text("doc", "$.payload.message")).alias("body"),
        _text("doc", "$.timestamp").alias("orig_ts"),
    )
    rows = session_ffill(rows, F.col("header"), "session", width)
    roles = ["user", "assistant"] if include_assistant else ["user"]
    folder = F.col("session.cwd")
    return _turn(
        rows.where(F.col("role").isin(roles)),
        "codex",
        role=F.col("role"),
        project=F.when(folder.isNull(), "unknown").otherwise(X.basename(folder)),
        cwd=F.coalesce(folder, F.lit(home)),
        tags=F.array(F.lit("agent"), F.lit("codex")),
        payload={"session_id": F.col("session.session_id"), "orig_ts": F.col("orig_ts")},
        max_chars=max_chars,
        namespace=namespace,
        ts=ts,
        keep=keep,
    )


def cursor_turns(
    lines: DataFrame,
    *,
    root: str = "",
    include_assistant: bool = True,
    max_chars: int = MAX_CHARS,
    home: str = "",
    ts: Column | str | None = None,
    keep: tuple[str, ...] = ("path", "byte_offset"),
    namespace: str = S.NAMESPACE,
) -> DataFrame:
    """Project is the directory below ``root``, session the file stem."""
    nested = F.schema_of_variant(_get("doc", "$.message")).startswith("OBJECT")

    def either(name: str) -> Column:
        return F.when(F.coalesce(nested, F.lit(False)), _get("doc", f"$.message.{name}")).otherwise(
            _get("doc", f"$.{name}")
        )

    roles = ["user", "assistant"] if include_assistant else ["user"]
    relative = F.when(
        F.startswith(F.col("path"), F.lit(root)), F.substring(F.col("path"), len(root) + 1, 1 << 30)
    ).otherwise(F.col("path"))
    project = F.regexp_extract(relative, r"\A/*([^/]+)/", 1)
    rows = (
        _documents(lines)
        .withColumn(
            "role",
            F.lower(F.coalesce(X.truthy_text(_get("doc", "$.role")), X.truthy_text(either("role")))),
        )
        .where(F.col("role").isin(roles))
        .withColumn("body", X.extract_text_blocks(either("content")))
        .withColumn("workspace", F.coalesce(F.nullif(project, F.lit("")), F.lit("unknown")))
    )
    return _turn(
        rows,
        "cursor",
        role=F.col("role"),
        project=F.col("workspace"),
        cwd=F.lit(home),
        tags=F.array(F.lit("agent"), F.lit("cursor")),
        payload={
            "session_id": F.coalesce(
                X.truthy_text(_get("doc", "$.sessionId")),
                X.truthy_text(_get("doc", "$.session_id")),
                X.truthy_text(either("sessionId")),
                F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?\z", 1),
            ),
            "orig_ts": F.coalesce(
                X.truthy_text(_get("doc", "$.timestamp")),
                X.truthy_text(_get("doc", "$.ts")),
                X.truthy_text(either("timestamp")),
            ),
            "workspace_key": F.col("workspace"),
        },
        max_chars=max_chars,
        namespace=namespace,
        ts=ts,
        keep=keep,
    )
