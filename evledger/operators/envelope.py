"""Building the event envelope from any source rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evledger import schema as S
from evledger.functions import text as X


def _or(col: Column | None, default: Column) -> Column:
    """``value or default`` for text: null and '' both fall through."""
    return default if col is None else F.coalesce(F.nullif(col, F.lit("")), default)


def build_event(
    df: DataFrame,
    *,
    source: Column,
    event_type: Column,
    event_id: Column,
    ts: Column | str | None = None,
    project: Column | None = None,
    cwd: Column | None = None,
    summary: Column | None = None,
    raw_text: Column | None = None,
    tags: Column | None = None,
    artifacts: Column | str | None = None,
    payload: Column | None = None,
    privacy_scope: Column | None = None,
    review_required: Column | None = None,
    keep: Sequence[str] = (),
    namespace: str = S.NAMESPACE,
) -> DataFrame:
    """Envelope columns with the defaults of a new event, plus ``keep``.

    ``payload`` and ``artifacts`` are JSON text.  ``previous_hash`` stays null
    until the event joins a chain.
    """
    text = F.coalesce(raw_text, F.lit("")) if raw_text is not None else F.lit("")
    folder = F.coalesce(cwd, F.lit("")) if cwd is not None else F.lit("")
    columns = {
        "schema": F.lit(S.schema_id(S.EVENT, namespace)),
        "event_id": event_id,
        "ts": X.utc_iso(F.current_timestamp()) if ts is None else F.lit(ts),
        "source": source,
        "event_type": event_type,
        "project": _or(project, X.basename_project(folder)),
        "cwd": folder,
        "summary": _or(summary, X.summarize(text)),
        "raw_text": text,
        "tags": F.coalesce(tags, F.array().cast("array<string>"))
        if tags is not None
        else F.array().cast("array<string>"),
        "artifacts": _or(artifacts, F.lit("[]")),
        "payload": _or(payload, F.lit("{}")),
        "privacy": F.struct(
            _or(privacy_scope, F.lit("local_only")).alias("scope"),
            (
                F.coalesce(review_required, F.lit(True))
                if review_required is not None
                else F.lit(True)
            ).alias("review_required"),
        ),
        "previous_hash": F.lit(None).cast("string"),
    }
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])


def event_body() -> Column:
    """The hashed columns as one struct, for the Arrow functions."""
    return F.struct(*S.BODY_FIELDS)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Several sources into one ledger input."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
