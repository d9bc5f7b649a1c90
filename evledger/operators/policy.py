"""Capture policy: accept or reject, redact, limit artifacts, annotate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evledger import schema as S
from evledger.functions import redact as R
from evledger.functions import text as X
from evledger.functions.canonical import open_json_policy

ARTIFACT_MODES = ("references_only", "drop", "preserve")
_MODES_SAID = "artifacts are handled in one of the modes " + ", ".join(ARTIFACT_MODES) + "; got {!r}"


@dataclass(frozen=True)
class CapturePolicy:
    project_allowlist: tuple[str, ...] = ()
    project_denylist: tuple[str, ...] = ()
    path_allowlist: tuple[str, ...] = ()
    path_denylist: tuple[str, ...] = ()
    allowed_scopes: tuple[str, ...] = ("local_only",)
    redaction_enabled: bool = True
    custom_patterns: tuple[str, ...] = ()
    artifact_mode: str = "references_only"
    artifact_max_size: int = 100 * 1024 * 1024

    def __post_init__(self) -> None:
        R.check_patterns(self.custom_patterns)
        if self.artifact_mode not in ARTIFACT_MODES:
            raise ValueError(_MODES_SAID.format(self.artifact_mode))


def policy_reason(policy: CapturePolicy) -> Column:
    """First rule an event breaks, null when it is accepted."""
    scope = F.coalesce(F.nullif(F.col("privacy.scope"), F.lit("")), F.lit("local_only"))
    project = F.coalesce("project", F.lit(""))
    path = X.source_path(F.col("payload"), F.col("cwd"))
    checks = [
        (~scope.isin(*policy.allowed_scopes), F.concat(F.lit("privacy_scope_not_allowed:"), scope)),
        (
            ~X.glob_match(project, policy.project_allowlist)
            if policy.project_allowlist
            else F.lit(False),
            F.lit("project_not_allowlisted"),
        ),
        (X.glob_match(project, policy.project_denylist), F.lit("project_denied")),
        (
            ~X.glob_match(path, policy.path_allowlist) if policy.path_allowlist else F.lit(False),
            F.lit("path_not_allowlisted"),
        ),
        (X.glob_match(path, policy.path_denylist), F.lit("path_denied")),
    ]
    reason = F.when(checks[0][0], checks[0][1])
    for condition, text in checks[1:]:
        reason = reason.when(condition, text)
    return reason


def policy_decide(events: DataFrame, policy: CapturePolicy) -> DataFrame:
    """Adds ``accepted`` and ``reason``; nothing is rewritten yet."""
    return events.withColumn("reason", policy_reason(policy)).withColumn(
        "accepted", F.col("reason").isNull()
    )


_TEXT_FIELDS = ("schema", "event_id", "ts", "source", "event_type", "project", "cwd", "summary", "raw_text")


def redact_event(events: DataFrame, policy: CapturePolicy) -> DataFrame:
    """Redacts every string value of the event; adds ``redaction_count``.

    Typed columns are rewritten in the JVM; the open JSON columns share one
    Arrow pass that also applies the artifact policy.
    """
    names = [n for n in _TEXT_FIELDS if n in events.columns]
    out = events
    if policy.redaction_enabled:
        # All texts of an event go through the rules as one array.
        texts = F.concat(
            F.array(*names, F.col("privacy.scope")), F.coalesce("tags", F.array().cast("array<string>"))
        )
        out = out.withColumn("_clean", R.redact_array(texts, policy.custom_patterns))
    out = out.withColumn(
        "_open",
        open_json_policy(
            F.col("payload"),
            F.col("artifacts"),
            redact=policy.redaction_enabled,
            custom_patterns=policy.custom_patterns,
            artifact_mode=policy.artifact_mode,
            artifact_max_size=policy.artifact_max_size,
        ),
    )
    total = F.col("_open.count")
    replaced = {"payload": F.col("_open.payload"), "artifacts": F.col("_open.artifacts")}
    if policy.redaction_enabled:
        total = total + F.aggregate("_clean", F.lit(0).cast("long"), lambda acc, t: acc + t["count"])
        replaced |= {n: F.col("_clean")[i]["text"] for i, n in enumerate(names)}
        replaced["privacy"] = F.struct(
            F.col("_clean")[len(names)]["text"].alias("scope"),
            F.col("privacy.review_required").alias("review_required"),
        )
        rest = F.slice("_clean", len(names) + 2, F.greatest(F.size("_clean") - len(names) - 1, F.lit(0)))
        replaced["tags"] = F.transform(rest, lambda t: t["text"])
    columns = [replaced[c].alias(c) if c in replaced else F.col(c) for c in events.columns]
    return out.select(*columns, total.alias("redaction_count"))


def policy_annotations(
    payload: Column, redaction_count: Column, artifact_mode: str, namespace: str = S.NAMESPACE
) -> Column:
    """Payload text with what the policy did; redaction only when it did any."""
    mode = F.to_json(
        F.struct(
            F.lit(S.schema_id(S.CAPTURE_POLICY, namespace)).alias("schema_version"),
            F.lit(artifact_mode).alias("artifact_mode"),
        )
    )
    redaction = F.to_json(
        F.struct(
            F.lit(S.schema_id(S.REDACTION, namespace)).alias("schema_version"),
            redaction_count.alias("count"),
            F.lit("configured_secret_patterns").alias("policy"),
        )
    )
    body = F.regexp_extract(payload, r"(?s)\A\s*\{(.*)\}\s*\z", 1)
    # Appended keys win over earlier ones of the same name when the text is read.
    return F.concat(
        F.lit("{"),
        body,
        F.when(X.is_blank(body), F.lit("")).otherwise(F.lit(", ")),
        F.when(redaction_count > 0, F.concat(F.lit('"redaction":'), redaction, F.lit(", "))).otherwise(
            F.lit("")
        ),
        F.lit('"capture_policy":'),
        mode,
        F.lit("}"),
    )


def apply_policy(events: DataFrame, policy: CapturePolicy, namespace: str = S.NAMESPACE) -> DataFrame:
    """Full policy in one pass: accepted rows are sanitised and annotated,
    rejected rows keep their source and the reason only."""
    decided = policy_decide(events, policy)
    done = redact_event(decided, policy)
    done = done.withColumn(
        "payload",
        policy_annotations(F.col("payload"), F.col("redaction_count"), policy.artifact_mode, namespace),
    )
    accepted = F.col("accepted")
    columns = []
    for name in done.columns:
        if name in S.EVENT_FIELDS and name != "source":
            columns.append(F.when(accepted, F.col(name)).alias(name))
        elif name == "redaction_count":
            columns.append(F.when(accepted, F.col(name)).otherwise(0).alias(name))
        else:
            columns.append(F.col(name))
    return done.select(*columns)


def artifact_policy(
    artifacts: Column, mode: str = "references_only", max_size: int = 100 * 1024 * 1024
) -> Column:
    """Artifact policy on a typed ``array<struct>`` column."""
    if mode not in ARTIFACT_MODES:
        raise ValueError(_MODES_SAID.format(mode))
    if mode == "drop":
        return F.filter(artifacts, lambda _: F.lit(False))
    return F.transform(
        F.filter(artifacts, lambda a: a.isNotNull()),
        lambda a: a.withField(
            "policy_status",
            F.when(a["size"] > max_size, F.lit("oversize_reference")).otherwise(
                a["policy_status"] if mode == "preserve" else F.lit(None).cast("string")
            ),
        ),
    )


def redaction_totals(decisions: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Accepted, skipped and redaction counts per source."""
    return decisions.groupBy(*by).agg(
        F.count_if("accepted").alias("events"),
        F.count_if(~F.col("accepted")).alias("skipped"),
        F.coalesce(F.sum("redaction_count"), F.lit(0)).cast("long").alias("redactions"),
    )
