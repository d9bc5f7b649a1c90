"""Column contracts of the evidence ledger.

The envelope is fixed and versioned, the payload stays open JSON text.  Schema
identifiers carry a namespace so that ledgers written under another namespace
are read by passing that namespace instead of editing data.
"""

from __future__ import annotations

from pyspark.sql import types as T

NAMESPACE = "evledger"

# Wire-format version suffixes.
EVENT = "event.v1"
CURSOR = "cursor.v1"
EVENT_BATCH = "event_batch.v1"
VERIFY = "verify.v1"
REDACTION = "redaction.v1"
CAPTURE_POLICY = "capture_policy.v1"
ARCHIVE_MANIFEST = "archive_manifest.v1"
ARCHIVE_VERIFY_REPORT = "archive_verify_report.v1"
ARCHIVE_VERIFY_STATUS = "archive_verify_status.v1"
ARCHIVE_REGISTRY = "archive_registry.v1"
BREAKPOINT_LIST = "breakpoint_list.v1"
LEDGER_TRANSITION = "ledger_transition.v1"
SEAL_RESULT = "seal_result.v1"


def schema_id(kind: str, namespace: str = NAMESPACE) -> str:
    return f"{namespace}.{kind}"


# Envelope fields, in storage order.
EVENT_FIELDS = (
    "schema",
    "event_id",
    "ts",
    "source",
    "event_type",
    "project",
    "cwd",
    "summary",
    "raw_text",
    "tags",
    "artifacts",
    "payload",
    "privacy",
    "previous_hash",
    "content_hash",
)

# Fields that leave the ledger under the metadata projection.
METADATA_FIELDS = (
    "schema",
    "event_id",
    "ts",
    "source",
    "event_type",
    "project",
    "tags",
    "privacy",
    "previous_hash",
    "content_hash",
)

PROJECTIONS = ("full", "summary", "metadata")

PRIVACY_TYPE = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("review_required", T.BooleanType()),
    ]
)

ARTIFACT_TYPE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("exists", T.BooleanType()),
        T.StructField("size", T.LongType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("policy_status", T.StringType()),
    ]
)

# payload and artifacts are JSON text: hashing needs the exact number and key
# spelling, which typed or variant columns do not keep.
BODY_FIELDS = tuple(f for f in EVENT_FIELDS if f not in ("previous_hash", "content_hash"))

CURSOR_TYPE = T.StructType(
    [
        T.StructField("ledger_id", T.StringType()),
        T.StructField("byte_offset", T.LongType()),
        T.StructField("last_event_id", T.StringType()),
        T.StructField("last_content_hash", T.StringType()),
    ]
)

# What one Arrow pass over a raw ledger line reports.
FACTS_TYPE = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # blank | invalid | event
        T.StructField("problem", T.StringType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("event_id_raw", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("previous_hash", T.StringType()),
        T.StructField("previous_is_text", T.BooleanType()),
        T.StructField("stored_hash", T.StringType()),
        T.StructField("calculated_hash", T.StringType()),
    ]
)

# The narrow facts verification keeps per line.  Hash texts of sound lines are
# left null: only broken links and hashes need them in a report.
CHECK_FIELDS = (
    "kind",
    "problem",
    "schema_name",
    "event_id",
    "stored_hash",
    "hash_ok",
    "calculated_hash",
    "link_ok",
    "previous_hash",
    "expected_previous_hash",
    "previous_event_id",
)

BREAKPOINT_TYPE = T.StructType(
    [
        T.StructField("line", T.LongType()),
        T.StructField("byte_offset", T.LongType()),
        T.StructField("code", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("previous_event_id", T.StringType()),
        T.StructField("expected_previous_hash", T.StringType()),
        T.StructField("actual_previous_hash", T.StringType()),
        T.StructField("content_hash", T.StringType()),
    ]
)

# Verification error codes.
INVALID_JSON = "invalid_json"
SCHEMA_MISMATCH = "schema_mismatch"
MISSING_EVENT_ID = "missing_event_id"
DUPLICATE_EVENT_ID = "duplicate_event_id"
PREVIOUS_HASH_MISMATCH = "previous_hash_mismatch"
CONTENT_HASH_MISMATCH = "content_hash_mismatch"
LEDGER_CHANGED = "ledger_changed_during_verification"

DEFAULT_BATCH_BYTES = 8 * 1024 * 1024
