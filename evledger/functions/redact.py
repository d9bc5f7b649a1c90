"""Secret redaction on text columns (JVM side)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The default secret shapes and what replaces them.
DEFAULT_SECRET_PATTERNS = (
    r"(?i)\b(api[_-]?key|access[_-]?token|refresh[_-]?token|password|secret)\s*[:=]\s*([^\s,;]+)",
    r"(?i)\bbearer\s+[a-z0-9._~+/=-]{12,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
)
DEFAULT_REPLACEMENTS = ("{1}=[REDACTED]", "Bearer [REDACTED]", "[REDACTED_PRIVATE_KEY]")
CUSTOM_REPLACEMENT = "[REDACTED]"


def check_patterns(patterns: Sequence[str]) -> tuple[str, ...]:
    """Patterns that both engines read: columns are matched in the JVM, payloads in Python."""
    session = SparkSession.getActiveSession()  # none in Python workers, where patterns arrive checked
    for pattern in patterns:
        re.compile(pattern)
        if session is not None:
            try:
                session.sparkContext._jvm.java.util.regex.Pattern.compile(_java_pattern(pattern))
            except Py4JJavaError as fault:
                raise ValueError(f"the pattern is not one for columns too: {pattern}") from fault
    return tuple(patterns)


def rules(custom: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(pattern, replacement) in the order they apply; ``{1}`` is a group."""
    rows = list(zip(DEFAULT_SECRET_PATTERNS, DEFAULT_REPLACEMENTS))
    return rows + [(p, CUSTOM_REPLACEMENT) for p in check_patterns(custom)]


def _java_pattern(pattern: str) -> str:
    # Unicode classes, and white space as Python's \s sees it.
    body = pattern.replace(r"[^\s", r"[^\s\x1c-\x1f")
    body = re.sub(r"(?<!\[)(?<!\[\^)\\s(?=[*+?{]|$)", lambda _: r"[\s\x1c-\x1f]", body)
    return "(?U)" + body


def _java_replacement(replacement: str) -> str:
    return replacement.replace("{1}", "$1")


# What a text must contain before a default rule can match it.  These are
# plain substring tests, so clean text is never run through the regexes.
# (The first rule's words have letters with exotic case variants; its
# separator does not.)
_GUARDS = {
    DEFAULT_SECRET_PATTERNS[0]: lambda t: F.contains(t, F.lit(":")) | F.contains(t, F.lit("=")),
    DEFAULT_SECRET_PATTERNS[1]: lambda t: F.contains(F.lower(t), F.lit("bearer")),
    DEFAULT_SECRET_PATTERNS[2]: lambda t: F.contains(t, F.lit("-----BEGIN ")),
}


def _step(pattern: str, replacement: str):
    java, fill = _java_pattern(pattern), _java_replacement(replacement)
    guard = _GUARDS.get(pattern)

    def apply(state: Column) -> Column:
        text, count = state["text"], state["count"]
        hit = F.rlike(text, F.lit(java))
        return F.when(
            guard(text) & hit if guard else hit,
            F.struct(
                F.regexp_replace(text, java, fill).alias("text"),
                (count + F.regexp_count(text, F.lit(java))).alias("count"),
            ),
        ).otherwise(state)

    return apply


def redact_array(col: Column, custom: Sequence[str] = ()) -> Column:
    """``array<struct<text, count>>``: each rule sees the output of the one before.

    Lambda variables bind every intermediate text once, so the expression
    stays small however many rules there are.
    """
    state = F.transform(
        col, lambda item: F.struct(item.alias("text"), F.lit(0).cast("long").alias("count"))
    )
    for pattern, replacement in rules(custom):
        state = F.transform(state, _step(pattern, replacement))
    return state


def redact_text(col: Column, custom: Sequence[str] = ()) -> Column:
    """``struct<text, count>`` of one text."""
    return redact_array(F.array(col), custom)[0]
