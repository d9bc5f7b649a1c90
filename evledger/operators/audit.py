"""Audit of published texts: private paths, secrets and code guards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the audit looks for.
SECRET_RULES = (
    r"sk-[A-Za-z0-9_-]{20,}",
    r"(?i)\b(api[_-]?key|secret|password)\s*[:=]\s*['\"]?[A-Za-z0-9_./+=-]{12,}",
)
SCANNED_SUFFIXES = (".md", ".py", ".toml", ".json", ".js", ".html", ".yml", ".yaml")
SCANNED_NAMES = ("LICENSE", "AGENTS.md")
PRIVATE_PREFIXES = ("data/private/",)
PATH_RULE_EXEMPT = ("tests/",)


@dataclass(frozen=True)
class Guard:
    """A file must (or must not) match a pattern."""

    path: str
    pattern: str
    message: str
    must_match: bool = False


def scanned(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    # a leading dot is part of the name, not a suffix
    suffix = F.lower(F.regexp_extract(name, r"[^.].*(\.[^.]+)\z", 1))
    return suffix.isin(*SCANNED_SUFFIXES) | name.isin(*SCANNED_NAMES)


def audit_scan(
    texts: DataFrame,
    *,
    guards: Sequence[Guard] = (),
    private_paths: Sequence[str] = (),
    own_store: str = ".evledger/",
    exempt_files: Sequence[str] = (),
) -> DataFrame:
    """Issue rows ``(path, issue)`` of ``(path, text)``, in one pass.

    ``private_paths`` are patterns of workstation folders that no published text may
    hold.  Every rule is a foldable regex on the same row, so there is no rule join
    and no shuffle.
    """
    path, text = F.col("path"), F.col("text")
    private = F.lit(False)
    for prefix in (own_store, *PRIVATE_PREFIXES):
        private = private | path.startswith(prefix)
    exempt = path.isin(*exempt_files) if exempt_files else F.lit(False)
    for prefix in PATH_RULE_EXEMPT:
        exempt = exempt | path.startswith(prefix)
    issues = [F.when(private, F.concat(F.lit("private tracked path: "), path))]
    open_text = ~private & scanned(path) & text.isNotNull()
    for rule in SECRET_RULES:
        issues.append(
            F.when(
                open_text & text.rlike(rule),
                F.concat(F.lit("possible secret in "), path, F.lit(f": {rule}")),
            )
        )
    for rule in private_paths:
        issues.append(
            F.when(
                open_text & ~exempt & text.rlike(rule),
                F.concat(F.lit("private workstation path in "), path, F.lit(f": {rule}")),
            )
        )
    for guard in guards:
        found = text.rlike(guard.pattern)
        word = "missing" if guard.must_match else "unsafe"
        issues.append(
            F.when(
                open_text & (path == guard.path) & (~found if guard.must_match else found),
                F.concat(F.lit(f"{word} safety guard in "), path, F.lit(f": {guard.message}")),
            )
        )
    return texts.select("path", F.explode(F.array_compact(F.array(*issues))).alias("issue"))
