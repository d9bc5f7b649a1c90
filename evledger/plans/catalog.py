"""All registered queries."""

from __future__ import annotations

from evledger.plans import (  # noqa: F401
    base,
    bulk_queries,
    event_queries,
    ledger_queries,
    report_queries,
    source_queries,
)


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
