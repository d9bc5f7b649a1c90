"""Source metrics, percentiles and health checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evledger.functions import text as X
from evledger.session import broadcast_if_small, materialize

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"


def source_metrics(polls: DataFrame) -> DataFrame:
    """Running totals per source from one row per poll.

    ``polls``: (name, run, events, skipped, redactions, tracked_files,
    available_files, error, ts).  File counts are those of the latest
    successful run.
    """
    good = F.when(F.col("error").isNull(), F.col("run"))
    return polls.groupBy("name").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("events").alias("events"),
        F.sum("skipped").alias("skipped"),
        F.sum("redactions").alias("redactions"),
        F.max_by("tracked_files", good).alias("tracked_files"),
        F.max_by("available_files", good).alias("available_files"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("run"))).alias("last_error"),
        F.max_by("ts", "run").alias("last_run_ts"),
    )


def source_coverage(metrics: DataFrame) -> DataFrame:
    """Totals over all sources, one row."""

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)

    return metrics.agg(
        F.count(F.lit(1)).alias("source_count"),
        F.count_if(F.col("errors") == 0).alias("healthy_source_count"),
        *[total(n) for n in ("events", "skipped", "redactions", "tracked_files", "available_files")],
    )


def distinct_sources(events: DataFrame) -> DataFrame:
    """Sorted distinct sources and event types."""
    return events.agg(
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_set("event_type")).alias("event_types"),
    )


_EDGES = 1000


def order_statistics(
    values: DataFrame, column: str, ranks: dict[str, Callable[[Column], Column]], by: tuple[str, ...]
) -> DataFrame:
    """Exact values at given ranks (0-based, a function of the group's count).

    A group may be any size, so it is never collected or sorted in one place:
    equal values are counted, approximate quantiles cut each group into about
    a thousand ranges, and only the range that holds a wanted rank is ordered.
    """
    keys = [F.col(k) for k in by]
    known = values.where(F.col(column).isNotNull())
    counts = known.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    cuts = [i / _EDGES for i in range(1, _EDGES)]
    groups = materialize(
        known.groupBy(*keys).agg(
            F.percentile_approx(column, cuts, 100_000).alias("_edges"), F.count(F.lit(1)).alias("_total")
        ),
        "edges",
    )
    ranges = materialize(
        counts.join(broadcast_if_small(groups.drop("_total"), 10_000), list(by))
        .withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(column))))
        .drop("_edges"),
        "ranges",
    )
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = (
        ranges.groupBy(*by, "_range")
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .join(groups.drop("_edges"), list(by))
    )
    wanted = F.array(
        *[F.struct(F.lit(n).alias("name"), f(F.col("_total")).cast("long").alias("rank")) for n, f in ranks.items()]
    )
    wanted = (
        sizes.withColumn("w", F.explode(wanted))
        .where((F.col("_base") <= F.col("w.rank")) & (F.col("w.rank") < F.col("_base") + F.col("_size")))
        .select(*by, "_range", (F.col("w.rank") - F.col("_base")).alias("_at"), F.col("w.name").alias("_name"))
    )
    inside = W.partitionBy(*by, "_range").orderBy(column).rowsBetween(W.unboundedPreceding, W.currentRow)
    holding = ranges.join(wanted.select(*by, "_range").distinct(), [*by, "_range"], "left_semi")
    found = (
        holding.withColumn("_upto", F.sum("_n").over(inside))
        .join(wanted, [*by, "_range"])
        .where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n")))
    )
    return found.groupBy(*by).agg(
        *[F.max(F.when(F.col("_name") == n, F.col(column))).alias(n) for n in ranks]
    )


def nearest_rank(fraction: float) -> Callable[[Column], Column]:
    """Rank of a percentile: (n-1)*f rounded half to even."""
    return lambda total: F.bround((total - 1) * F.lit(fraction))


def latency_report(values: DataFrame, column: str, by: tuple[str, ...]) -> DataFrame:
    """p50 (median), p95 (nearest rank) and maximum per group."""
    stats = order_statistics(
        values,
        column,
        {
            "_low": lambda n: F.floor((n - 1) / 2),
            "_high": lambda n: F.ceil((n - 1) / 2),
            "p95": nearest_rank(0.95),
            "max": lambda n: n - 1,
        },
        by,
    )
    return stats.select(*by, ((F.col("_low") + F.col("_high")) / 2).alias("p50"), "p95", "max")


def latest_label(events: DataFrame, order: str = "seq") -> DataFrame:
    """Time and source/type of the latest event."""
    return events.agg(
        F.max_by(
            F.struct("ts", F.concat_ws("/", "source", "event_type").alias("label")), order
        ).alias("_l")
    ).select("_l.*")


# -- health ------------------------------------------------------------------


def _check(df: DataFrame, name: str, status: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("name"), status.alias("status"), detail.alias("detail"))


def health_cursor(envelopes: DataFrame) -> DataFrame:
    """The first batch of every ledger must be readable and sound."""
    ok = (F.col("cursor_status") == "ok") & (F.col("chain_status") != "failed")
    return _check(
        envelopes,
        "cursor protocol",
        F.when(ok, PASS).otherwise(FAIL),
        F.when(
            ok, F.concat(F.lit("ledger_id="), "ledger_id", F.lit("; chain="), "chain_status")
        ).otherwise(F.concat(F.lit("cursor="), "cursor_status", F.lit(", chain="), "chain_status")),
    )


def health_recent(events: DataFrame, order: str = "seq", sample: int = 5) -> DataFrame:
    recent = events.orderBy(F.desc(order)).limit(sample)
    row = recent.agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(F.struct("ts", "source", "event_type"), order).alias("last"),
    )
    label = F.concat_ws("/", F.coalesce("last.source", F.lit("?")), F.coalesce("last.event_type", F.lit("?")))
    return _check(
        row,
        "recent events",
        F.when(F.col("n") > 0, PASS).otherwise(WARN),
        F.when(
            F.col("n") > 0,
            F.concat(
                F.lit("sampled "),
                F.col("n").cast("string"),
                F.lit("; latest "),
                F.coalesce("last.ts", F.lit("?")),
                F.lit(" "),
                label,
            ),
        ).otherwise("ledger is empty"),
    )


def health_coverage(coverage: DataFrame) -> DataFrame:
    sound = (F.col("source_count") > 0) & (F.col("healthy_source_count") == F.col("source_count"))
    return _check(
        coverage,
        "source coverage",
        F.when(sound, PASS).otherwise(WARN),
        F.concat(
            F.lit("healthy "),
            F.col("healthy_source_count").cast("string"),
            F.lit("/"),
            F.col("source_count").cast("string"),
            F.lit("; tracked_files="),
            F.col("tracked_files").cast("string"),
            F.lit("; skipped="),
            F.col("skipped").cast("string"),
            F.lit("; redactions="),
            F.col("redactions").cast("string"),
        ),
    )


def health_freshness(status: DataFrame, now: Column, max_age: float = 30.0) -> DataFrame:
    """Age of ``updated_ts`` against a supplied time; a bad time is a warning."""
    updated = F.try_to_timestamp(F.nullif(F.col("updated_ts"), F.lit("")))
    seconds = (F.unix_micros(now) - F.unix_micros(updated)) / F.lit(1e6)
    age = F.when(seconds < 0, F.lit(0.0)).otherwise(seconds)  # null stays null
    shown = F.bround(age).cast("long").cast("string")
    limit = str(int(round(max_age)))
    return _check(
        status,
        "daemon status",
        F.when(age <= max_age, PASS).otherwise(WARN),
        F.when(updated.isNull(), "unreadable: missing updated_ts")
        .when(age <= max_age, F.concat(F.lit("updated "), shown, F.lit("s ago")))
        .otherwise(F.concat(F.lit("stale: updated "), shown, F.lit(f"s ago (expected <= {limit}s)"))),
    )


def health_rollup(*checks: DataFrame, strict: bool = False) -> DataFrame:
    """Exit code of all checks: FAIL gives 1, and WARN too when strict."""
    rows = reduce(DataFrame.unionByName, checks)
    bad = F.col("status") == FAIL
    if strict:
        bad = bad | (F.col("status") == WARN)
    return rows.agg(F.coalesce(F.bool_or(bad), F.lit(False)).cast("int").alias("exit_code"))


def file_age(ts: Column, now: Column) -> Column:
    return F.unix_seconds(now) - F.unix_seconds(X.parse_utc(ts))
