"""Digest trees over the exact bytes of a ledger.

One running digest would send a whole ledger through one task.  Here each line is
digested, then each 1 MiB range of offsets, then fixed fan-in levels.  Lines are digested
where their bytes are at hand anyway (the scan, the frozen table), so the tree is
folded from 32 bytes a line and does not depend on how files were split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF_BYTES = 1 << 20
FAN_IN = 4096
LEVELS = 3


def _fold(rows: DataFrame, width: int) -> DataFrame:
    return (
        rows.groupBy("ledger_id", F.floor(F.col("at") / width).cast("long").alias("up"))
        # Bytes travel, half as long as their hex; the digest above them covers the hex.
        .agg(F.array_sort(F.collect_list(F.struct("at", F.unhex("digest").alias("digest")))).alias("d"))
        .select(
            "ledger_id",
            F.col("up").alias("at"),
            F.sha2(F.array_join(F.transform("d", lambda x: F.lower(F.hex(x["digest"]))), ""), 256).alias("digest"),
        )
    )


def tree_digest(rows: DataFrame) -> DataFrame:
    """(ledger_id, sha256) of (ledger_id, at, digest), one row a line in hex."""
    rows = _fold(rows, LEAF_BYTES)
    for _ in range(LEVELS):
        rows = _fold(rows, FAN_IN)
    return rows.select("ledger_id", F.col("digest").alias("sha256"))


def line_digest(value: Column, terminated: Column) -> Column:
    """Digest of a line with its newline, where it has one, in hex."""
    return F.sha2(F.concat(value, F.when(terminated, F.lit(b"\n")).otherwise(F.lit(b""))), 256)


def scanned_digest(lines: DataFrame) -> DataFrame:
    """(ledger_id, sha256) from lines that carry their digest as ``line_sha``."""
    digest = F.lower(F.hex("line_sha")).alias("digest")
    return tree_digest(lines.select("ledger_id", F.col("byte_offset").alias("at"), digest))


def empty_digest() -> Column:
    return F.sha2(F.lit(""), 256)
