"""Sparse offset index of a ledger table: which file holds which range of which ledger.

A table of lines is immutable files that are only added to, so a file is indexed once.
The index has a row for each file and ledger in it; sizes come from it without touching the
lines, and a range read names its files and carries its offsets as literals, which reach
the Parquet reader and skip row groups.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evledger import positions
from evledger.session import broadcast_if_small, materialize

#: Ranges that are spelled as literals; more are joined, between their outer bounds.
LITERAL_RANGES = 64
#: Files that are named; more are read as the whole table.
NAMED_FILES = 10_000
_INDEX = "file string, ledger_id string, first bigint, last bigint"


def in_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """``lines`` that start in ``[lo, hi)`` of their ledger; ``ranges`` is (ledger_id, lo, hi, ...).

    Other columns of ``ranges`` come along.
    """
    rows = ranges.limit(LITERAL_RANGES + 1).collect()
    offset = F.col("byte_offset")
    if len(rows) <= LITERAL_RANGES:
        each = [(F.col("ledger_id") == r["ledger_id"]) & (offset >= r["lo"]) & (offset < r["hi"]) for r in rows]
        wanted = reduce(or_, each) if each else F.lit(False)
        held = F.broadcast(lines.sparkSession.createDataFrame(rows, ranges.schema))  # a few rows
    else:
        low, high = ranges.agg(F.min("lo"), F.max("hi")).first()
        wanted = (offset >= low) & (offset < high)
        held = broadcast_if_small(ranges)
    kept = lines.where(wanted).join(held, "ledger_id")
    return kept.where((offset >= F.col("lo")) & (offset < F.col("hi"))).drop("lo", "hi")


@dataclass
class IndexedLedger:
    """A table of lines at ``path`` and its index."""

    spark: SparkSession
    path: str
    index: DataFrame

    @property
    def lines(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def sizes(self) -> DataFrame:
        """(ledger_id, ledger_size) without reading lines."""
        return self.index.groupBy("ledger_id").agg(F.max("last").alias("ledger_size"))

    def files(self, ranges: DataFrame) -> list[str] | None:
        """Files that hold a part of ``ranges``; None if they are too many to name."""
        meets = (F.col("first") < F.col("hi")) & (F.col("last") > F.col("lo"))
        rows = self.index.join(ranges.select("ledger_id", "lo", "hi"), "ledger_id").where(meets)
        found = [r["file"] for r in rows.select("file").distinct().limit(NAMED_FILES + 1).collect()]
        return found if len(found) <= NAMED_FILES else None

    def within(self, ranges: DataFrame) -> DataFrame:
        """As `in_ranges`, from the files that hold a part only."""
        files = self.files(ranges)
        if files is None:
            return in_ranges(self.lines, ranges)
        reader = self.spark.read.schema(self.lines.schema).option("basePath", self.path)
        return in_ranges(reader.parquet(*files) if files else self.lines.limit(0), ranges)


def ranged(lines: DataFrame | IndexedLedger, ranges: DataFrame) -> DataFrame:
    return lines.within(ranges) if isinstance(lines, IndexedLedger) else in_ranges(lines, ranges)


def ledger_sizes(lines: DataFrame | IndexedLedger) -> DataFrame:
    """(ledger_id, ledger_size); from narrow columns where there is no index."""
    if isinstance(lines, IndexedLedger):
        return lines.sizes()
    return lines.groupBy("ledger_id").agg(F.max(F.col("byte_offset") + F.col("byte_len")).alias("ledger_size"))


def index_ledger(spark: SparkSession, path: str, index_path: str) -> IndexedLedger:
    """Bring the index of the table at ``path`` up to its files; known files are not opened."""
    known, _ = positions.load(spark, index_path)
    lines = spark.read.parquet(path)
    named = lambda file: F.regexp_replace(file, r"\Afile:/+", "file:///").alias("file")  # noqa: E731  one spelling
    present = spark.createDataFrame([(f,) for f in lines.inputFiles()], "file string").select(named("file"))
    fresh = present if known is None else present.join(known.select("file").distinct(), "file", "left_anti")
    files = [r["file"] for r in fresh.collect()]
    if known is not None and not files:
        return IndexedLedger(spark, path, known)
    rows = spark.createDataFrame([], _INDEX)
    if files:
        added = spark.read.schema(lines.schema).option("basePath", path).parquet(*files)
        end = F.col("byte_offset") + F.col("byte_len")
        added = added.select(named(F.col("_metadata.file_path")), "ledger_id", "byte_offset", end.alias("end"))
        rows = added.groupBy("file", "ledger_id").agg(F.min("byte_offset").alias("first"), F.max("end").alias("last"))
    rows = rows if known is None else known.unionByName(rows)
    return IndexedLedger(spark, path, positions.save(materialize(rows, "index"), index_path))
