"""Small state tables in numbered versions, so a crash never loses the last one.

A version is a folder that Spark commits with its ``_SUCCESS`` mark.  Readers
take the newest complete one; an unfinished one is ignored and replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Complete versions that stay behind the newest.
KEEP = 2
_NAME = re.compile(r"version=(\d{12})")


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions in ascending order."""
    target, fs = _folder(spark, path)
    if not fs.exists(target):
        return []
    found = []
    for status in fs.listStatus(target):
        match = _NAME.fullmatch(status.getPath().getName())
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if match and fs.exists(done):
            found.append(int(match[1]))
    return sorted(found)


def _path(path: str, version: int) -> str:
    return f"{path}/version={version:012d}"


def load(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The newest complete version and its number; ``(None, 0)`` if there is none."""
    known = versions(spark, path)
    if not known:
        return None, 0
    return spark.read.parquet(_path(path, known[-1])), known[-1]


def save(rows: DataFrame, path: str) -> DataFrame:
    """Write the next version, then drop old ones; ``rows`` may read the newest."""
    spark = rows.sparkSession
    known = versions(spark, path)
    target = _path(path, (known[-1] if known else 0) + 1)
    rows.write.mode("overwrite").parquet(target)  # replaces what a crash left unfinished
    for old in known[: -KEEP]:
        folder, fs = _folder(spark, _path(path, old))
        fs.delete(folder, True)
    return spark.read.schema(rows.schema).parquet(target)


def save_at(rows: DataFrame, path: str, version: int) -> DataFrame:
    """Version number ``version``: written unless it is complete already, then read back.

    ``rows`` is not looked at when the version is there, so a repeated batch sees what the first attempt saw.
    """
    spark = rows.sparkSession
    known = versions(spark, path)
    if version not in known:
        rows.write.mode("overwrite").parquet(_path(path, version))
        for old in [v for v in known if v < version][:-KEEP]:
            folder, fs = _folder(spark, _path(path, old))
            fs.delete(folder, True)
    return spark.read.schema(rows.schema).parquet(_path(path, version))


def before(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """The newest complete version below ``version``."""
    known = [v for v in versions(spark, path) if v < version]
    return spark.read.parquet(_path(path, known[-1])) if known else None


# -- newest row of each key, one delta a batch ---------------------------------

#: Batches between two bases.
EVERY = 16
_PART = re.compile(r"(base|delta)=(\d{12})")


def _parts(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Complete bases and deltas in ascending order."""
    target, fs = _folder(spark, path)
    found: dict[str, list[int]] = {"base": [], "delta": []}
    for status in fs.listStatus(target) if fs.exists(target) else []:
        match = _PART.fullmatch(status.getPath().getName())
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if match and fs.exists(done):
            found[match[1]].append(int(match[2]))
    return {kind: sorted(numbers) for kind, numbers in found.items()}


def sources(spark: SparkSession, path: str, before: int) -> list[tuple[str, int]]:
    """Folders that hold the newest rows of all batches below ``before``: a base and what came after."""
    parts = _parts(spark, path)
    base = max((n for n in parts["base"] if n < before), default=-1)
    deltas = [("delta", n) for n in parts["delta"] if base < n < before]
    return ([("base", base)] if base >= 0 else []) + deltas


def newest(spark: SparkSession, path: str, before: int, key: str) -> DataFrame | None:
    """The row of each ``key`` from the last batch below ``before`` that has one; None before the first.

    At most `EVERY` deltas and one base are read, however many batches there were.
    """
    rows = None
    for kind, number in sources(spark, path, before):
        part = spark.read.parquet(f"{path}/{kind}={number:012d}").withColumn("_batch", F.lit(number))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return None
    others = [c for c in rows.columns if c not in (key, "_batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "_batch").alias("_row")).select(key, "_row.*")


def put(rows: DataFrame, path: str, batch: int, key: str) -> None:
    """Write the rows of a batch, one for each ``key``; every `EVERY` batches also a base of all keys.

    A repeated batch replaces its delta and its base by the same ones: both depend on
    earlier batches only.  What a base covers goes when the next base is
    complete, so the batch that is repeated after a crash finds all it reads.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/delta={batch:012d}")
    if (batch + 1) % EVERY:
        return
    newest(spark, path, batch + 1, key).write.mode("overwrite").parquet(f"{path}/base={batch:012d}")
    parts = _parts(spark, path)
    last = max((n for n in parts["base"] if n < batch), default=-1)
    for kind, numbers in parts.items():
        for number in numbers:
            if number < last or (kind == "delta" and number == last):
                folder, fs = _folder(spark, f"{path}/{kind}={number:012d}")
                fs.delete(folder, True)
