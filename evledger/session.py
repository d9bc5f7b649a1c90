"""Session defaults and durable scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_TASKS = 100_000
_LOCAL_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(app: str = "evledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Adaptive execution coalesces and splits what the shuffle width leaves uneven.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Python-bound stages follow many shuffles: keep small partitions apart.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder; on a cluster a missing setting is an error
    because executors would not see each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/evledger"
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="evledger-")
    return os.path.join(_LOCAL_SCRATCH[app], "evledger")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several later steps need the same expensive rows.  Unlike a
    cache it survives executor loss and keeps column pruning and pushdown.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    # Hash texts: half the size that the default codec leaves.
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: texts as they are, nested values as JSON, others eight."""
    total = F.lit(0)
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(column), F.lit(0)) + 8
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            total = total + 8
    return total.cast("long")


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32 << 20) -> DataFrame:
    """Broadcast hint only after measuring; otherwise Spark shuffles the join.

    ``df`` must be cheap to read (a materialized or aggregated table): rows and
    bytes are taken from at most ``max_rows + 1`` rows.
    """
    size = df.limit(max_rows + 1).select(_row_bytes(df).alias("b")).agg(F.count("*"), F.sum("b")).first()
    return F.broadcast(df) if size[0] <= max_rows and (size[1] or 0) <= max_bytes else df


def task_width(spark: SparkSession, rows: int, per_task: int = 50_000) -> int:
    """Partitions for ``rows`` of Python-bound work.

    One per task slot at least, so a small input is not cut into hundreds of empty
    tasks, and more in proportion to the rows.  Beyond ``MOST_TASKS``, which
    the scheduler still handles well, tasks grow instead.
    """
    slots = spark.sparkContext.defaultParallelism
    return max(1, slots, min(MOST_TASKS, -(-rows // per_task)))


def spread(df: DataFrame) -> DataFrame:
    """Give a plain scan at least one partition per task slot.

    For inputs of a few small files in front of CPU-bound work; a scan that
    already fills the cluster is returned untouched, without a shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.conf.get("spark.app.id", "local")
    if app in _SHIPPED:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="evledger-pkg-")) / "evledger.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, Path("evledger") / source.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
