"""File trees: snapshots, artifacts, and what changed between two snapshots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evledger import positions
from evledger import schema as S
from evledger.functions import text as X
from evledger.operators.envelope import build_event
from evledger.session import materialize, ship_package, task_width
from evledger.sources.growing import file_system
from evledger.sources.tail import plain_path

# What a watcher skips unless told otherwise.  The store's own
# folder is appended from the namespace.
DEFAULT_IGNORE_GLOBS = (
    ".git/**",
    ".venv/**",
    "__pycache__/**",
    ".pytest_cache/**",
    ".mypy_cache/**",
    ".ruff_cache/**",
    "node_modules/**",
    "dist/**",
    "build/**",
    "*.pyc",
    "*.pyo",
    "*.log",
)


def ignore_globs(globs: Iterable[str] | None = None, namespace: str = S.NAMESPACE) -> tuple[str, ...]:
    """The given globs; none or an empty list means the defaults."""
    return tuple(globs or ()) or (*DEFAULT_IGNORE_GLOBS, f".{namespace}/**")


def ignore_paths(files: DataFrame, globs: Iterable[str] | None = None) -> DataFrame:
    return files.where(~X.path_ignored(F.col("path"), ignore_globs(globs)))


def tree_snapshot(spark: SparkSession, root: str, globs: Iterable[str] | None = None) -> DataFrame:
    """(path, size, mtime_ns) of every file under ``root`` not ignored."""
    prefix = root.rstrip("/") + "/"
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(
            plain_path(F.col("path")).alias("full"),
            F.col("length").alias("size"),
            (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
        )
    )
    relative = F.substring(F.col("full"), len(prefix) + 1, 1 << 30)
    return ignore_paths(listed.select(relative.alias("path"), "size", "mtime_ns"), globs)


#: Bytes of a file that are held at once while it is hashed.
CHUNK = 1 << 20


def hash_file(path: str) -> tuple[int, str]:
    """Size and SHA-256 of a file of any length, read once in pieces."""
    fs, name = file_system(path)
    digest, size = hashlib.sha256(), 0
    with fs.open_input_stream(name) as stream:
        while chunk := stream.read(CHUNK):
            digest.update(chunk)
            size += len(chunk)
    return size, digest.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, rows = batch.column("path").to_pylist(), []
        for uri, path in zip(batch.column("uri").to_pylist(), paths):
            rows.append((path, *hash_file(uri)))
        columns = list(zip(*rows)) or [(), (), ()]
        types = (pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "size", "sha256"])


def file_artifacts(spark: SparkSession, requested: DataFrame, root: str) -> DataFrame:
    """Artifact structs for requested ``(path, kind)``; missing files are kept.

    The listing opens no file.  The requested ones that exist are dealt to tasks and each
    is hashed in pieces, so a file may be of any size.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    wanted = requested.select("path").distinct()
    plain = plain_path(F.col("path"))
    uri = F.when(F.col("path").startswith("file:"), plain).otherwise(F.col("path"))
    present = files.select(uri.alias("uri"), plain.alias("path"))
    present = materialize(present.join(wanted, "path", "left_semi"), "present")
    width = task_width(spark, present.count(), 50)
    found = present.repartition(width).mapInArrow(_hashed, "path string, size bigint, sha256 string")
    return requested.join(found, "path", "left").select(
        "kind", "path", F.col("sha256").isNotNull().alias("exists"), "size", "sha256"
    )


def snapshot_diff(previous: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Changed paths: created, deleted, or modified in size or time."""
    old = previous.select(*keys, F.col("size").alias("_s0"), F.col("mtime_ns").alias("_m0"), F.lit(1).alias("_old"))
    new = current.select(*keys, F.col("size").alias("_s1"), F.col("mtime_ns").alias("_m1"), F.lit(1).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "created")
        .when(F.col("_new").isNull(), "deleted")
        .when(
            ~F.col("_s0").eqNullSafe(F.col("_s1")) | ~F.col("_m0").eqNullSafe(F.col("_m1")),
            "modified",
        )
    )
    return (
        old.join(new, list(keys), "full_outer")
        .select(*keys, change.alias("change"))
        .where(F.col("change").isNotNull())
    )


def paths_created(previous: DataFrame, current: DataFrame) -> DataFrame:
    return current.select("path").subtract(previous.select("path"))


def paths_deleted(previous: DataFrame, current: DataFrame) -> DataFrame:
    return previous.select("path").subtract(current.select("path"))


def paths_common(previous: DataFrame, current: DataFrame) -> DataFrame:
    return previous.select("path").intersect(current.select("path"))


def sorted_changes(changes: DataFrame) -> DataFrame:
    """Changes in report order: class, then path; a distributed range sort."""
    rank = F.when(F.col("change") == "created", 0).when(F.col("change") == "modified", 1).otherwise(2)
    return changes.orderBy(rank, "path")


def change_batches(
    changes: DataFrame,
    *,
    watch_root: Column | None = None,
    keys: tuple[str, ...] = ("root",),
    project: Column | None = None,
    ts: Column | str | None = None,
    version: Column | None = None,
    source: str = "file-watch",
    namespace: str = S.NAMESPACE,
) -> DataFrame:
    """One event per root that changed; its text is the sorted list of changes.

    The event holds the whole list by definition, so keys should name one
    watched root; many roots run side by side.
    """
    root = watch_root if watch_root is not None else F.col("root")

    def paths(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("change") == kind, F.col("path"))))

    grouped = changes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        paths("created").alias("created"),
        paths("modified").alias("modified"),
        paths("deleted").alias("deleted"),
    )

    def listed(sign: str, name: str) -> Column:
        return F.transform(name, lambda p: F.concat(F.lit(sign + " "), p))

    def total(name: str) -> Column:
        return F.concat(F.lit(f"{name}="), F.size(name).cast("string"))

    text = F.array_join(
        F.concat(
            F.array(
                F.concat(F.lit("watch_root="), root),
                F.concat(F.lit("changed="), F.col("n").cast("string")),
                total("created"),
                total("modified"),
                total("deleted"),
                F.lit(""),
            ),
            listed("+", "created"),
            listed("~", "modified"),
            listed("-", "deleted"),
        ),
        "\n",
    )
    return build_event(
        grouped,
        source=F.lit(source),
        event_type=F.lit("file_change_batch"),
        event_id=X.event_id(F.lit(source), *[F.col(k) for k in keys], version if version is not None else F.sha2(text, 256)),
        ts=ts,
        project=project,
        cwd=root,
        summary=F.concat(F.lit("File change batch: "), F.col("n").cast("string"), F.lit(" paths")),
        raw_text=X.strip(text),
        tags=F.array(F.lit("watch")),
        payload=F.to_json(
            F.struct(root.alias("root"), F.struct("created", "modified", "deleted").alias("changes"))
        ),
        keep=keys,
        namespace=namespace,
    )


def watch_baseline(
    current: DataFrame,
    *,
    keys: tuple[str, ...] = ("root",),
    project: Column | None = None,
    ts: Column | str | None = None,
    source: str = "file-watch",
    version: Column | None = None,
    namespace: str = S.NAMESPACE,
    roots: DataFrame | None = None,
) -> DataFrame:
    """First snapshot of a root: its file count.

    ``roots`` lists roots that count even without a file.  ``version`` numbers the
    snapshot, so a second baseline of the same root is an event of its own.
    """
    root = F.col("root")
    counted = current.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if roots is not None:
        counted = roots.join(counted, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    count = F.col("n").cast("string")
    return build_event(
        counted,
        source=F.lit(source),
        event_type=F.lit("watch_baseline"),
        event_id=X.event_id(F.lit(source), *[F.col(k) for k in keys], F.lit("baseline"), *([] if version is None else [version])),
        ts=ts,
        project=project,
        cwd=root,
        summary=F.concat(F.lit("Watch baseline for "), count, F.lit(" files")),
        raw_text=F.concat(F.lit("watch_root="), root, F.lit("\nfiles="), count),
        tags=F.array(F.lit("watch"), F.lit("baseline")),
        payload=F.to_json(F.struct(root.alias("root"), F.col("n").alias("file_count"))),
        keep=keys,
        namespace=namespace,
    )


def watch_once(spark: SparkSession, root: str, state_path: str, globs=None, **options) -> DataFrame:
    """Compare a tree with its saved snapshot; the new one becomes the next version.

    Returns no row when nothing changed.  The version is part of the event ids, so
    equal changes at different times are different events, and a repeated call
    after a crash gives the same ones.
    """
    previous, number = positions.load(spark, state_path)
    version = F.lit(number + 1)
    snapshot = tree_snapshot(spark, root, globs).withColumn("root", F.lit(root))
    current = materialize(snapshot, "tree")
    if previous is None or previous.isEmpty():
        roots = spark.createDataFrame([(root,)], "root string")
        events = watch_baseline(current, roots=roots, version=version, **options)
    else:
        changes = snapshot_diff(previous, current).withColumn("root", F.lit(root))
        events = change_batches(changes, version=version, **options)
    # The events are fixed before the snapshot moves on.
    events = materialize(events, "watch-events")
    positions.save(current, state_path)
    return events
