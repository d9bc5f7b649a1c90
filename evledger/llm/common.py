"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evledger.session import scratch_path, ship_package

#: Word separators of every operator here: space and tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Rows are handed on in Arrow batches of about this many bytes or rows.
OUT_ROWS = 8192
OUT_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """Helper names that no column of a table has, in any case of letters."""
    taken = {c.lower() for c in columns}
    prefix = "_"
    while any(f"{prefix}{n}".lower() in taken for n in names):
        prefix += "_"
    return [f"{prefix}{n}" for n in names]


class Scratch:
    """Written tables of one call, deleted together once what it returns is written.

    A table can go while the call goes on: a lost executor only asks for tables that
    the running plan reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.mode("errorifexists").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        self.paths = []


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty.

    ``bytes.split()`` separates at exactly ``[\\x20\\x09-\\x0D]`` and
    ``bytes.lower()`` changes exactly A-Z, which text methods of ``str`` do not.
    """
    binary = column.cast(pa.large_binary())
    return [value or b"" for value in binary.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of ``column``."""
    sizes = pc.binary_length(batch.column(column).cast(pa.large_binary()))
    start = held = 0
    for i, size in enumerate(sizes.to_pylist()):
        if held and held + (size or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def arrow_map(
    df: DataFrame,
    schema: T.StructType | str,
    each: Callable[[pa.RecordBatch], dict[str, object]],
    sized_by: str | None = None,
    limit: int = OUT_BYTES,
) -> DataFrame:
    """``each`` turns a record batch into output columns, in pieces of ``limit`` bytes."""
    ship_package(df.sparkSession)
    target = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, sized_by, limit) if sized_by else [batch]:
                out = each(part)
                columns = [
                    out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type)
                    for f in target
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return df.mapInArrow(run, schema)


def to_arrow(schema: T.StructType | str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return to_arrow_schema(schema)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null has none."""
    # A run starts where a word character follows a separator or the start.
    squeezed = F.regexp_replace(text, f"{WORD_CLASS}+", "w")
    return F.coalesce(F.length(F.regexp_replace(squeezed, SPACE_CLASS, "")), F.lit(0)).cast("long")


def crc_fold(column: Column, modulus: int) -> Column:
    """crc32 of a value's text modulo ``modulus``; null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
