"""Files that grow in place, as a stream of the lines they gained.

Spark's own file source takes a file once.  This source takes byte ranges.  Its offset
is the number of a small document beside the checkpoint that maps each path to
(bytes taken, generation, whether its opening line was handed on).  A batch covers the
difference of two such documents, so a restart plans the same ranges again.

A line belongs to the range that holds its newline; a reader whose range begins
inside a line looks back for its start.  An unfinished last line so waits without
being read on the driver, and a long range is cut into parts that are read side by side.
Listing and reading go through ``pyarrow.fs``, which knows local paths, HDFS and the common object stores.
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from evledger.schema import DEFAULT_BATCH_BYTES

#: Bytes of a file that one task reads.
RANGE_BYTES = 32 << 20
_BACK = 1 << 16
#: Rows of one record batch.
_ROWS = 10_000
#: ``part`` counts pieces of a line at line ends other than the newline; an opening line has ``part`` -1.
LINES = "path string, generation bigint, byte_offset bigint, part int, text string"
# Line ends that Python's splitlines knows besides "\n".
_LINE_END = re.compile(r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"\Afile:/+", "file:///", path))


class _Range(InputPartition):
    def __init__(self, path: str, generation: int, start: int, stop: int, opening: bool):
        self.path, self.generation = path, generation
        self.start, self.stop, self.opening = start, stop, opening


def line_start(file: pa.NativeFile, at: int) -> int:
    """Start of the line that the byte before ``at`` belongs to, or ``at`` after a newline."""
    end = at
    while end > 0:
        begin = max(0, end - _BACK)
        file.seek(begin)
        found = file.read(end - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        end = begin
    return 0


def range_lines(file: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes without newline) of the lines whose newline lies in the range."""
    begin = line_start(file, start)
    file.seek(begin)
    data = file.read(stop - begin)
    at = 0
    while (end := data.find(b"\n", at)) >= 0:
        yield begin + at, data[at:end]
        at = end + 1


def pieces(raw: bytes) -> Iterator[tuple[int, str]]:
    for part, text in enumerate(_LINE_END.split(raw.decode("utf-8", "replace"))):
        if text.strip():
            yield part, text


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.state = options["root"], options["state"]
        self.glob, self.layout = options.get("glob", "*"), options.get("layout")
        self.backfill = options.get("backfill", "false").lower() == "true"
        self.max_bytes = int(options.get("max_bytes", DEFAULT_BATCH_BYTES))

    # -- documents of places --

    def _documents(self) -> dict[int, str]:
        fs, folder = file_system(self.state)
        if fs.get_file_info(folder).type != pafs.FileType.Directory:
            return {}
        found = fs.get_file_info(pafs.FileSelector(folder))
        return {int(m[1]): f.path for f in found if (m := re.fullmatch(r"places-(\d{12})\.json", f.base_name))}

    def _load(self, number: int) -> dict[str, list]:
        fs, _ = file_system(self.state)
        with fs.open_input_stream(self._documents()[number]) as file:
            return json.loads(file.read())

    def _save(self, number: int, places: dict[str, list]) -> None:
        fs, folder = file_system(self.state)
        fs.create_dir(folder, recursive=True)
        target = f"{folder}/places-{number:012d}.json"
        with fs.open_output_stream(f"{target}.new") as file:
            file.write(json.dumps(places).encode())
        fs.move(f"{target}.new", target)  # a document is whole or absent

    def _sizes(self) -> dict[str, int]:
        fs, root = file_system(self.root)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        sizes = {}
        for f in found:
            below = f.path.removeprefix(root.rstrip("/") + "/")
            wanted = f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, self.glob)
            if wanted and (self.layout is None or re.fullmatch(self.layout, below)):
                sizes[f.path] = f.size
        return sizes

    # -- offsets --

    def initialOffset(self) -> dict:
        if not self._documents():
            # Text that was there before the first start is not captured unless asked for.
            self._save(0, {p: [0 if self.backfill else s, 0, False] for p, s in self._sizes().items()})
        return {"places": min(self._documents())}

    def latestOffset(self) -> dict:
        self.initialOffset()  # the first trigger may ask for the latest place before the first one
        number = max(self._documents())
        places, after = self._load(number), {}
        sizes = self._sizes()
        for path, size in sizes.items():
            taken, generation, opened = places.get(path, (0, 0, False))
            if size < taken:  # the file was cut: it starts again as its next generation
                taken, generation, opened = 0, generation + 1, True
            stop = min(size, taken + self.max_bytes)
            after[path] = [stop, generation, opened or stop > taken]
        after |= {p: place for p, place in places.items() if p not in sizes}
        if after == places:
            return {"places": number}
        self._save(number + 1, after)
        return {"places": number + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = self._load(start["places"]), self._load(end["places"])
        found = []
        for path, (stop, generation, _) in sorted(after.items()):
            taken, known, opened = before.get(path, (0, 0, False))
            if generation != known:
                taken, opened = 0, True
            opening = not opened and 0 < taken < stop
            for at in range(taken, stop, RANGE_BYTES):
                found.append(_Range(path, generation, at, min(stop, at + RANGE_BYTES), opening and at == taken))
        return found

    def commit(self, end: dict) -> None:
        fs, _ = file_system(self.state)
        for number, path in self._documents().items():
            if number < end["places"]:
                fs.delete_file(path)

    # -- reading --

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        names = ["path", "generation", "byte_offset", "part", "text"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        schema = pa.schema(list(zip(names, types)))

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            head = [(partition.path, partition.generation, *row) for row in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*head), types)], schema=schema)

        fs, _ = file_system(self.root)
        rows: list[tuple[int, int, str]] = []
        with fs.open_input_file(partition.path) as file:
            if partition.opening:
                first = next(range_lines(file, 0, min(partition.start, RANGE_BYTES)), None)
                if first is not None:
                    rows += [(-1, -1, text) for _, text in pieces(first[1])][:1]
            for at, raw in range_lines(file, partition.start, partition.stop):
                rows += [(at, part, text) for part, text in pieces(raw)]
                if len(rows) >= _ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class GrowingFiles(DataSource):
    """Options: root, state (a folder of its own), glob, layout, backfill, max_bytes (of a file in one batch)."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def line_stream(
    spark: SparkSession,
    root: str,
    state: str,
    *,
    glob: str = "*.jsonl",
    layout: str | None = None,
    backfill: bool = False,
    max_bytes: int = DEFAULT_BATCH_BYTES,
) -> DataFrame:
    """Stream of `LINES` of the files below ``root``; ``state`` belongs to one checkpoint.

    Files present at the first start begin at their end unless ``backfill``; files that come
    later begin at 0, as does a file that shrank.  At most ``max_bytes`` of a file
    are taken in one batch; a line longer than that comes whole once its newline is there.
    """
    spark.dataSource.register(GrowingFiles)
    reader = spark.readStream.format("growing_files").option("root", root).option("state", state)
    reader = reader.option("glob", glob).option("backfill", str(backfill)).option("max_bytes", max_bytes)
    return (reader if layout is None else reader.option("layout", layout)).load()
