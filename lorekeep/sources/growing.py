"""Lines of growing files by byte ranges: a stream source whose offsets are byte positions, and the reader behind it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of one task, and of one read.
PIECE, CHUNK = 32 << 20, 1 << 20
SCHEMA = "path string, start bigint, stop bigint, line string"


def located(path: str):
    """The file system of a path or URI, and the path in it; any store that pyarrow reads."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    return FileSystem.from_uri(path)


def beginning(file, at: int, floor: int) -> int:
    """Where the line begins that holds the byte before `at`, looking back no further than floor."""
    while at > floor:
        back = max(floor, at - 65536)
        file.seek(back)
        found = file.read(at - back).rfind(b"\n")
        if found >= 0:
            return back + found + 1
        at = back
    return floor


def lines_between(path: str, floor: int, begin: int, end: int, tail: bool = False) -> Iterator[tuple[int, int, str]]:
    """start, stop, line of the lines whose newline lies in the bytes [begin, end); nothing after end is read.

    A line may begin before `begin`, but not before floor: so the ranges of a file give every line once, however they cut
    it, and a line that was still being written comes with the range that holds its newline. tail: a rest without a newline
    counts too if it is JSON. Bytes that are no UTF-8 are replaced.
    """
    store, name = located(path)
    with store.open_input_file(name) as file:
        start = beginning(file, begin, floor)
        file.seek(start)
        left, at = b"", start
        while at < end:
            data = file.read(min(CHUNK, end - at))
            if not data:
                break
            at += len(data)
            *whole, left = (left + data).split(b"\n")
            for line in whole:
                stop = start + len(line) + 1
                if stop > begin:
                    yield start, stop, line.decode("utf-8", "replace")
                start = stop
        if tail and left.strip():
            try:
                json.loads(left)
            except ValueError:
                return
            yield start, start + len(left), left.decode("utf-8", "replace")


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def cut(path: str, begin: int, end: int) -> list[Range]:
    return [Range(path, at, min(at + PIECE, end)) for at in range(begin, end, PIECE)]


class GrowingLines(DataSource):
    """spark.readStream.format("growing_lines").load(folder): complete lines of the files below a folder, each once.

    The offset is the size that each file had; a batch reads the bytes between two offsets only. A file that is shorter
    than before is read from its start. Lines without their newline wait. Options: suffix (.jsonl) and depth (6 folders).
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return GrowingReader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("depth", 6)))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, root: str, suffix: str, depth: int):
        self.root, self.suffix, self.depth = root, suffix, depth

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        from pyarrow.fs import FileSelector, FileType

        store, base = located(self.root)
        found = store.get_file_info(FileSelector(base, recursive=True, allow_not_found=True))
        near = lambda path: path[len(base) :].strip("/").count("/") < self.depth
        return {f.path: f.size for f in found if f.type == FileType.File and f.path.endswith(self.suffix) and near(f.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        ranges = [(path, start.get(path, 0), size) for path, size in sorted(end.items())]
        return [r for path, begin, size in ranges for r in cut(path, begin if begin <= size else 0, size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for start, stop, line in lines_between(partition.path, 0, partition.begin, partition.end):
            if line.strip():
                yield partition.path, start, stop, line

    def commit(self, end: dict) -> None:
        """Nothing to do: files stay where they are."""


def growing_lines(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """A stream of SCHEMA."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").options(**options).load(root)
