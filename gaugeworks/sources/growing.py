"""A line stream over files that grow, as a log does.

Spark's own file stream reads a file once and never looks at it again. This source remembers, per
file, the byte up to which lines are read, and gives what has been appended since. Half a line at the
end of a file waits until its newline comes. The offsets are in the stream's checkpoint, so a stream
that starts again goes on at the byte where it stopped.

The folder may be in any file system that pyarrow reads (local, HDFS, S3); a file must only ever
grow. What is new is cut into ranges of bytes that tasks read side by side: a range gives the lines
that start in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gaugeworks.shipping import ship_package

FORMAT = "growing_lines"
RANGE_BYTES = 32 << 20
_BLOCK = 1 << 16


class GrowingLines(DataSource):
    """Options: ``path`` of the folder; ``range_bytes`` of one task."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


class ByteRange(InputPartition):
    """The lines of ``file`` that start at ``start`` or behind it, but before ``end``."""

    def __init__(self, file: str, start: int, end: int, first: int):
        self.file = file
        self.start = start
        self.end = end
        self.first = first  # where a line is known to start


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, given as URI or as local path, and the path in it."""
    if path.startswith("file:/"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, range_bytes: int = RANGE_BYTES):
        self.path = path
        self.range_bytes = range_bytes
        self.seen: dict[str, tuple[int, int]] = {}  # size and end of the last whole line

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        """Per file the byte behind its last newline. Files without a new size are not opened."""
        files, folder = open_folder(self.path)
        ends = {}
        for info in files.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            if not info.is_file or info.base_name.startswith(("_", ".")):
                continue
            size, end = self.seen.get(info.path, (-1, 0))
            if info.size != size:
                end = _end_of_lines(files, info.path, info.size, end)
                self.seen[info.path] = info.size, end
            if end:
                ends[info.path] = end
        return ends

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        ranges = []
        for file in sorted(end):
            first = start.get(file, 0)
            if end[file] < first:
                raise ValueError(f"{file} has become shorter")
            for low in range(first, end[file], self.range_bytes):
                ranges.append(ByteRange(file, low, min(low + self.range_bytes, end[file]), first))
        return ranges

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        files, _ = open_folder(self.path)
        with files.open_input_file(partition.file) as file:
            at = partition.start
            if at > partition.first:
                at = _line_start(file, at)
            while at < partition.end:
                data = _whole_lines(file, at, min(_BLOCK * 64, partition.end - at))
                at += len(data)
                lines = [line.removesuffix(b"\r") for line in data.split(b"\n")[:-1]]
                texts = [line.decode("utf-8", "replace") for line in lines]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

    def commit(self, end: dict) -> None:
        pass


def _end_of_lines(files: fs.FileSystem, path: str, size: int, floor: int) -> int:
    """The byte behind the last newline; nothing before ``floor`` is read."""
    with files.open_input_file(path) as file:
        high = size
        while high > floor:
            low = max(floor, high - _BLOCK)
            found = file.read_at(high - low, low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            high = low
    return floor


def _line_start(file, at: int) -> int:
    """The first line start at ``at`` or behind it."""
    at -= 1  # a newline just before is the end of the line before
    while data := file.read_at(_BLOCK, at):
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(data)
    return at


def _whole_lines(file, at: int, wanted: int) -> bytes:
    """Lines from ``at`` on that start within ``wanted`` bytes, the last one to its newline."""
    data = file.read_at(wanted, at)
    while data and not data.endswith(b"\n"):
        more = file.read_at(_BLOCK, at + len(data))
        cut = more.find(b"\n") + 1
        data += more[:cut] if cut else more
        if not more:
            break
    return data


def growing_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of the lines of all files below ``path`` and of all that is appended to them."""
    ship_package(spark)
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(FORMAT).options(path=path, **options).load()
