"""A sink outside Spark's own files that takes every record exactly once.

Two steps. Tasks write their records to files of their own that nobody reads. When all
tasks of a micro-batch are through, the driver publishes the names of their files as one small file
named after the micro-batch. That file is the commit: it appears whole or not at all, and a
micro-batch that has one is not published again. So a task that fails leaves a file that no list
names, and a micro-batch that runs again adds nothing.

The target is a folder in any file system that pyarrow writes. ``read_published`` reads what is published;
``remove_unpublished`` deletes what failed attempts left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceStreamArrowWriter,
    WriterCommitMessage,
)

from gaugeworks.shipping import ship_package
from gaugeworks.sources.growing import open_folder

FORMAT = "published_lines"
_STAGED = "lines"
_LISTS = "published"


class PublishedLines(DataSource):
    """Options: ``path`` of the target folder; ``run`` names a table write (a new name by default)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> TableWriter:
        if overwrite:
            raise ValueError("published lines are only added")
        return TableWriter(self.options["path"], self.options.get("run") or uuid.uuid4().hex)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"])


@dataclass
class Staged(WriterCommitMessage):
    """The file one task has written, without its folder, and its records."""

    file: str
    records: int


def stage(path: str, batches: Iterable[pa.RecordBatch]) -> Staged:
    """First step, in a task: write the records to a file with a name of its own."""
    files, folder = open_folder(path)
    files.create_dir(f"{folder}/{_STAGED}", recursive=True)
    name, records = f"{uuid.uuid4().hex}.txt", 0
    with files.open_output_stream(f"{folder}/{_STAGED}/{name}") as out:
        for batch in batches:
            texts = ["" if text is None else text for text in batch.column(0).to_pylist()]
            out.write("".join(f"{text}\n" for text in texts).encode())
            records += len(texts)
    return Staged(name, records)


def publish(path: str, batch: str, staged: Iterable[Staged | None]) -> bool:
    """Second step, on the driver: list the files of a micro-batch; False if that was done before."""
    files, folder = open_folder(path)
    done = [message for message in staged if message is not None]
    target = f"{folder}/{_LISTS}/{batch}.json"
    if files.get_file_info(target).type != fs.FileType.NotFound:
        discard(path, done)
        return False
    files.create_dir(f"{folder}/{_LISTS}", recursive=True)
    entry = json.dumps({"batch": batch, "files": [s.file for s in done], "records": sum(s.records for s in done)})
    draft = f"{folder}/{_LISTS}/.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(entry.encode())
    files.move(draft, target)
    return True


def discard(path: str, staged: Iterable[Staged | None]) -> None:
    files, folder = open_folder(path)
    for message in staged:
        if message is not None:
            files.delete_file(f"{folder}/{_STAGED}/{message.file}")


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return stage(self.path, iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        publish(self.path, f"batch-{batchId}", messages)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        discard(self.path, messages)


class TableWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run: str):
        self.path = path
        self.run = run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return stage(self.path, iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        publish(self.path, f"run-{self.run}", messages)

    def abort(self, messages: list[Staged | None]) -> None:
        discard(self.path, messages)


def use_published(spark: SparkSession) -> str:
    """Make the format known to a session; returns its name, for ``line_sink`` and other writers."""
    ship_package(spark)
    spark.dataSource.register(PublishedLines)
    return FORMAT


def _published_files(spark: SparkSession, path: str) -> DataFrame:
    lists = spark.read.schema("batch string, files array<string>, records bigint").json(f"{path}/{_LISTS}/*.json")
    return lists.selectExpr("batch", "explode(files) AS file")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of every published record, and the ``batch`` that brought it."""
    files, folder = open_folder(path)
    if files.get_file_info(f"{folder}/{_LISTS}").type == fs.FileType.NotFound:
        return spark.createDataFrame([], "value string, batch string")
    lines = spark.read.text(f"{path}/{_STAGED}").selectExpr("value", "_metadata.file_name AS file")
    # The lists name files, not records: far smaller than the lines.
    return lines.join(_published_files(spark, path), "file").select("value", "batch")


def remove_unpublished(spark: SparkSession, path: str) -> int:
    """Delete files that no list names; only while nothing writes. Returns how many there were."""
    files, folder = open_folder(path)
    infos = files.get_file_info(fs.FileSelector(f"{folder}/{_STAGED}", allow_not_found=True))
    known = {row.file for row in _published_files(spark, path).select("file").toLocalIterator()}
    left = [info.path for info in infos if info.base_name not in known]
    for file in left:
        files.delete_file(file)
    return len(left)
