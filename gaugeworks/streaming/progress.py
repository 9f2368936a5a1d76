"""Counts of a stream per micro-batch, kept as a table.

A listener writes one small file per micro-batch: rows read, rows without key, time or value (the
observed metrics ``rejects``), and rows that came behind the watermark and were dropped. A micro-batch
that runs again overwrites its file, so nothing counts twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gaugeworks.streaming.steps import exists

COUNTS = (
    "query string, batch_id bigint, rows_read bigint, dropped_late bigint, "
    "observed bigint, rejects map<string, bigint>"
)
METRIC = "rejects"


def progress_counts(progress) -> dict:
    """The counts of one micro-batch from its progress report."""
    seen = progress.observedMetrics.get(METRIC)
    seen = seen.asDict() if seen is not None else {}
    return {
        "query": str(progress.id),
        "batch_id": progress.batchId,
        "rows_read": progress.numInputRows,
        "dropped_late": sum(op.numRowsDroppedByWatermark for op in progress.stateOperators),
        "observed": seen.pop("rows", 0) or 0,
        "rejects": {reason: n or 0 for reason, n in seen.items()},
    }


class ProgressLog(StreamingQueryListener):
    """Writes the counts of every micro-batch below ``path``, for all queries or those named."""

    def __init__(self, spark: SparkSession, path: str, names: tuple[str, ...] = ()):
        self.spark = spark
        self.path = path.rstrip("/")
        self.names = names

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if self.names and progress.name not in self.names:
            return
        counts = progress_counts(progress)
        self._write(f"{self.path}/{counts['query']}-{counts['batch_id']}.json", json.dumps(counts))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def _write(self, path: str, text: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(target, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


@contextmanager
def progress_log(spark: SparkSession, path: str, names: tuple[str, ...] = ()) -> Iterator[ProgressLog]:
    """Log the micro-batches of the streams that run inside."""
    log = ProgressLog(spark, path, names)
    spark.streams.addListener(log)
    try:
        yield log
        # Reports come on a queue of their own; the last ones may still be on their way.
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)


def progress_table(spark: SparkSession, path: str) -> DataFrame:
    """One row of counts per query and micro-batch."""
    if not exists(spark, path):
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).json(path)


def stream_reject_report(spark: SparkSession, path: str) -> DataFrame:
    """``reject_report`` of all that the logged streams have read: rows per reject reason."""
    reasons = progress_table(spark, path).select(F.explode("rejects").alias("reason", "n"))
    report = reasons.groupBy("reason").agg(F.sum("n").alias("count"))
    return report.filter(F.col("count") > 0)
