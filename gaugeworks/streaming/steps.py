"""What a stream that is handled micro-batch by micro-batch keeps between them.

Each step overwrites folders of its own number and reads those of the number before. So a step
that runs again after a failure starts from the same state and leaves the same files, and what it
wrote is whole or is written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, files = _folder(spark, path)
    return files.exists(folder)


def delete(spark: SparkSession, path: str) -> None:
    folder, files = _folder(spark, path)
    files.delete(folder, True)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written at ``path`` to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def numbered_folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the finished tables ``<path>/<prefix><number>``, in order."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    numbers = [int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit()]
    return sorted(n for n in numbers if complete(spark, f"{path}/{prefix}{n}"))


class StepState:
    """One small table per micro-batch, of which the last two are kept."""

    def __init__(self, path: str, prefix: str = ""):
        self.path = path.rstrip("/")
        self.prefix = prefix

    def place(self, number: int) -> str:
        return f"{self.path}/{self.prefix}{number}"

    def before(self, spark: SparkSession, number: int) -> DataFrame | None:
        """What the step before ``number`` left; None for the first step."""
        if number == 0:
            return None
        if not complete(spark, self.place(number - 1)):
            raise RuntimeError(f"the state of step {number - 1} is not at {self.path}")
        return spark.read.parquet(self.place(number - 1))

    def keep(self, table: DataFrame, number: int) -> None:
        table.write.mode("overwrite").parquet(self.place(number))
        if number > 1:
            delete(table.sparkSession, self.place(number - 2))

    def latest(self, spark: SparkSession) -> DataFrame | None:
        """What the last finished step left; None before any."""
        numbers = numbered_folders(spark, self.path, self.prefix)
        return spark.read.parquet(self.place(numbers[-1])) if numbers else None


def each_step(
    stream: DataFrame,
    step: Callable[[DataFrame, int], None],
    checkpoint: str,
    output_mode: str = "append",
    **trigger,
) -> StreamingQuery:
    """Run ``step`` on every micro-batch of a stream."""
    writer = stream.writeStream.foreachBatch(step).outputMode(output_mode)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
