"""Line sources. Every later operator takes any frame with a ``value`` string column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text files, one line per row."""
    return spark.read.text(path)


def stream_lines(
    spark: SparkSession,
    path: str | None = None,
    max_files: int | None = None,
    fmt: str = "text",
    **options: str,
) -> DataFrame:
    """A live line stream.

    The default follows a folder of text files, which can be replayed after a failure. Any other
    source with a ``value`` column works through ``fmt`` and ``options``, such as ``socket``
    (host, port) or ``kafka``.
    """
    reader = spark.readStream.format(fmt).options(**options)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.load(path) if path is not None else reader.load()
    return stream.select(F.col("value").cast("string").alias("value"))
