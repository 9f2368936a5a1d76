"""Running streaming queries to the end of what has arrived, and reading windows still open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.operators.windows import merge_partials, result_of_partials

_PARTIAL = "temp_sum: double, temp_count: bigint, stamp: bigint"
_MERGED = f"first_start: timestamp, {_PARTIAL}"


def run_available(
    results: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"
) -> StreamingQuery:
    """Process everything that has arrived into files at ``path``, then stop.

    The next run with the same ``checkpoint`` goes on where this one ended. Results are appended
    exactly once; a window is written when the watermark passes its end.
    """
    query = (
        results.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return query


def _state(
    spark: SparkSession, checkpoint: str, operator: int, values: str, keys: Sequence[str]
) -> DataFrame:
    state = spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
    named = state.select("key", F.col("value").cast(f"struct<{values}>").alias("value"))
    return named.select("key.window", *(f"key.{k}" for k in keys), "value.*")


def open_windows(
    spark: SparkSession, checkpoint: str, keys: Sequence[str] = ("sensor_id",)
) -> DataFrame:
    """Results so far of the windows a stopped ``tumbling_avg`` stream has not closed yet.

    A stream in append mode holds the windows that its watermark has not passed. At the end of
    a bounded input they complete what it wrote. Nothing is added to the input and the watermark
    stays where it is, so the stream can go on with later readings.
    """
    return result_of_partials(_state(spark, checkpoint, 0, _PARTIAL, keys), keys)


def open_rollups(
    spark: SparkSession, checkpoint: str, duration: str, keys: Sequence[str] = ("sensor_id",)
) -> DataFrame:
    """The same for a stream of ``merge_partials``: open coarse windows, with open fine ones in them."""
    coarse = _state(spark, checkpoint, 0, _MERGED, keys).drop("first_start")
    fine = _state(spark, checkpoint, 1, _PARTIAL, keys)
    return merge_partials(coarse.unionByName(fine), duration, keys)
