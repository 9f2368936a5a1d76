"""Averages and latency summaries of all that a stream has brought so far.

A stream in append mode has no aggregate without a window. Here each micro-batch is reduced to
mergeable parts (count, sum, least, greatest), which are merged with the parts that the step before
left; only the parts are kept. One row per key for averages, one row in all for the latency.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.streaming.steps import StepState, each_step

_ONE_ROW = ("everything",)


def partial_values(rows: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Parts of a column per key. A NaN is a value: it makes the sum NaN, as it does in a mean."""
    column = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(column).alias("n"),
        F.sum(column).alias("total"),
        F.min(column).alias("least"),
        F.max(column).alias("greatest"),
    )


def merge_values(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of the same keys as one."""
    return parts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
    )


def _running(
    stream: DataFrame, value: str, keys: Sequence[str], state: str, checkpoint: str, trigger: dict
) -> StreamingQuery:
    store = StepState(state)

    def step(rows: DataFrame, number: int) -> None:
        parts = partial_values(rows, value, keys)
        earlier = store.before(rows.sparkSession, number)
        if earlier is not None:
            parts = merge_values(earlier.unionByName(parts), keys)
        store.keep(parts, number)

    return each_step(stream.select(*keys, value), step, checkpoint, **trigger)


def running_averages(
    readings: DataFrame, state: str, checkpoint: str, keys: Sequence[str] = ("sensor_id",), **trigger
) -> StreamingQuery:
    """Keep the mean temperature per key of a stream of readings; see ``averages_so_far``."""
    return _running(readings, "temperature", keys, state, checkpoint, trigger)


def averages_so_far(
    spark: SparkSession, state: str, keys: Sequence[str] = ("sensor_id",)
) -> DataFrame | None:
    """``avg_temperature`` of what the stream has brought; None before its first micro-batch."""
    parts = StepState(state).latest(spark)
    if parts is None:
        return None
    mean = F.coalesce(F.try_divide("total", F.col("n")), F.lit(float("nan")))
    return parts.select(*keys, mean.alias("avg_temp"))


def running_latency(latencies: DataFrame, state: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the latency summary of a stream of parsed log lines; see ``latency_so_far``."""
    one = latencies.withColumn(_ONE_ROW[0], F.lit(0))
    return _running(one, "latency_ms", _ONE_ROW, state, checkpoint, trigger)


def latency_so_far(spark: SparkSession, state: str) -> DataFrame | None:
    """``latency_summary`` of what the stream has brought; None before its first micro-batch."""
    parts = StepState(state).latest(spark)
    if parts is None:
        return None
    # Also one row where no line could be read, as the summary of a table has.
    whole = parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tuples"),
        F.min("least").alias("min_ms"),
        F.max("greatest").alias("max_ms"),
        _one_decimal(F.try_divide(F.sum("total"), F.sum("n"))).alias("avg_ms"),
    )
    return whole


def _one_decimal(mean: Column) -> Column:
    return F.round(mean, 1)
