"""Latency from two frames: results, and where and when they arrived.

A result has an event time, its newest stamp; an arrival names the result and the time it came in. Both
are joined on the result within an interval of time. On streams both sides have a watermark, so
what can no longer meet anything leaves the state, and a result that nothing has met is given
with nulls once its interval has passed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

LATENCY_KEYS = ("sensor_id", "window_start_ms")
WITHIN = "1 hour"
_RESULT_TIME = "result_time"
_ARRIVAL_TIME = "arrival_time"


def match_arrivals(
    results: DataFrame,
    arrivals: DataFrame,
    keys: Sequence[str] = LATENCY_KEYS,
    stamp_col: str = "max_stamp",
    arrival_col: str = "ingestion_ts_ms",
    within: str = WITHIN,
    delay: str = "0 seconds",
) -> DataFrame:
    """Results with ``event_ts_ms``, ``ingestion_ts_ms`` and ``latency_ms``, null without an arrival.

    Times are epoch ms. An arrival counts from the result's event time on, at most ``within``
    later. A result that arrives more than once has a row for each arrival; arrivals of no result
    are left out, and so are results without an event time on a stream. ``delay`` is how late
    rows of either stream may come.
    """
    timed = results.withColumn(_RESULT_TIME, F.timestamp_millis(stamp_col))
    came = arrivals.select(
        *(F.col(key).alias(f"arrival_{key}") for key in keys),
        F.timestamp_millis(arrival_col).alias(_ARRIVAL_TIME),
    )
    if results.isStreaming:
        timed = timed.filter(F.col(_RESULT_TIME).isNotNull()).withWatermark(_RESULT_TIME, delay)
    if arrivals.isStreaming:
        came = came.withWatermark(_ARRIVAL_TIME, delay)
    met = (F.col(_ARRIVAL_TIME) >= F.col(_RESULT_TIME)) & (
        F.col(_ARRIVAL_TIME) <= F.col(_RESULT_TIME) + F.expr(f"interval {within}")
    )
    for key in keys:
        met = met & (F.col(f"arrival_{key}") == F.col(key))
    arrived = F.unix_millis(_ARRIVAL_TIME)
    return timed.join(came, met, "left_outer").select(
        *results.columns,
        F.unix_millis(_RESULT_TIME).alias("event_ts_ms"),
        arrived.alias("ingestion_ts_ms"),
        (arrived - F.unix_millis(_RESULT_TIME)).alias("latency_ms"),
    )


def open_results(
    spark: SparkSession,
    checkpoint: str,
    written: DataFrame,
    keys: Sequence[str] = LATENCY_KEYS,
    operator: int = 0,
) -> DataFrame:
    """Results of a stopped ``match_arrivals`` stream that wait for an arrival, with null latency.

    ``written`` is what the stream has given; with these rows it completes a bounded input.
    ``operator`` is the number of the join among the query's stateful operators.
    """
    state = spark.read.format("statestore").options(operatorId=operator, joinSide="left").load(checkpoint)
    waiting = state.select("value.*")
    rest = [c for c in written.columns if c not in ("event_ts_ms", "ingestion_ts_ms", "latency_ms")]
    none = F.lit(None).cast("bigint")
    # A result stays in the state while it may meet another arrival; those that met one are written.
    return (
        waiting.withColumn("event_ts_ms", F.unix_millis(_RESULT_TIME))
        .join(written.select(*keys, "event_ts_ms"), [*keys, "event_ts_ms"], "left_anti")
        .select(*rest, "event_ts_ms", none.alias("ingestion_ts_ms"), none.alias("latency_ms"))
    )
