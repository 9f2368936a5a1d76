"""Temperature averages, plain and per tumbling event-time window.

All aggregates here combine before the shuffle, so a sensor that sends a third of all rows costs
one partial row per task and window, not a hot task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.schemas import STAMP

# Fixed value: the newest stamp of a group without any temperature.
NO_STAMP = -(2**63)


def _stamp_of_valued_row() -> Column:
    return F.when(F.col("temperature").isNotNull(), F.col(STAMP))


def _avg_temp() -> Column:
    return F.coalesce(F.avg("temperature"), F.lit(float("nan"))).alias("avg_temp")


def _max_stamp() -> Column:
    return F.coalesce(F.max(_stamp_of_valued_row()), F.lit(NO_STAMP)).alias("max_stamp")


def avg_temperature(readings: DataFrame, keys: Sequence[str | Column] = ()) -> DataFrame:
    """Mean of the non-null temperatures per key; NaN when there are none."""
    return readings.groupBy(*keys).agg(_avg_temp())


def avg_temperature_max_stamp(readings: DataFrame, keys: Sequence[str | Column] = ()) -> DataFrame:
    """As ``avg_temperature``, plus the newest stamp among the rows that have a temperature."""
    return readings.groupBy(*keys).agg(_avg_temp(), _max_stamp())


def window_result(averages: DataFrame, keys: Sequence[str] = ("sensor_id",)) -> DataFrame:
    """Replace the window struct by its bounds in epoch ms."""
    rest = [c for c in averages.columns if c != "window" and c not in keys]
    return averages.select(
        *keys,
        F.unix_millis("window.start").alias("window_start_ms"),
        F.unix_millis("window.end").alias("window_end_ms"),
        *rest,
    )


def tumbling_avg(
    readings: DataFrame, duration: str = "1 minute", keys: Sequence[str] = ("sensor_id",)
) -> DataFrame:
    """Average and newest stamp per key and epoch-aligned ``[start, end)`` window."""
    averages = avg_temperature_max_stamp(readings, [F.window("timestamp", duration), *keys])
    return window_result(averages, keys)


def tumbling_partials(
    readings: DataFrame, duration: str = "1 hour", keys: Sequence[str] = ("sensor_id",)
) -> DataFrame:
    """Mergeable partials (sum, count, newest stamp) per key and fine ``window``, table or stream."""
    return (
        readings.groupBy(F.window("timestamp", duration), *keys)
        .agg(
            F.sum("temperature").alias("temp_sum"),
            F.count("temperature").alias("temp_count"),
            F.max(_stamp_of_valued_row()).alias("stamp"),
        )
        .select(*keys, "window", "temp_sum", "temp_count", "stamp")
    )


def result_of_partials(partials: DataFrame, keys: Sequence[str] = ("sensor_id",)) -> DataFrame:
    """Partials, one per key and window, as the result rows of ``tumbling_avg``."""
    mean = F.coalesce(F.try_divide("temp_sum", "temp_count"), F.lit(float("nan")))
    newest = F.coalesce("stamp", F.lit(NO_STAMP))
    return window_result(
        partials.select("window", *keys, mean.alias("avg_temp"), newest.alias("max_stamp")), keys
    )


def merge_partials(
    partials: DataFrame, duration: str = "1 day", keys: Sequence[str] = ("sensor_id",)
) -> DataFrame:
    """Roll partials up into coarser windows; the result has the shape of ``tumbling_avg``.

    ``duration`` must be a multiple of the partials' own window; a fine window that does not lie
    in one coarse window ends the job with an error. On a stream the fine windows close first and
    their own event time decides when a coarse one does.
    """
    coarse = F.window(F.window_time("window"), duration)
    total, count = F.sum("temp_sum"), F.sum("temp_count")
    mean = F.coalesce(F.try_divide(total, count), F.lit(float("nan")))
    merged = partials.withColumn("fine_start", F.col("window.start")).groupBy(coarse, *keys).agg(
        mean.alias("avg_temp"),
        F.coalesce(F.max("stamp"), F.lit(NO_STAMP)).alias("max_stamp"),
        F.min("fine_start").alias("first_start"),
    )
    astray = F.col("first_start") < F.col("window.start")
    wrong = F.raise_error(F.lit(f"{duration} is not a multiple of the partials' window"))
    checked = merged.withColumn("avg_temp", F.when(astray, wrong).otherwise(F.col("avg_temp")))
    return window_result(checked.drop("first_start"), keys)
