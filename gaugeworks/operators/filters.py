"""Header, validity and reject filters; event time; line stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.schemas import HEADER_PREFIX


def drop_headers(lines: DataFrame, prefix: str = HEADER_PREFIX) -> DataFrame:
    """Drop every line that starts with the header prefix."""
    return lines.filter(~F.col("value").startswith(prefix))


def stamp_lines(lines: DataFrame, stamp_col: str | None = None) -> DataFrame:
    """Append the generator stamp (epoch ms) as last field; the current time by default.

    The current time is that of the query, on a stream that of the start of the micro-batch.
    """
    stamp = F.current_timestamp() if stamp_col is None else F.col(stamp_col)
    return lines.withColumn("value", F.concat_ws(",", "value", F.unix_millis(stamp)))


def valid_readings(readings: DataFrame, metric: str = "temperature") -> DataFrame:
    """Keep readings with a sensor id and a value. A NaN value is a value."""
    return readings.filter(F.col("sensor_id").isNotNull() & F.col(metric).isNotNull())


def reject_counts(metric: str = "temperature") -> list[Column]:
    """Aggregates for ``DataFrame.observe``: rows, and rows without key, event time or value."""
    needed = ("sensor_id", "timestamp", metric)
    return [
        F.count(F.lit(1)).alias("rows"),
        *(F.count_if(F.col(name).isNull()).alias(f"no_{name}") for name in needed),
    ]


def rejected_readings(readings: DataFrame, metric: str = "temperature") -> DataFrame:
    """Readings without key, event time or value, with the list of reasons for each."""
    needed = ("sensor_id", "timestamp", metric)
    missing = [F.col(name).isNull() for name in needed]
    reasons = [F.when(gone, F.lit(f"no_{name}")) for gone, name in zip(missing, needed)]
    rejected = readings.filter(missing[0] | missing[1] | missing[2])
    return rejected.withColumn("reasons", F.split(F.concat_ws(",", *reasons), ",", -1))


def reject_report(readings: DataFrame, metric: str = "temperature") -> DataFrame:
    """Rows per reject reason; a row with two defects counts under both."""
    rejected = rejected_readings(readings, metric)
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").count()


def with_event_time(readings: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Take event time from the reading; on a stream also set the watermark (no-op on tables)."""
    return readings.withWatermark("timestamp", delay)
