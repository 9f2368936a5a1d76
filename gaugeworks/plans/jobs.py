"""The jobs: compositions of operators from source to sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.functions.fields import split_fields
from gaugeworks.operators.batching import (
    BATCH_SIZE,
    batch_event_time,
    count_batches,
    shuffle_batches,
)
from gaugeworks.operators.filters import (
    drop_headers,
    reject_counts,
    valid_readings,
    with_event_time,
)
from gaugeworks.operators.formatting import RESULT_WITH_STAMP, result_line_with_stamp
from gaugeworks.operators.latency import (
    compute_latency,
    latency_line,
    latency_summary,
    parse_latency,
    relative_time,
    rolling_avg,
)
from gaugeworks.operators.parsing import parse_readings, reading_columns
from gaugeworks.operators.scans import number_rows
from gaugeworks.operators.windows import tumbling_avg
from gaugeworks.schemas import HEADER_PREFIX, STAMP
from gaugeworks.session import settle
from gaugeworks.sinks.lines import line_sink
from gaugeworks.sources.lines import read_lines
from gaugeworks.sources.numbered import number_file_lines


def parsed_batches(
    numbered: DataFrame,
    kind: str = "pms7003",
    size: int = BATCH_SIZE,
    seed: int | None = None,
    header_prefix: str = HEADER_PREFIX,
) -> DataFrame:
    """Numbered lines to parsed batches: cut, time, shuffle, strip a leading header, parse.

    Gives what the single batch operators give in that order, but parses each line in generated
    code before it is collected; the header mark travels with the reading until the batch has
    its final order.
    """
    split = numbered.withColumn("fields", F.explode(F.array(split_fields(F.col("value")))))
    marked = split.withColumn(
        "marked",
        F.struct(
            F.col("value").startswith(header_prefix).alias("is_header"),
            F.struct(*reading_columns(F.col("fields"), kind)).alias("reading"),
        ),
    )
    batches = batch_event_time(count_batches(marked, size, F.col("marked")))
    mixed = shuffle_batches(batches, size, seed)
    readings = F.col("measurements.reading")
    starts_with_header = F.get("measurements.is_header", F.lit(0))
    stripped = F.slice(readings, F.lit(2), F.size("measurements"))
    return mixed.withColumn(
        "measurements", F.when(starts_with_header, stripped).otherwise(readings)
    )


def batch_parse_job(
    spark: SparkSession,
    path: str | list[str],
    kind: str = "pms7003",
    size: int = BATCH_SIZE,
    seed: int | None = None,
) -> DataFrame:
    """Files to parsed batches. Print with ``print_sink``."""
    return parsed_batches(number_file_lines(spark, path), kind, size, seed)


def windowed_temperature(
    lines: DataFrame, duration: str = "1 minute", delay: str = "0 seconds"
) -> DataFrame:
    """BME280 lines, table or stream, to average temperature per sensor and window.

    Rows without key, time or value are left out and counted as the observed metrics ``rejects``
    of the query that runs this, at no extra pass.
    """
    readings = parse_readings(
        drop_headers(lines), "bme280", columns=["sensor_id", "timestamp", "temperature", STAMP]
    )
    counted = readings.observe("rejects", *reject_counts())
    return tumbling_avg(with_event_time(valid_readings(counted), delay), duration)


def windowed_temperature_file(
    spark: SparkSession, path: str | list[str], duration: str = "1 minute"
) -> DataFrame:
    """Files to window results with their ``line``. Print with ``print_sink``."""
    return result_line_with_stamp(windowed_temperature(read_lines(spark, path), duration))


def windowed_temperature_stream(
    lines: DataFrame,
    sink_path: str,
    checkpoint: str,
    duration: str = "1 minute",
    delay: str = "0 seconds",
    **options,
) -> StreamingQuery:
    """A line stream to result lines in ``sink_path``, each written once its window has closed.

    ``options`` go to ``line_sink``: another format and its options, or a trigger. Every
    micro-batch reports the rejected rows as the observed metrics ``rejects``.
    """
    results = result_line_with_stamp(windowed_temperature(lines, duration, delay))
    return line_sink(results, sink_path, checkpoint, **options)


def latency_log(spark: SparkSession, results_path: str) -> DataFrame:
    """Result files, stamps included, to latency log lines in ``value``, with their parts.

    A result has arrived when the file that holds it was finished, so the time its micro-batch
    took is part of the latency. Lines that are not results are left out.
    """
    lines = spark.read.text(results_path).select(
        "value", F.unix_millis("_metadata.file_modification_time").alias("arrived_ms")
    )
    parts = RESULT_WITH_STAMP
    split = lines.filter(F.col("value").rlike(parts)).select(
        F.regexp_extract("value", parts, 1).alias("line"),
        F.regexp_extract("value", parts, 2).cast("bigint").alias("max_stamp"),
        "arrived_ms",
    )
    return latency_line(compute_latency(split, ingestion_ms=F.col("arrived_ms")))


def latency_report(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """Latency log files to a ``summary`` and a ``series``.

    The series has the seconds since the first row and, from the 50th row on, the rolling mean
    (null before). The parsed log is written to the shared folder once; all else reads that.
    """
    numbered = number_file_lines(spark, path, skip_first=False)
    parsed = parse_latency(numbered.select("value", F.col("n").alias("line_no")), ("line_no",))
    parsed = settle(parsed, "latencies")
    series = relative_time(number_rows(parsed, "line_no").drop("total"), "line_no", parsed)
    return {"summary": latency_summary(parsed), "series": rolling_avg(series, full_only=False)}
