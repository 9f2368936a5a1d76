"""End-to-end latency: log lines, summary, time series and rolling mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The latency log.
LOG_SEPARATOR = ","
LOG_MIN_PARTS = 3
LOG_INTEGER_TEXT = r"\A\s*[+-]?[0-9]+(_[0-9]+)*\s*\z"
ROLLING_ROWS = 50
# End of fixed values.

_BLOCK_ROWS = 1 << 14


def _whole_number(text: Column) -> Column:
    digits = F.regexp_replace(text, r"[\s_]+", "")
    return F.when(text.rlike(LOG_INTEGER_TEXT), digits.try_cast("bigint"))


def parse_latency(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Log lines to ``latency_ms``, ``result``, ``event_ts_ms``, ``ingestion_ts_ms``.

    Result text may hold commas: latency is the first part, the two times are the last ones.
    Lines with fewer than three parts, or without a whole number first or last, are dropped.
    """
    # As in parse_readings, the one-element explode keeps later filters above the split.
    parts = F.explode(F.array(F.split("value", LOG_SEPARATOR, -1)))
    split = lines.select(*keep, parts.alias("parts"))
    size = F.size("parts")
    parsed = split.filter(size >= LOG_MIN_PARTS).select(
        *keep,
        _whole_number(F.get("parts", F.lit(0))).alias("latency_ms"),
        F.array_join(F.slice("parts", F.lit(2), size - 3), LOG_SEPARATOR).alias("result"),
        _whole_number(F.get("parts", size - 2)).alias("event_ts_ms"),
        _whole_number(F.get("parts", size - 1)).alias("ingestion_ts_ms"),
    )
    return parsed.filter(F.col("latency_ms").isNotNull() & F.col("ingestion_ts_ms").isNotNull())


def compute_latency(
    results: DataFrame, stamp_col: str = "max_stamp", ingestion_ms: Column | None = None
) -> DataFrame:
    """Add ``event_ts_ms``, ``ingestion_ts_ms`` and their difference ``latency_ms``.

    The event time of a window result is the newest stamp in it; ingestion is the current time
    unless a column of epoch ms is given.
    """
    arrived = F.unix_millis(F.current_timestamp()) if ingestion_ms is None else ingestion_ms
    return (
        results.withColumn("event_ts_ms", F.col(stamp_col))
        .withColumn("ingestion_ts_ms", arrived)
        .withColumn("latency_ms", F.col("ingestion_ts_ms") - F.col("event_ts_ms"))
    )


def latency_line(latencies: DataFrame, result_col: str = "line") -> DataFrame:
    """Add ``value``: the latency log line of each result."""
    parts = ("latency_ms", result_col, "event_ts_ms", "ingestion_ts_ms")
    return latencies.withColumn("value", F.concat_ws(LOG_SEPARATOR, *parts))


def latency_summary(latencies: DataFrame) -> DataFrame:
    """Count, minimum, maximum and mean (one decimal) of the latency."""
    return latencies.agg(
        F.count("latency_ms").alias("tuples"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
        F.round(F.avg("latency_ms"), 1).alias("avg_ms"),
    )


def relative_time(
    latencies: DataFrame, order_col: str = "n", source: DataFrame | None = None
) -> DataFrame:
    """Add ``rel_s``: seconds since the first row in ``order_col`` order (not the earliest time).

    ``source`` holds the same rows where they are cheaper to read, such as a settled table that
    ``latencies`` was derived from; the first time is looked up there.
    """
    rows = latencies if source is None else source
    first = rows.agg(F.min_by("ingestion_ts_ms", order_col)).scalar()
    return latencies.withColumn("rel_s", (F.col("ingestion_ts_ms") - first) / 1000.0)


def rolling_avg(
    latencies: DataFrame, rows: int = ROLLING_ROWS, order_col: str = "n", full_only: bool = True
) -> DataFrame:
    """Add ``rolling_ms``, the mean of a row and the ``rows - 1`` before it.

    Rows without a full window are dropped, or kept with null if not ``full_only``.

    ``order_col`` is dense (see ``number_rows``). Rows are cut into blocks of neighbours, and the
    last ``rows - 1`` of a block are also sent to the next one, so that blocks are independent.
    """
    block_rows = max(_BLOCK_ROWS, rows)
    home = F.expr(f"{order_col} div {block_rows}")
    in_block = F.col(order_col) % block_rows
    blocks = F.when(in_block > block_rows - rows, F.array(home, home + 1)).otherwise(F.array(home))
    frame = Window.partitionBy("block").orderBy(order_col).rowsBetween(-(rows - 1), 0)
    return (
        latencies.withColumn("block", F.explode(blocks))
        .withColumn("rolling_ms", F.avg("latency_ms").over(frame))
        .withColumn("full", F.count(F.lit(1)).over(frame) == rows)
        .filter((F.col("block") == home) & (F.col("full") if full_only else F.lit(True)))
        .withColumn("rolling_ms", F.when(F.col("full"), F.col("rolling_ms")))
        .drop("block", "full")
    )
