"""Count-sized batches of an ordered line sequence, and operators on batches."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeworks.functions.fields import split_fields, to_timestamp_utc
from gaugeworks.operators.parsing import reading_columns
from gaugeworks.operators.scans import exclusive_prefix
from gaugeworks.schemas import HEADER_PREFIX
from gaugeworks.sources.numbered import number_file_lines

# Batching rules.
BATCH_SIZE = 100
BATCH_SEPARATOR = ";"
BATCH_TIME_FIELD = 6  # one-based
# End of fixed values.


def batch_line_time(line: Column) -> Column:
    """Event time of a line in a batch: the time field split on one separator only."""
    text = F.split_part(line, F.lit(BATCH_SEPARATOR), F.lit(BATCH_TIME_FIELD))
    return to_timestamp_utc(text)


def count_batches(
    numbered: DataFrame, size: int = BATCH_SIZE, measurement: Column | None = None
) -> DataFrame:
    """Cut numbered lines (``value``, ``n``, ``total``) into batches of ``size`` lines.

    Returns ``batch_id`` (0, 1, 2, ...), ``is_last``, ``max_ts`` (the newest line time of this
    batch alone) and ``measurements`` in line order. A batch never has more than ``size`` rows,
    so no group is large. ``measurement`` is what is collected per line, the line by default.
    """
    collected = F.col("value") if measurement is None else measurement
    batches = numbered.groupBy(F.expr(f"n div {int(size)}").alias("batch_id")).agg(
        F.sort_array(F.collect_list(F.struct("n", collected.alias("item")))).alias("items"),
        F.max(batch_line_time(F.col("value"))).alias("max_ts"),
        F.max("total").alias("total"),
    )
    return batches.select(
        "batch_id",
        (F.col("batch_id") == F.expr(f"(total - 1) div {int(size)}")).alias("is_last"),
        "max_ts",
        F.col("items.item").alias("measurements"),
    )


def read_batches(spark: SparkSession, path: str | list[str], size: int = BATCH_SIZE) -> DataFrame:
    """Batches of text files; the first line of each file is skipped."""
    return count_batches(number_file_lines(spark, path), size)


def batch_event_time(batches: DataFrame) -> DataFrame:
    """Add ``event_ts`` and ``arrival_ts`` to batches.

    ``event_ts`` is the newest line time of all batches so far. The watermark a batch meets on
    arrival, ``arrival_ts``, is the same without the batch itself; null for the first. The
    running maximum is taken over ids and times only, not over the measurements.
    """
    times = exclusive_prefix(batches.select("batch_id", "max_ts"), "batch_id", "max_ts", "max")
    times = times.select(
        "batch_id",
        F.greatest("before", "max_ts").alias("event_ts"),
        F.col("before").alias("arrival_ts"),
    )
    return batches.join(times.hint("shuffle_hash"), "batch_id").drop("max_ts")


def shuffle_batches(
    batches: DataFrame, size: int = BATCH_SIZE, seed: int | None = None
) -> DataFrame:
    """Random order inside each full batch; a remainder batch keeps its order.

    The order follows from seed, batch and position alone, so a task that runs again after a
    lost executor gives the same one. Without ``seed`` each call draws a new one.
    """
    seed = random.getrandbits(62) if seed is None else seed

    def keyed(item: Column, position: Column) -> Column:
        draw = F.xxhash64(F.lit(seed), F.col("batch_id"), position)
        return F.struct(draw.alias("draw"), position.alias("position"), item.alias("item"))

    mixed = F.sort_array(F.transform("measurements", keyed)).getField("item")
    full = F.size("measurements") == size
    return batches.withColumn(
        "measurements", F.when(full, mixed).otherwise(F.col("measurements"))
    )


def strip_batch_header(batches: DataFrame, prefix: str = HEADER_PREFIX) -> DataFrame:
    """Remove the first measurement of a batch if it is a header line."""
    first = F.get("measurements", F.lit(0))
    rest = F.slice("measurements", 2, F.size("measurements"))
    return batches.withColumn(
        "measurements", F.when(first.startswith(prefix), rest).otherwise(F.col("measurements"))
    )


def parse_batches(batches: DataFrame, kind: str) -> DataFrame:
    """Parse every measurement of every batch in place, without exploding the batches."""
    fields = F.transform("measurements", split_fields)
    readings = F.transform(fields, lambda f: F.struct(*reading_columns(f, kind)))
    return batches.withColumn("measurements", readings)


def explode_batches(batches: DataFrame) -> DataFrame:
    """One row per measurement, with its position in the batch."""
    rest = [c for c in batches.columns if c != "measurements"]
    return batches.select(*rest, F.posexplode("measurements").alias("position", "measurement"))
