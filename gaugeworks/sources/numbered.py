"""Text files with dense line numbers, without a shuffle of the lines.

The lines are written once to the shared folder, each with its place: file, start of the file split it
was read from, and a row number that rises within the split. Counts and numbers both come from that
table, so they fit however the files were dealt to tasks, and whatever is read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gaugeworks.operators.scans import exclusive_prefix
from gaugeworks.session import settle
from gaugeworks.sources.lines import read_lines

# An offset row is some 64 bytes in memory; an offset table up to this size is broadcast, which is
# enough for hundreds of TB in splits of the usual 128 MB.
OFFSET_BYTES = 64
BROADCAST_BYTES = 512 << 20
SPLITS_PER_TASK = 10_000
PARTITION_BITS = 33  # of monotonically_increasing_id


def locate_lines(lines: DataFrame, label: str = "lines") -> DataFrame:
    """Write lines (``value``, ``file``, ``block``) with ``row``, ``part`` and ``split``.

    ``row`` rises along a file split, ``part`` is the task that read it and ``split`` a 64-bit
    hash of its place.
    """
    row = F.monotonically_increasing_id()
    return settle(
        lines.select(
            "value", "file", "block",
            row.alias("row"),
            F.shiftright(row, PARTITION_BITS).alias("part"),
            F.xxhash64("file", "block").alias("split"),
        ),
        label,
    )


def placed_lines(lines: DataFrame) -> DataFrame:
    """Text file lines, table or stream, with the ``file`` and ``block`` they come from."""
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def number_located(located: DataFrame, skip_first: bool = True) -> DataFrame:
    """Lines of ``locate_lines`` with ``n`` = 0, 1, 2, ... in path and file order, and ``total``."""
    splits = settle(
        located.groupBy("part", "split", "file", "block").agg(
            F.count(F.lit(1)).alias("lines"), F.min("row").alias("first_row")
        ),
        "splits",
    )
    named = splits.groupBy("part", "split").agg(F.count(F.lit(1)).alias("same"))
    count, most = named.agg(F.coalesce(F.sum("same"), F.lit(0)), F.max("same")).first()
    if most and most > 1:
        raise RuntimeError("two file splits of one task have the same name")

    # Splits in path order: ranges of them, each summed in one task, and a fold over the ranges.
    skipped = F.when(F.col("block") == 0, 1).otherwise(0) if skip_first else F.lit(0)
    sized = splits.withColumn("size", F.col("lines") - skipped).withColumn(
        "first_kept", F.col("first_row") + skipped
    )
    stretches = -(-count // SPLITS_PER_TASK)
    if stretches > 1:
        ranges = settle(
            sized.repartitionByRange(stretches, "file", "block").withColumn(
                "stretch", F.spark_partition_id().cast("bigint")
            ),
            "split-ranges",
        )
        sums = ranges.groupBy("stretch").agg(F.sum("size").alias("size"))
        before = exclusive_prefix(sums, "stretch", "size").select("stretch", "before", "overall")
    else:  # one range, of SPLITS_PER_TASK rows at most, with nothing before it
        ranges = sized.withColumn("stretch", F.lit(0).cast("bigint"))
        before = ranges.groupBy("stretch").agg(
            F.lit(0).cast("bigint").alias("before"), F.sum("size").alias("overall")
        )
    earlier = (
        Window.partitionBy("stretch")
        .orderBy("file", "block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranges.withColumn("inner", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .join(before, "stretch")
        .select(
            "part",
            "split",
            "first_kept",
            (F.col("before") + F.col("inner") - F.col("first_kept")).alias("shift"),
            F.col("overall").alias("total"),
        )
    )
    if count * OFFSET_BYTES <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    # A line without an offset would be one that the counts do not know: an error, not a loss.
    unknown = F.raise_error(F.lit("a line has no place among the file splits"))
    return (
        located.select("value", "part", "split", "row")
        .join(offsets, ["part", "split"], "left")
        .filter(F.coalesce(F.col("first_kept"), unknown) <= F.col("row"))
        .select("value", (F.col("row") + F.col("shift")).alias("n"), "total")
    )


def number_file_lines(
    spark: SparkSession, path: str | list[str], skip_first: bool = True
) -> DataFrame:
    """Lines of text files with ``n`` = 0, 1, 2, ... in path and file order, and ``total``.

    ``skip_first`` leaves out the first line of every file, whatever it says.
    """
    return number_located(locate_lines(placed_lines(read_lines(spark, path))), skip_first)
