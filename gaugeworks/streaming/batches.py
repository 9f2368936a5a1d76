"""Count-sized batches of a stream of lines.

Micro-batches cut the lines anywhere; batches must not depend on where. Each micro-batch is
handled as a table: its lines are numbered in order, behind the lines that the step before could not
place yet. Kept between steps are only these lines (at most one batch), the number of the next batch
and the newest line time so far.

The last batch of the input is marked ``is_last``, and no micro-batch knows whether it is the last. So
a batch is written when a line behind it has come, and ``last_batch`` gives the one that is held
back, whole or not, for input that has ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.operators.batching import BATCH_SIZE, batch_event_time, batch_line_time, count_batches
from gaugeworks.operators.scans import number_rows
from gaugeworks.session import forget, settle
from gaugeworks.sources.numbered import locate_lines, number_located, placed_lines
from gaugeworks.streaming.steps import StepState, each_step, numbered_folders



def _cut(numbered: DataFrame, held: DataFrame | None, size: int) -> tuple[DataFrame | None, DataFrame]:
    """Whole batches with a line behind them, and what is held back after them.

    ``numbered`` has the lines of a micro-batch, with ``n`` from 0.
    """
    spark = numbered.sparkSession
    before, next_batch, newest = 0, 0, None
    if held is not None:
        # At most ``size`` lines; a summary of them.
        before, next_batch, newest = held.agg(
            F.count("value"), F.max("next_batch"), F.max("newest")
        ).first()
    lines = numbered.select("value", (F.col("n") + before).alias("n"))
    if before:
        again = held.filter(F.col("value").isNotNull())
        lines = lines.unionByName(again.select("value", F.col("place").alias("n")))
    lines = settle(lines, "placed")
    count = lines.count()
    whole = max(0, count - 1) // size
    batches = None
    if whole:
        chosen = lines.filter(F.col("n") < whole * size).withColumn("total", F.lit(count))
        carried = F.timestamp_micros(F.lit(newest).cast("bigint"))
        timed = batch_event_time(count_batches(chosen, size))
        batches = timed.select(
            (F.col("batch_id") + next_batch).alias("batch_id"),
            F.lit(False).alias("is_last"),
            F.greatest("event_ts", carried).alias("event_ts"),
            F.greatest("arrival_ts", carried).alias("arrival_ts"),
            "measurements",
        )
        latest = F.greatest(F.max(batch_line_time(F.col("value"))), carried)
        newest = chosen.agg(F.unix_micros(latest)).first()[0]
    # The lines held back, and a row without a line, so that the counters are always kept.
    rest = lines.filter(F.col("n") >= whole * size).select(
        (F.col("n") - whole * size).alias("place"), "value"
    )
    mark = spark.range(1).select(
        F.lit(None).cast("bigint").alias("place"), F.lit(None).cast("string").alias("value")
    )
    held = rest.unionByName(mark).select(
        F.lit(next_batch + whole).cast("bigint").alias("next_batch"),
        F.lit(newest).cast("bigint").alias("newest"),
        "place",
        "value",
    )
    return batches, held.coalesce(1)


def batches_stream(
    lines: DataFrame,
    path: str,
    state: str,
    checkpoint: str,
    size: int = BATCH_SIZE,
    order_col: str | None = None,
    skip_first: bool = True,
    **trigger,
) -> StreamingQuery:
    """Write the batches of a stream of lines to ``path``, one folder per micro-batch.

    ``lines`` is a text file stream, whose files arrive in path order and whose first lines are left
    out (``skip_first``), or any stream with a unique BIGINT ``order_col`` that rises from one micro-batch
    to the next. Read the batches with ``read_batches_stream``.
    """
    store = StepState(state)
    chosen = placed_lines(lines) if order_col is None else lines.select("value", order_col)

    def step(rows: DataFrame, number: int) -> None:
        if order_col is None:
            located = locate_lines(rows)
            numbered = number_located(located, skip_first)
        else:
            located = settle(rows, "lines")
            numbered = number_rows(located, order_col)
        batches, held = _cut(numbered, store.before(rows.sparkSession, number), size)
        if batches is not None:
            batches.write.mode("overwrite").parquet(f"{path}/step={number}")
        store.keep(held, number)
        forget(located)

    return each_step(chosen, step, checkpoint, **trigger)


def last_batch(spark: SparkSession, state: str) -> DataFrame | None:
    """The batch that is held back, as the last of the input; None if there is no line in it."""
    held = StepState(state).latest(spark)
    if held is None:
        return None
    held = held.filter(F.col("value").isNotNull())
    items = F.sort_array(F.collect_list(F.struct("place", "value")))
    own = F.max(batch_line_time(F.col("value")))
    before = F.timestamp_micros("newest").alias("arrival_ts")
    batch = held.groupBy(F.col("next_batch").alias("batch_id"), before).agg(
        own.alias("own"), items.alias("items")
    )
    return batch.select(
        "batch_id",
        F.lit(True).alias("is_last"),
        F.greatest("own", "arrival_ts").alias("event_ts"),
        "arrival_ts",
        F.col("items.value").alias("measurements"),
    )


def read_batches_stream(
    spark: SparkSession, path: str, state: str, ended: bool = True
) -> DataFrame | None:
    """The batches a stream has written, with the last one if its input has ``ended``."""
    folders = [f"{path}/step={n}" for n in numbered_folders(spark, path, "step=")]
    batches = spark.read.parquet(*folders) if folders else None
    last = last_batch(spark, state) if ended else None
    if batches is None or last is None:
        return last if batches is None else batches
    return batches.unionByName(last)
