"""Results of open windows that later micro-batches replace.

A stream in update mode gives every window it has touched anew. Each micro-batch's rows go to a
folder of its own number; the row of a key is the one with the greatest number. Every so many
micro-batches the newest rows are merged into a base, so a reader meets few folders and the
table is not rewritten each time. A micro-batch that runs again, also one that was cut off half
way, overwrites its own folder with the same rows; a base is read only once it is whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.streaming.steps import complete, delete, each_step, numbered_folders

WINDOW_KEYS = ("sensor_id", "window_start_ms", "window_end_ms")
MERGE_EVERY = 20


def newest_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the row with the greatest ``step``."""
    rest = [c for c in rows.columns if c not in keys and c != "step"]
    newest = F.max_by(F.struct(*rest), "step").alias("row")
    return rows.groupBy(*keys).agg(F.max("step").alias("step"), newest).select(*keys, "step", "row.*")


def _rows(spark: SparkSession, path: str, base: int | None, until: int) -> DataFrame | None:
    """Base and steps after it, up to step ``until``."""
    first = -1 if base is None else base
    steps = [n for n in numbered_folders(spark, path, "step=") if first < n <= until]
    folders = [f"{path}/step={n}" for n in steps]
    if base is not None:
        folders.append(f"{path}/base={base}")
    parts = [spark.read.parquet(folder) for folder in folders]
    if not parts:
        return None
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _base(spark: SparkSession, path: str, until: int) -> int | None:
    return max((n for n in numbered_folders(spark, path, "base=") if n <= until), default=None)


def upsert_step(
    rows: DataFrame, number: int, path: str, keys: Sequence[str], merge_every: int = MERGE_EVERY
) -> None:
    """Write the rows of one micro-batch; safe to run again with the same number."""
    spark = rows.sparkSession
    stamped = rows.withColumn("step", F.lit(number).cast("bigint"))
    stamped.write.mode("overwrite").parquet(f"{path}/step={number}")
    if number == 0 or number % merge_every or complete(spark, f"{path}/base={number}"):
        return
    before = _base(spark, path, number - 1)
    newest_rows(_rows(spark, path, before, number), keys).write.mode("overwrite").parquet(
        f"{path}/base={number}"
    )
    # What the base before this one replaced goes now, when no reader still plans with it.
    for old in numbered_folders(spark, path, "base="):
        if before is not None and old < before:
            delete(spark, f"{path}/base={old}")
    for old in numbered_folders(spark, path, "step="):
        if before is not None and old <= before:
            delete(spark, f"{path}/step={old}")


def upsert_sink(
    results: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = WINDOW_KEYS,
    merge_every: int = MERGE_EVERY,
    mode: str = "update",
    **trigger,
) -> StreamingQuery:
    """Keep the newest row of every key of a stream of results; read with ``read_upserts``.

    In ``update`` mode only changed rows are written, in ``complete`` mode all of them.
    """
    if mode not in ("update", "complete"):
        raise ValueError("rows are replaced in update or complete mode only")

    def step(rows: DataFrame, number: int) -> None:
        upsert_step(rows, number, path, keys, merge_every)

    return each_step(results, step, checkpoint, mode, **trigger)


def read_upserts(
    spark: SparkSession, path: str, keys: Sequence[str] = WINDOW_KEYS
) -> DataFrame | None:
    """The newest row of every key, open windows included; None before the first micro-batch."""
    steps = numbered_folders(spark, path, "step=") + numbered_folders(spark, path, "base=")
    if not steps:
        return None
    last = max(steps)
    return newest_rows(_rows(spark, path, _base(spark, path, last), last), keys).drop("step")
