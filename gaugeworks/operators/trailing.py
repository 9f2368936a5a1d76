"""Trailing windows of batches: what is still within the horizon when a batch arrives.

Input rows carry ``batch_id`` in arrival order and ``arrival_ts``, the watermark met on arrival (see
``batch_event_time``), which never decreases with the id. A batch that arrives before any
watermark is tagged null; it sees only itself and no later batch sees it.

The window of a batch is the batches ``b`` of its key with ``after_batch_id < b <= batch_id``. As tags
never decrease, the bound follows from the tag alone: it is the newest batch whose tag is at
least a horizon older. So windows take constant space each, and no work is grouped by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeworks.operators.scans import exclusive_prefix
from gaugeworks.session import settle

DAY_MS = 86_400_000
_KEYS = 1 << 22
_IDS = 1 << 39


def newest_per_tag(batches: DataFrame) -> DataFrame:
    """Per tag ``t`` the oldest and newest batch id; the null tag is one of the rows."""
    tag = F.unix_millis("arrival_ts").alias("t")
    return batches.groupBy(tag).agg(
        F.min("batch_id").alias("oldest"), F.max("batch_id").alias("newest")
    )


def add_bounds(batches: DataFrame, seen: DataFrame, horizon_ms: int = DAY_MS) -> DataFrame:
    """Add ``after_batch_id``, given the tags of these and all earlier batches in the horizon.

    ``seen`` has the columns of ``newest_per_tag``. Ids of all keys must come from one sequence
    in which tags never fall; a tag that starts before an older one ends is an error.
    """
    untagged = seen.filter(F.col("t").isNull()).agg(F.max("newest")).first()[0]
    floor = -1 if untagged is None else untagged
    seen = seen.filter(F.col("t").isNotNull())
    asked = seen.select(
        (F.col("t") - int(horizon_ms)).alias("t"),
        F.lit(None).cast("bigint").alias("oldest"),
        F.lit(None).cast("bigint").alias("newest"),
    )
    points = settle(
        seen.select("t", "oldest", "newest")
        .unionByName(asked)
        .groupBy("t")
        .agg(F.min("oldest").alias("oldest"), F.max("newest").alias("newest")),
        "tags",
    )
    falls = F.raise_error(F.lit("arrival times fall while batch ids rise"))
    bounds = (
        exclusive_prefix(points, "t", "newest", "max")
        .join(points.select("t", "oldest"), "t")
        .select(
            (F.col("t") + int(horizon_ms)).alias("tag"),
            F.when(F.col("before") > F.col("oldest"), falls)
            .otherwise(F.greatest("before", "newest"))
            .alias("bound"),
        )
    )
    tagged = batches.withColumn("tag", F.unix_millis("arrival_ts"))
    after = F.when(F.col("tag").isNull(), F.col("batch_id") - 1).otherwise(
        F.coalesce("bound", F.lit(floor))
    )
    return tagged.join(bounds, "tag", "left").withColumn("after_batch_id", after).drop("tag", "bound")


def trailing_bounds(batches: DataFrame, horizon_ms: int = DAY_MS) -> DataFrame:
    """Add ``after_batch_id`` to a table of batches; linear in time and space for any key."""
    return add_bounds(batches, settle(newest_per_tag(batches), "seen"), horizon_ms)


def window_counts(bounds: DataFrame, key: str) -> DataFrame:
    """Add ``n_batches``, how many batches the window of each one holds; linear like the bounds.

    ``key`` is a whole number from 0 to 2**22 - 1 and ids are below 2**39. Batches and bounds are
    laid out on one line, key by key; a window holds what lies between its two places. One running
    sum over that line, in ranges, counts it for busy and for rare keys alike.
    """
    wide = F.raise_error(F.lit("a key or a batch id is too large to count windows by"))
    fits = F.col(key).between(0, _KEYS - 1) & (F.col("batch_id") < _IDS) & (F.col("after_batch_id") >= -1)
    keyed = F.when(fits, F.col(key).cast("bigint") * (2 * _IDS + 2))
    # Batch b lies at 2b + 1 behind its key's start, the place just behind it at 2b + 2.
    placed = settle(
        bounds.withColumn("start", F.coalesce(keyed, wide.cast("bigint")))
        .withColumn("at", F.col("start") + F.col("batch_id") * 2 + 1)
        .withColumn("low", F.col("start") + F.col("after_batch_id") * 2 + 2)
        .drop("start"),
        "placed",
    )
    points = placed.select("at", F.lit(1).alias("one")).unionByName(
        placed.select(F.col("low").alias("at"), F.lit(0).alias("one")).distinct()
    )
    sums = settle(exclusive_prefix(points, "at", "one").select("at", "before"), "places")
    return (
        placed.join(sums.withColumnRenamed("before", "upto"), "at")
        .join(sums.select(F.col("at").alias("low"), F.col("before").alias("below")), "low")
        .withColumn("n_batches", F.col("upto") + 1 - F.col("below"))
        .drop("at", "low", "upto", "below")
    )


def window_lists(bounds: DataFrame, key: str, step: int = 1 << 10) -> DataFrame:
    """Add ``window_ids``, the ids of all batches in each window, rising and joined by commas.

    ``bounds`` holds all batches with their bounds. The result is as large as all windows are. What it is
    made from is not: the batches of a key and a stretch of ``step`` ids share most of their windows. What
    all of them hold is made into text once; only the ids at either end are picked per batch. Bounds
    never fall, so the ids in front are those of one stretch only.
    """
    bounds = settle(bounds.withColumn("stretch", F.expr(f"batch_id div {int(step)}")), "windows")
    ids = bounds.groupBy(F.col(key), F.col("stretch").alias("part")).agg(
        F.sort_array(F.collect_list("batch_id")).alias("ids")
    )
    asked = (
        bounds.groupBy(key, "stretch")
        .agg(
            F.min("after_batch_id").alias("low"),
            F.min("batch_id").alias("first"),
            F.least(F.max("after_batch_id"), F.min("batch_id") - 1).alias("cut"),
        )
        .withColumn("part", F.explode(F.sequence(F.expr(f"(low + 1) div {int(step)}"), "stretch")))
    )
    shared = (
        asked.join(ids, [key, "part"])
        .groupBy(key, "stretch", "low", "cut", "first")
        .agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("parts"))
        .withColumn("ids", F.flatten("parts.ids"))
        .select(
            key, "stretch",
            F.expr("filter(ids, x -> x > low and x <= cut)").alias("front"),
            F.expr("nullif(array_join(cast(filter(ids, x -> x > cut and x < first) as array<string>), ','), '')").alias("middle"),
            F.expr("filter(ids, x -> x >= first)").alias("back"),
        )
    )
    front = F.expr("cast(filter(front, x -> x > after_batch_id) as array<string>)")
    back = F.expr("cast(filter(back, x -> x > after_batch_id and x <= batch_id) as array<string>)")
    return (
        bounds.join(shared, [key, "stretch"])
        .withColumn("window_ids", F.concat_ws(",", front, "middle", back))
        .drop("stretch", "front", "middle", "back")
    )


def window_members(
    chosen: DataFrame, batches: DataFrame, key: str, step: int = 1 << 10
) -> DataFrame:
    """The batches in the windows of some chosen ones (with bounds), one row per pair.

    For looking into single windows: the result is as large as the chosen windows are. Ids are
    matched by stretches of ``step`` ids, so the join has a key besides the busy one.
    """
    low = F.expr(f"(after_batch_id + 1) div {int(step)}")
    asked = chosen.select(
        F.col(key), "batch_id", "after_batch_id",
        F.explode(F.sequence(low, F.expr(f"batch_id div {int(step)}"))).alias("stretch"),
    )
    members = batches.withColumnRenamed("batch_id", "member_id").withColumn(
        "stretch", F.expr(f"member_id div {int(step)}")
    )
    return (
        asked.join(members, [key, "stretch"])
        .filter((F.col("member_id") > F.col("after_batch_id")) & (F.col("member_id") <= F.col("batch_id")))
        .drop("stretch", "after_batch_id")
    )
