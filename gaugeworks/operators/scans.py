"""Running folds and dense numbering over a whole ordered table.

A window without ``partitionBy`` would put the table into one task. Here the order column (a
unique BIGINT) is cut into groups of neighbouring values by dropping low bits, groups into groups
of groups, and so on. Each window then sees at most ``2**GROUP_BITS`` rows whatever the data looks
like, because a group cannot hold more distinct keys than its key range, and only small
per-group folds travel between levels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeworks.session import settle

ROW_GROUP_BITS = 14
GROUP_BITS = 17

# fold name -> (aggregate, merge of two partial results that may be null)
_FOLDS: dict[str, tuple[Callable[..., Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
}


def exclusive_prefix(points: DataFrame, key: str, value: str, fold: str = "sum") -> DataFrame:
    """Fold of ``value`` over all rows before each row in ``key`` order.

    ``points`` has unique non-null BIGINT keys. Returns ``key``, ``value``, ``before`` and
    ``overall`` (the fold of the whole table). ``before`` is null (0 for sums) on the first row.
    The points are written out first, unless they are a table that ``settle`` returned; as many
    levels follow as their key range needs.
    """
    written = hasattr(points, "settled_path")
    settled = points if written else settle(points.select(key, value), "points")
    low, high = settled.agg(F.min(key), F.max(key)).first()
    levels = 0
    while low is not None and (high >> GROUP_BITS * levels) - (low >> GROUP_BITS * levels) >= (
        1 << GROUP_BITS
    ):
        levels += 1
    return _prefix(settled, key, value, fold, levels)


def _prefix(points: DataFrame, key: str, value: str, fold: str, levels: int) -> DataFrame:
    aggregate, merge = _FOLDS[fold]
    earlier = (Window.unboundedPreceding, -1)
    if levels == 0:
        before = aggregate(value).over(Window.orderBy(key).rowsBetween(*earlier))
        return points.select(
            key,
            value,
            merge(before, F.lit(None)).alias("before"),
            aggregate(value).over(Window.partitionBy(F.lit(0))).alias("overall"),
        )
    group = f"{key}_up"
    grouped = points.select(key, value, F.shiftright(key, GROUP_BITS).alias(group))
    folds = grouped.groupBy(group).agg(aggregate(value).alias(value))
    parents = _prefix(folds, group, value, fold, levels - 1).select(
        group, F.col("before").alias("above"), "overall"
    )
    inner = Window.partitionBy(group).orderBy(key).rowsBetween(*earlier)
    return (
        grouped.withColumn("inner", aggregate(value).over(inner))
        .join(parents, group)
        .select(key, value, merge(F.col("inner"), F.col("above")).alias("before"), "overall")
    )


def number_rows(rows: DataFrame, order_col: str) -> DataFrame:
    """Add ``n`` (0, 1, 2, ... in ``order_col`` order) and ``total`` (the row count).

    ``order_col`` is a unique non-null BIGINT; a null or a repeated value ends the job with an
    error, as there is no order to number by. Rows are shuffled once, by group of neighbouring
    order values; the join with the group offsets reuses that shuffle.
    """
    no_key = F.raise_error(F.lit(f"a row to number has no {order_col}"))
    grouped = rows.withColumn(
        "row_group",
        F.when(F.col(order_col).isNull(), no_key).otherwise(
            F.shiftright(order_col, ROW_GROUP_BITS)
        ),
    )
    counts = grouped.groupBy("row_group").agg(F.count(F.lit(1)).alias("rows_in_group"))
    offsets = exclusive_prefix(counts, "row_group", "rows_in_group").select(
        "row_group", "before", F.col("overall").alias("total")
    )
    within = Window.partitionBy("row_group").orderBy(order_col)
    twice = F.lag(order_col).over(within) == F.col(order_col)
    again = F.raise_error(F.concat(F.lit(f"two rows to number have {order_col} "), F.col(order_col)))
    return (
        grouped.withColumn(
            "rank_in_group", F.when(twice, again).otherwise(F.row_number().over(within))
        )
        .join(offsets, "row_group")
        .withColumn("n", F.col("before") + F.col("rank_in_group") - 1)
        .drop("row_group", "rank_in_group", "before")
    )
