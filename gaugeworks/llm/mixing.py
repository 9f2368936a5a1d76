"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

The van der Corput points 0, 1/2, 1/4, 3/4, ... are mapped through the cumulative target weights:
each point is a slot of ``block`` words that belongs to the source whose interval it falls into,
so every stretch of the schedule holds the sources in nearly their target shares. The documents of
a source, in a shuffled (hashed) order, form one stream of words; the slots of the source, ranked,
take the equal blocks of that stream one after another, starting over at its end. The last slot
of a source is shortened, or one closing slot added, so that the source gives exactly its rounded
target; as targets stop at ``max_repeat`` times the source, no document is taken more often.

Defined cases: null text and text without words have size 0 and are never taken; a null source
is a source of its own, ordered last; repeated rows are separate documents; a null id is kept;
an empty table gives no rows; columns other than the three named ones are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeworks.session import settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SLOTS = 1 << 20
CELLS = 4096
ROWS_PER_CHUNK_BITS = 14
SLOT_CHUNK_BITS = 12


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def sized_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per document: id, source, a null-free source key and the number of words."""
    source = F.col(source_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        source.alias("source"),
        F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("skey"),
        word_count(F.col(text_col)).alias("size"),
    ).withColumn("shuffled", F.xxhash64("doc_id", "skey", "size"))


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """Per source: its words, weight, target and interval [low, high) of the unit range.

    With sources ordered by the level at which each is full, the water level is the largest of
    what the unfilled rest would get per weight. One row per source, so the windows are small.
    """
    sizes = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    everything = Window.partitionBy(F.lit(0))
    weighted = sizes.withColumn(
        "weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ).withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "skey").rowsBetween(
        Window.unboundedPreceding, -1
    )
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0.0)
    )
    leveled = weighted.withColumn("level", F.max(rest / rest_weight).over(everything))
    leveled = leveled.withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
    so_far = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("target").over(so_far), F.lit(0.0)) / F.greatest(
        F.sum("target").over(everything), F.lit(1.0)
    )
    return (
        leveled.withColumn("low", low)
        .withColumn("high", F.coalesce(F.lead("low").over(Window.orderBy("skey")), F.lit(2.0)))
        .withColumn("quota", F.least(F.round("target"), F.col("cap")).cast("bigint"))
        .select("skey", "source", "source_size", "weight", "target", "quota", "low", "high")
    )


def schedule(targets: DataFrame, slots: int, block: int) -> DataFrame:
    """The schedule: per slot its source and the words [first, last) of the source's stream.

    ``rank`` numbers the slots of a source. Slots are ranked within chunks of neighbouring slots
    whose offsets come from per-chunk counts, so a heavy source is spread over tasks.
    """
    spark = targets.sparkSession
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), 32, "0")), 2, 10).cast("double") / 2.0**32
    points = (
        spark.range(slots)
        .withColumnRenamed("id", "slot")
        .withColumn("point", point)
        .withColumn("cell", F.floor(F.col("point") * CELLS))
    )
    # Source intervals by grid cell: at most CELLS rows more than there are sources.
    last_cell = F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))
    intervals = (
        targets.filter(F.col("quota") > 0)
        .withColumn("first_cell", F.least(F.floor(F.col("low") * CELLS), F.lit(CELLS - 1)))
        .withColumn("cell", F.explode(F.sequence("first_cell", F.greatest("first_cell", last_cell))))
        .select("skey", "quota", "low", "high", "cell")
    )
    owned = (
        points.join(intervals, "cell")
        .filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
        .select("slot", "skey", "quota", F.shiftright("slot", SLOT_CHUNK_BITS).alias("part"))
    )
    parts = owned.groupBy("skey", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "skey", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("skey", "part").orderBy("slot")
    ranked = (
        owned.withColumn("at", F.row_number().over(within) - 1)
        .join(offsets, ["skey", "part"])
        .withColumn("rank", F.col("offset") + F.col("at"))
        .withColumn("first", F.col("rank") * block)
        .filter(F.col("first") < F.col("quota"))
        .select("slot", "skey", "rank", "first", F.least(F.col("first") + block, "quota").alias("last"))
    )
    given = parts.groupBy("skey").agg(F.sum("n").alias("rank"))
    closing = (
        targets.filter(F.col("quota") > 0)
        .join(given, "skey", "left")
        .withColumn("rank", F.coalesce("rank", F.lit(0)))
        .withColumn("first", F.col("rank") * block)
        .filter(F.col("first") < F.col("quota"))
        .select(F.lit(None).cast("bigint").alias("slot"), "skey", "rank", "first", F.col("quota").alias("last"))
    )
    return ranked.unionByName(closing)


def streams(sized: DataFrame) -> DataFrame:
    """Adds ``start``: the document's place, in words, in the shuffled stream of its source.

    The hashed order is cut into chunks, as many as the rows need, whose sums give the offsets.
    """
    bits = max(6, math.ceil(math.log2(max(sized.count(), 1))) - ROWS_PER_CHUNK_BITS)
    chunked = sized.withColumn("chunk", F.shiftright("shuffled", 64 - bits))
    sums = chunked.groupBy("skey", "chunk").agg(F.sum("size").alias("words"))
    before = (Window.unboundedPreceding, -1)
    by_chunk = Window.partitionBy("skey").orderBy("chunk").rowsBetween(*before)
    offsets = sums.select(
        "skey", "chunk", F.coalesce(F.sum("words").over(by_chunk), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("skey", "chunk").orderBy("shuffled", "doc_id").rowsBetween(*before)
    return (
        chunked.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, ["skey", "chunk"])
        .withColumn("start", F.col("offset") + F.col("inner"))
        .select("doc_id", "source", "skey", "size", "start")
    )


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    slots: int = SLOTS,
) -> DataFrame:
    """Per document: size, source_size, target and taken, the words the mix takes of it.

    Texts are read once, for their word counts; everything after works on rows of a few numbers,
    which are written to the shared folder. ``slots`` bounds the length of the schedule; the
    block is the total of all words over it, rounded up.
    """
    sized = settle(sized_documents(docs, id_col, text_col, source_col), "sized")
    total = sized.agg(F.sum("size")).first()[0] or 0
    block = max(1, math.ceil(total / slots))
    targets = settle(source_targets(sized, weights, max_repeat), "targets")
    plan = schedule(targets, math.ceil(total / block), block)
    placed = streams(sized)

    # The words of a slot lie in one pass over the stream, or in a few if the stream is short.
    passes = F.sequence(
        F.floor(F.col("first") / F.col("source_size")),
        F.floor((F.col("last") - 1) / F.col("source_size")),
    )
    segments = (
        plan.join(targets.select("skey", "source_size"), "skey")
        .withColumn("pass", F.explode(passes))
        .withColumn("from", F.greatest(F.col("first") - F.col("pass") * F.col("source_size"), F.lit(0)))
        .withColumn("to", F.least(F.col("last") - F.col("pass") * F.col("source_size"), "source_size"))
        .withColumn("cell", F.explode(F.sequence(*_cells("from", "to", block))))
        .select("skey", "cell", "from", "to")
    )
    covered = (
        placed.filter(F.col("size") > 0)
        .withColumn("end", F.col("start") + F.col("size"))
        .withColumn("cell", F.explode(F.sequence(*_cells("start", "end", block))))
        .select("skey", "cell", "start", "end")
    )
    overlap = F.least("to", "end", (F.col("cell") + 1) * block) - F.greatest(
        "from", "start", F.col("cell") * block
    )
    taken = (
        covered.join(segments, ["skey", "cell"])
        .withColumn("words", overlap)
        .filter(F.col("words") > 0)
        .groupBy("skey", "start")
        .agg(F.sum("words").alias("taken"))
        .withColumn("some", F.lit(True))
    )
    return (
        placed.withColumn("some", F.col("size") > 0)
        .join(taken, ["skey", "start", "some"], "left")
        .join(targets.select("skey", "source_size", "target"), "skey")
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        )
    )


def _cells(first: str, end: str, block: int) -> tuple[Column, Column]:
    return (
        F.floor(F.col(first) / block).cast("bigint"),
        F.floor((F.col(end) - 1) / block).cast("bigint"),
    )
