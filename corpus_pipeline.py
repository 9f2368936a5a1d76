"""From raw documents to packed training sequences.

Five stages, each over all its predecessor kept: rejected documents go, one document of each
near-duplicate group stays, passages that an earlier document holds are cut out, sources are
mixed to their target weights, and what is left is packed. All but the last return the columns of
documents; a stage's input is what the stage before wrote.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeworks.llm.jaccard import near_duplicates
from gaugeworks.llm.mixing import mix_documents
from gaugeworks.llm.packing import pack_documents
from gaugeworks.llm.quality import THRESHOLD, fit, score_column
from gaugeworks.llm.shipping import ship_package
from gaugeworks.llm.substrings import remove_repeats
from gaugeworks.session import settle

# Training sequences and their order are not expressible in SQL; the tests hold every stage
# against a brute-force version.
ORACLE_SQL = None

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    ship_package(spark)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(score_column(model, F.col("text")) >= THRESHOLD)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates.

    Near duplicates share at least 0.8 of their shingles of five words, or are linked by such.
    Documents without words are in no group and stay. Rows of equal id are one document, of
    which one row stays unless their texts differ.
    """
    ship_package(spark)
    found = near_duplicates(docs)
    least = found.filter(
        F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("n_shingles") == 0)
    )
    kept = least.select(*_null_safe(F.col("doc_id"))).distinct()
    # Keyed as joined, the texts of equal ids are already together and are not shuffled again.
    chosen = docs.select("*", *_null_safe(docs["doc_id"])).join(kept, [*KEPT], "left_semi")
    return chosen.dropDuplicates([*KEPT, "text"]).drop(*KEPT)


KEPT = ("__kept_id", "__kept_null")


def _null_safe(doc_id: Column) -> list[Column]:
    """Two columns that are equal for equal ids, nulls included."""
    return [F.coalesce(doc_id, F.lit(0)).alias(KEPT[0]), doc_id.isNull().alias(KEPT[1])]


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages an earlier document holds; untouched texts stay as they are.

    A null text is given as the empty one.
    """
    ship_package(spark)
    cut = remove_repeats(docs, verbatim=True)
    lost = F.col("n_removed") > 0
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.length("kept")).otherwise(F.col("row.n_chars"))
    return cut.select(
        *((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns)
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: taken words over its size, rounded.

    Only the one document at which a source's share ends is taken in part. Documents without
    words are not taken.
    """
    ship_package(spark)
    mixed = settle(
        mix_documents(docs).select(
            F.col("doc_id").alias("mixed_id"),
            F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int"))
            .otherwise(0)
            .alias("times"),
        ),
        "mixed",
    )
    times = mixed.filter("times > 0").groupBy("mixed_id").agg(
        F.sequence(F.lit(1), F.max("times")).alias("each_time")
    )
    # Columns are named by their table, as documents may have any columns.
    return docs.join(times, docs["doc_id"].eqNullSafe(times["mixed_id"])).select(
        *(docs[c] for c in docs.columns), F.explode(times["each_time"]).alias("__mixed_time")
    ).drop("__mixed_time")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences, one row per piece of a document."""
    ship_package(spark)
    return pack_documents(docs, VOCABULARY)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
