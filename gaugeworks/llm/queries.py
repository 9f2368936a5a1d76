"""The operators of this subpackage applied to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.llm.attribution import section_tokens
from gaugeworks.llm.byte_bpe import decode_ids, encode_texts
from gaugeworks.llm.clustering import cluster
from gaugeworks.llm.extraction import extract_pages
from gaugeworks.llm.fingerprints import fingerprint_versions
from gaugeworks.llm.jaccard import near_duplicates
from gaugeworks.llm.licenses import scan_licenses
from gaugeworks.llm.mixing import mix_documents
from gaugeworks.llm.nearest import top_k
from gaugeworks.llm.oracles import ORACLES  # noqa: F401  (handed on with the queries)
from gaugeworks.llm.packing import pack_documents
from gaugeworks.llm.quality import fit, score_documents
from gaugeworks.llm.resampling import resample
from gaugeworks.llm.shipping import ship_package
from gaugeworks.llm.substrings import remove_repeats


WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs, width=3, similarity=Fraction(9, 10))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = (BYTE_VOCABULARY, public_tokenizers.PATTERN)
    encoded = encode_texts(table(spark, sf_dir, "documents"), *vocabulary)
    return decode_ids(encoded, *vocabulary).select(
        "doc_id",
        F.expr("bigint(length(ids) div 4)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_quality,
        op2_token_counts,
        op3_substring_dedup,
        op4_html_extraction,
        op5_fingerprints,
        op6_license_scan,
        op7_topk_search,
        op8_packing,
        op9_jaccard_join,
        op10_mix_sources,
        op11_resampling,
        op12_clustering,
        op13_byte_bpe,
    )
}
