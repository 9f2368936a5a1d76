"""Importance resampling of documents towards a target text, by hashed word n-gram features.

Words are runs of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII. A feature is a
run of 1 to ``max_n`` consecutive words of one document, joined by a space; its bucket is the
CRC-32 of its bytes modulo ``buckets``. Two passes read the texts:

1. Feature counts per bucket, of the target and of all documents, are summed per task and then
   by Spark: at most ``buckets`` numbers each. They give every bucket an integer gain.
2. Each document's weight is the floored mean gain of its features. A Gumbel draw that
   follows from the document's id and the seed is added, and the highest scores are drawn.

Texts of a slice are joined into one byte string with a sentinel between documents: a byte that no
UTF-8 text holds and that is matched as a word of its own. One pass of a regular expression finds
all words; a binary search of word numbers in the sentinels' gives each word its
document; n-grams that would cross a sentinel are masked before the buckets are counted. Each
different word of a slice is hashed once, and n-grams continue the hash of their first words.

Ranks come from one range sort of (score, id) pairs without texts: the order of a range and the
sizes of the ranges before it, so no task sees more than one range, however many scores are equal.

Defined cases: a null or empty text has no features and weight 0; documents with fewer than
``min_words`` words have a score and no rank; equal scores go to the smaller id, null ids last;
rows with a null id draw as the text ``null``; repeated rows are rows of their own, each
ranked; an empty target or table of documents counts as zeros; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeworks.llm.hashing import slices
from gaugeworks.operators.scans import exclusive_prefix
from gaugeworks.session import settle

BUCKETS = 10_000
MAX_N = 1
MIN_WORDS = 20
SEED = 2024
DRAW_PERCENT = 10
RANGE_ROWS = 1 << 20
_POSITION_BITS = 33  # of monotonically_increasing_id

_SENTINEL = b"\xff"
_TOKENS = re.compile(rb"[0-9a-z\x80-\xf7]+|\xff")


class SliceFeatures:
    """Hashed n-gram features of the texts of one slice.

    ``bucket`` and ``doc`` say, feature by feature, its bucket and the text it belongs to;
    ``words`` and ``features`` are counts per text.
    """

    def __init__(self, column: pa.Array, max_n: int, buckets: int):
        texts = [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
        count = len(texts)
        # A sentinel behind each text. Bytes lower-case ASCII letters only.
        tokens = _TOKENS.findall(_SENTINEL.join([*texts, b""]).lower())
        numbers: dict[bytes, int] = {}
        coded = np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.int64, len(tokens))
        known = list(numbers)
        crc = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))[coded]
        ends = np.flatnonzero(coded == numbers.get(_SENTINEL, -1))
        self.words = np.diff(ends, prepend=-1) - 1
        doc = np.searchsorted(ends, np.arange(len(tokens)))
        place = np.arange(len(tokens)) - np.concatenate([[0], ends[:-1] + 1])[doc]
        left = self.words[doc] - place  # words from here to the end of the text, 0 on a sentinel
        found, owners = [], []
        hashed = crc.astype(np.uint32)
        for n in range(1, max_n + 1):
            starts = np.flatnonzero(left >= n)  # n-grams that cross no sentinel
            if n > 1:
                hashed = self._longer(hashed, starts, coded, known, n)
            found.append(hashed[starts] % np.uint32(buckets))
            owners.append(doc[starts])
        self.bucket = np.concatenate(found).astype(np.int64)
        self.doc = np.concatenate(owners)
        self.features = np.bincount(self.doc, minlength=count)

    @staticmethod
    def _longer(hashed, starts, coded, known, n) -> np.ndarray:
        """Hashes of the runs of ``n`` words at ``starts``, from those of one word less."""
        pairs = np.stack([hashed[starts].astype(np.int64), coded[starts + n - 1]], axis=1)
        different, which = np.unique(pairs, axis=0, return_inverse=True)
        crc = [zlib.crc32(b" " + known[word], before) for before, word in different.tolist()]
        longer = np.zeros_like(hashed)
        longer[starts] = np.array(crc, np.uint32)[which.reshape(-1)] if len(crc) else 0
        return longer


def bucket_counts(texts: DataFrame, text_col: str, max_n: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts: counted per task, then summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, "text"):
            features = SliceFeatures(part.column("text"), max_n, buckets)
            total += np.bincount(features.bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = (
        texts.select(F.col(text_col).alias("text"))
        .mapInArrow(count, "bucket bigint, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most ``buckets`` rows
    )
    totals = np.zeros(buckets, np.int64)
    for bucket, n in counted:
        totals[bucket] = n
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Integer gain of each bucket: 1000 times the log ratio of its smoothed shares."""
    smooth = len(source)
    above = (target + 1.0) * (float(source.sum()) + smooth)
    below = (source + 1.0) * (float(target.sum()) + smooth)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def gumbel(id_col: str, seed: int) -> Column:
    """An integer Gumbel draw that follows from the row's id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    digits = F.substring(F.sha2(name.cast("binary"), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def score_documents(
    docs: DataFrame,
    bucket_gains: np.ndarray,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_n: int = MAX_N,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    buckets = len(bucket_gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = SliceFeatures(part.column("text"), max_n, buckets)
            # Whole numbers far below 2**53, hence exact in the doubles that bincount sums in.
            sums = np.bincount(found.doc, weights=bucket_gains[found.bucket], minlength=part.num_rows)
            weight = sums.astype(np.int64) // np.maximum(found.features, 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *map(pa.array, (found.words, found.features, weight))],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
        .mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
        .withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    )


def with_rank(rows: DataFrame, count: int, *order: Column) -> DataFrame:
    """Add ``rank`` = 1, 2, 3, ... of ``count`` rows in the given order, by one range sort."""
    ranges = max(1, -(-count // RANGE_ROWS))
    row = F.monotonically_increasing_id()
    sorted_rows = settle(
        rows.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("range", F.shiftright(row, _POSITION_BITS))
        .withColumn("place", row.bitwiseAND((1 << _POSITION_BITS) - 1)),
        "ranges",
    )
    sizes = settle(sorted_rows.groupBy("range").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    before = exclusive_prefix(sizes, "range", "rows").select("range", "before")
    ranked = sorted_rows.join(before, "range")
    return ranked.withColumn("rank", F.col("before") + F.col("place") + 1).drop("range", "place", "before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    max_n: int = MAX_N,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    percent: int = DRAW_PERCENT,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document."""
    source = bucket_counts(docs, text_col, max_n, buckets)
    wanted = bucket_counts(target, target_col, max_n, buckets)
    scored = settle(
        score_documents(docs, gains(source, wanted), id_col, text_col, max_n, seed), "scored"
    )
    eligible = scored.filter(F.col("n_words") >= min_words)
    count = eligible.count()
    ranked = with_rank(eligible, count, F.desc("score"), F.asc_nulls_last("doc_id"))
    drawn = F.when(F.col("rank") <= count * percent // 100, F.col("rank"))
    rest = scored.filter(F.col("n_words") < min_words)
    columns = ("doc_id", "n_features", "weight", "score")
    return ranked.select(*columns, drawn.alias("rank")).unionByName(
        rest.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    )
