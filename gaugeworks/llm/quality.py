"""Quality classifier: averaged subword embeddings with a softmax, trained by numpy SGD.

A document is the mean of the learned vectors of its hashed features: whole words and the
character 3- to 5-grams of each word with its boundaries. Features are case-sensitive, as case
is part of what quality means. The model is fitted in one task from at most ``MAX_SAMPLE``
labelled documents (those with the smallest hashed id, so any task finds the same ones) and only its
table reaches the driver; scoring then takes one table lookup per feature, as the mean of vectors times the softmax weights is the
mean of one number per bucket. Every whole text is scored.

Defined cases: null and empty texts get the score of the prior (the bias alone); labels with
null id or quality are ignored; several labels of one id are averaged and count as 1 from 0.5 up;
repeated rows are scored alike; without any usable label every score is 0.5; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

BUCKET_BITS = 17
DIM = 16
MAX_SAMPLE = 4000
EPOCHS = 6
RATE = 1.0
GRAMS = (3, 4, 5)
HELD_OUT_PART = 2
THRESHOLD = 0.7
SLICE_CHARS = 1 << 20

_MULTIPLIER = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)
_WHITE = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint32)


def _features(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Feature buckets of a list of texts.

    Returns pairs (position, bucket), one per kind of feature, positions ascending, and the
    border of each text: the positions of text ``d`` are in ``borders[d]:borders[d + 1]``.
    """
    body = "\n" + "".join(t + "\n" for t in texts)
    chars = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)], dtype=np.int64)
    white = np.isin(chars, _WHITE)
    chars[white] = 32
    code = (chars + np.uint32(1)) * _SPREAD
    code ^= code >> np.uint32(15)
    shift = np.uint32(32 - BUCKET_BITS)
    found = []
    # A gram may begin and end with the white space around its word but not contain any.
    whites = np.cumsum(white, dtype=np.int32)
    rolled = code
    for size in range(2, max(GRAMS) + 1):
        if len(code) < size:
            break
        rolled = rolled[: len(code) - size + 1] * _MULTIPLIER + code[size - 1 :]
        if size in GRAMS:
            inner = whites[size - 2 : len(code) - 1] - whites[: len(code) - size + 1]
            at = np.flatnonzero(inner == 0)
            salted = (rolled[at] ^ np.uint32(size)) * _SPREAD
            found.append((at, salted >> shift))
    edges = np.diff(white.astype(np.int8))
    start, end = np.flatnonzero(edges == -1) + 1, np.flatnonzero(edges == 1) + 1
    if len(start):
        sizes = end - start
        offsets = np.cumsum(sizes) - sizes
        inside = np.arange(int(sizes.sum())) - np.repeat(offsets, sizes)
        weights = np.cumprod(np.full(int(sizes.max()), _MULTIPLIER, dtype=np.uint32))
        terms = (code[inside + np.repeat(start, sizes)] * weights[inside]).astype(np.uint32)
        words = np.add.reduceat(terms, offsets, dtype=np.uint32)
        found.append((start - 1, ((words ^ (words >> np.uint32(13))) * _SPREAD) >> shift))
    return found, borders


@dataclass(frozen=True)
class QualityModel:
    """``table[b]`` is what a feature in bucket ``b`` adds to the mean; ``bias`` is the prior."""

    table: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text."""
        found, borders = _features(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for at, bucket in found:
            sums = np.concatenate([[0.0], np.cumsum(self.table[bucket], dtype=np.float64)])
            cut = np.searchsorted(at, borders)
            total += np.diff(sums[cut])
            count += np.diff(cut)
        logit = total / np.maximum(count, 1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -50, 50)))


FEATURES = "label int, buckets binary, counts binary"


def _count_features(batches):
    """Labelled texts as (distinct buckets, counts), the input of training."""
    for batch in batches:
        out = []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            found, _ = _features([text or ""])
            buckets = np.concatenate([b for _, b in found]) if found else np.zeros(0, np.uint32)
            ids, counts = np.unique(buckets, return_counts=True)
            out.append((label, ids.astype("<u4").tobytes(), counts.astype("<u4").tobytes()))
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], pa.int32()),
                pa.array(columns[1], pa.binary()),
                pa.array(columns[2], pa.binary()),
            ],
            names=["label", "buckets", "counts"],
        )


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 11) -> QualityModel:
    """Stochastic gradient descent over (label, buckets, counts), one document at a time."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((1 << BUCKET_BITS, DIM), np.float32) * 2 - 1) / DIM
    weights = np.zeros((DIM, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    steps, done = max(1, EPOCHS * len(samples)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(samples)):
            label, buckets, counts = samples[k]
            rate = RATE * (1 - done / steps)
            done += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            mean = share @ vectors[buckets]
            logits = mean @ weights + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[label] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= 0.05 * rate * error
            # Each feature moves by its share, scaled up as shares are small in long texts.
            vectors[buckets] -= rate * np.sqrt(share)[:, None] * back
    table = vectors @ (weights[:, 1] - weights[:, 0])
    return QualityModel(table.astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """The part of the ids that training never sees."""
    part = F.crc32(doc_id.cast("string").cast("binary")) % 4
    return F.coalesce(part == HELD_OUT_PART, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_sample: int = MAX_SAMPLE,
) -> QualityModel:
    """Fit on at most ``max_sample`` labelled documents outside the held-out part."""
    marked = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
        .dropna()
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    # Bounded by max_sample rows of two numbers, hence safe to broadcast.
    chosen = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = texts.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    features = sample.select("label", "text").mapInArrow(_count_features, FEATURES)
    # One task of its own trains; it holds max_sample rows, and the driver gets the finished table.
    row = features.repartition(1).mapInArrow(_train_in_task, "weights binary, bias double").first()
    return QualityModel(np.frombuffer(row.weights, "<f4"), row.bias)


def training_samples(batches) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Labelled features as arrays, in an order that does not depend on how rows arrive."""
    samples = []
    for batch in batches:
        for label, buckets, counts in zip(*(column.to_pylist() for column in batch.columns)):
            key = label, zlib.crc32(buckets), zlib.crc32(counts)
            counts = np.frombuffer(counts, "<u4")
            least = counts.astype(np.min_scalar_type(counts.max(initial=0)))
            samples.append((key, (label, np.frombuffer(buckets, "<u4"), least)))
    samples.sort(key=lambda s: s[0])
    return [s for _, s in samples]


def _train_in_task(batches):
    model = train(training_samples(batches))
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.table.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])],
        names=["weights", "bias"],
    )


def score_column(model: QualityModel, text: Column) -> Column:
    """The score of a text column, as an Arrow batch function."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        texts = pc.fill_null(column, "").to_pylist()
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        parts, start = [], 0
        while start < len(texts):
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + SLICE_CHARS, "right")))
            parts.append(model.scores(texts[start:end]))
            start = end
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(text)


def score_documents(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        score_column(model, F.col(text_col)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
