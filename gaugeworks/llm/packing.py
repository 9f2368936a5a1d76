"""Packing documents into training sequences by lexical retrieval.

Documents are encoded once and put in order of a name of the token pair that has the least hash of all
their pairs, so that texts sharing wording tend to be neighbours whatever their lengths; the ordered table is cut into range partitions and
these into shards of about ``SHARD_TOKENS`` ids. Each shard holds a BM25 inverted index over its
documents' ids. A seed document opens a window, the unused documents that score best for all the
seed's ids follow greedily, and the one that crosses the window's end is cut there and becomes
the next seed. Every window is therefore full; only what is left at the end of a partition is shorter,
and it goes to sequences of power-of-two lengths, which need no padding.

BM25 weights use the document count, document frequencies and mean length of all documents, counted
in one pass beforehand, so a weight does not depend on the shard; every document is indexed with all
its ids. Only the search itself is limited to the seed's shard.

Defined cases: null and empty texts are the end id alone; repeated rows are packed each; a null id
is kept; long documents run over as many sequences as they need; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gaugeworks.llm.hashing import mix, slices
from gaugeworks.llm.tokens import END_ID, word_encoder
from gaugeworks.session import settle

WINDOW = 4096
SHARD_TOKENS = 1 << 19
PARTITION_TOKENS = 1 << 22
K1, B = 1.2, 0.75
SEQUENCE_BITS = 40

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def routes(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The routing name of each text, whose ids (with the end id) end at ``ends``."""
    found = ids.astype(np.uint64)
    pairs = mix(found << np.uint64(16) | np.append(found[1:], 0).astype(np.uint64))
    starts = np.concatenate([[0], ends[:-1]])
    pairs[ends - 1] = np.uint64(2**64 - 1)  # the last id of a text has no partner
    least = np.minimum.reduceat(pairs, starts) if len(ends) else pairs
    # The least name alone would be smaller the longer the text; mixed again it is not.
    return (mix(least) >> np.uint64(1)).astype(np.int64)


def encoded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids (16-bit, with the end id), their number and the routing name of each row."""

    def encode(batches):
        encoder = word_encoder(vocabulary)
        for batch in slices(batches, "text"):
            ids, first = encoder.encode_column(batch.column("text"))
            sizes = np.diff(first) + 1
            whole = np.insert(ids, first[1:], END_ID)  # the end id behind each text
            ends = np.cumsum(sizes)
            data = pa.py_buffer(whole.astype("<u2").tobytes())
            offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
            coded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), data])
            columns = [batch.column("doc_id"), coded, pa.array(sizes), pa.array(routes(whole, ends))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "tokens", "route"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(encode, "doc_id bigint, ids binary, tokens bigint, route bigint")


@dataclass(frozen=True)
class Statistics:
    """Number of documents, their mean length without the end id, and the holders of each id."""

    count: int
    mean: float
    holders: np.ndarray


class HolderCount:
    """How many documents hold each id."""

    def __init__(self):
        self.holders = np.zeros(1 << 16, dtype=np.int64)
        self._place = np.zeros(1 << 16, dtype=np.int64)

    def add(self, ids: np.ndarray) -> None:
        places = np.arange(len(ids))
        self._place[ids] = places
        self.holders[ids[self._place[ids] == places]] += 1  # one place of each id is left


def _count_holders(batches):
    counted = HolderCount()
    for batch in batches:
        for column in batch.column("ids"):
            counted.add(np.frombuffer(column.as_buffer(), "<u2")[:-1])
    terms = np.flatnonzero(counted.holders)
    yield pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.int64()), pa.array(counted.holders[terms], pa.int64())],
        names=["term", "holders"],
    )


def corpus_statistics(stored: DataFrame) -> tuple[Statistics, int]:
    """The statistics of all encoded documents, and the number of their ids with the end ids."""
    count, total = stored.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    found = (
        stored.select("ids")
        .mapInArrow(_count_holders, "term bigint, holders bigint")
        .groupBy("term")
        .agg(F.sum("holders").alias("holders"))
    )
    holders = np.zeros(1 << 16, dtype=np.int64)
    for row in found.collect():  # at most one row for each id of the vocabulary
        holders[row.term] = row.holders
    return Statistics(count, (total - count) / max(1, count), holders), total


class ShardIndex:
    """A BM25 inverted index over the ids of one shard's documents.

    Without the statistics of the corpus, the shard is taken as all of it.
    """

    def __init__(self, docs: list[np.ndarray], corpus: Statistics | None = None):
        # The end id is in every document and says nothing.
        sizes = np.array([len(d) - 1 for d in docs], dtype=np.int64)
        flat = np.concatenate([d[:-1] for d in docs]).astype(np.int64)
        owner = np.repeat(np.arange(len(docs), dtype=np.int64), sizes)
        keys, counts = np.unique(flat * len(docs) + owner, return_counts=True)
        self.term, self.doc = np.divmod(keys, len(docs))
        self.first = np.searchsorted(self.term, np.arange((1 << 16) + 1))
        corpus = corpus or Statistics(len(docs), sizes.mean(), np.diff(self.first))
        self.idf = np.log(1 + (corpus.count - corpus.holders + 0.5) / (corpus.holders + 0.5))
        length = sizes / max(1.0, corpus.mean)
        norm = K1 * (1 - B + B * length)[self.doc]
        self.weight = self.idf[self.term] * counts * (K1 + 1) / (counts + norm)
        self.count = len(docs)

    def neighbours(self, ids: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Unused documents by falling score for all ids of a seed, positive scores only."""
        terms = np.flatnonzero(np.bincount(ids))
        if not len(terms):
            return np.zeros(0, np.int64)
        starts = self.first[terms]
        sizes = self.first[terms + 1] - starts
        shifts = starts - (np.cumsum(sizes) - sizes)
        places = np.arange(int(sizes.sum())) + np.repeat(shifts, sizes)
        scores = np.bincount(self.doc[places], self.weight[places], self.count)
        scores[used] = 0
        found = np.flatnonzero(scores > 0)
        return found[np.argsort(-scores[found], kind="stable")]


def retrieval_order(
    docs: list[np.ndarray], filled: int = 0, corpus: Statistics | None = None
) -> list[int]:
    """The order in which a shard's documents are laid end to end, ``filled`` ids into a window."""
    index = ShardIndex(docs, corpus)
    used = np.zeros(len(docs), dtype=bool)
    order, following, at = [], 0, filled
    seed = None
    while len(order) < len(docs):
        if seed is None:
            while used[following]:
                following += 1
            seed = following
            used[seed] = True
            order.append(seed)
            at += len(docs[seed])
        room = WINDOW - at % WINDOW
        next_seed = None
        for k in index.neighbours(docs[seed][:-1], used):
            used[k] = True
            order.append(int(k))
            at += len(docs[k])
            room -= len(docs[k])
            if room <= 0:
                next_seed = int(k)
                break
        seed = next_seed
    return order


class SequenceWriter:
    """Cuts a stream of documents into full windows and, at its end, power-of-two rests."""

    def __init__(self, base: int):
        self.sequence = base
        self.held: list[tuple[int | None, int, np.ndarray, int]] = []
        self.room = WINDOW
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            part = ids[start : start + self.room]
            self.held.append((doc_id, start, part, len(ids)))
            start += len(part)
            self.room -= len(part)
            if not self.room:
                self._flush(WINDOW)

    def close(self) -> None:
        left = WINDOW - self.room
        for bit in reversed(range(WINDOW.bit_length())):
            if left & (1 << bit):
                self._flush(1 << bit)

    def _flush(self, size: int) -> None:
        offset = 0
        while offset < size:
            doc_id, start, ids, tokens = self.held.pop(0)
            part = ids[: size - offset]
            if len(part) < len(ids):
                self.held.insert(0, (doc_id, start + len(part), ids[len(part) :], tokens))
            crc = zlib.crc32(part.astype("<u4").tobytes())
            self.rows.append((doc_id, start, len(part), crc, tokens, self.sequence, offset))
            offset += len(part)
        self.sequence += 1
        self.room = WINDOW

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 7
        self.rows = []
        names = [part.split()[0] for part in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _lay_out(batches, corpus: Statistics):
    """Pack one range partition: shard after shard, in the order of its rows."""
    writer = SequenceWriter(TaskContext.get().partitionId() << SEQUENCE_BITS)
    ids, docs, size = [], [], 0

    def finish():
        for k in retrieval_order(docs, WINDOW - writer.room, corpus):
            writer.add(ids[k], docs[k])
        return writer.take()

    for batch in batches:
        for doc_id, column in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
            ids.append(doc_id)
            docs.append(np.frombuffer(column.as_buffer(), "<u2"))
            size += len(docs[-1])
            if size >= SHARD_TOKENS:
                yield finish()
                ids, docs, size = [], [], 0
    if docs:
        yield finish()
    writer.close()
    yield writer.take()


def pack_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of a document: its place in the document and in its sequence.

    The encoded documents are written to the shared folder and shuffled once, by ranges of the
    routing name; the row number breaks ties, so any number of copies is spread evenly.
    """
    stored = settle(
        encoded(docs, vocabulary, id_col, text_col).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "encoded",
    )
    corpus, total = corpus_statistics(stored)
    parts = max(1, math.ceil(total / PARTITION_TOKENS))
    return (
        stored.repartitionByRange(parts, "route", "row")
        .sortWithinPartitions("route", "row")
        .select("doc_id", "ids")
        .mapInArrow(lambda batches: _lay_out(batches, corpus), PIECES)
    )
