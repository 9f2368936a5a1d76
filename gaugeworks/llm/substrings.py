"""Removal of word windows that an earlier document already holds, by recompression.

Every document is parsed in rounds. A round first collapses each run of one token into a single
symbol and then joins neighbours (x, y) into one symbol, where a hash of the round puts x into the left and
y into the right half of the alphabet. A symbol's 64-bit name is computed from the names of its
parts, so it is the same in every task; equal stretches of text therefore get equal symbols
everywhere but near their ends. Whether a symbol of a window can depend on the text around the
window is tracked round by round; the highest symbol that cannot is the window's anchor.

Equal windows have equal anchors, hence only windows whose anchor occurs in two documents can
repeat. That is decided by one shuffle of anchors; a second shuffle verifies the windows
themselves by name, and the least document id holding a window decides which copies go. Names
travel packed by bucket of their high bits. Each slice of documents sends a name once, with its
least and greatest id, and further ids apart, so that a name that every document holds stays
small in the task that decides about it.

Repeats are judged by 64-bit names of windows whose anchors repeat; words are not compared. Among m
such windows about m^2 / 2^65 pairs of different ones share a name.

Defined cases: a null text has no words; a null id counts as larger than any other and
is returned as null; rows of one id never remove each other's words; repeated rows are treated
alike; an empty table gives no rows; other columns are handed through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gaugeworks.llm.hashing import Words, mix, slices, window_names
from gaugeworks.session import forget, settle

WIDTH = 13
ROUNDS = 8
BUCKET_BYTES = 8 << 20
LAST_ID = 2**63 - 1

_FIRST = np.uint64(0xD6E8FEB86659FD93)
_SECOND = np.uint64(0xA0761D6478BD642F)

PACKED = "bucket int, phase int, slice bigint, keys binary, low binary, high binary, at binary"
LISTS = "bucket int, ids binary, keys binary"


# --- parsing -----------------------------------------------------------------------------------


def _collapse(symbols, texts, first, end):
    """Runs of one symbol within a text become one; the certain range follows."""
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] != symbols[:-1]) | (texts[1:] != texts[:-1])
    at = np.cumsum(keep) - 1
    return symbols[keep], texts[keep], at[first], at[end - 1] + 1


def _join_pairs(symbols, texts, first, end, level):
    """One round of pair naming. Ranges [first, end) shrink by symbols that may join outwards."""
    salt = np.uint64(level * int(_FIRST) % 2**64)
    right = (mix(symbols + salt) & np.uint64(1)).astype(bool)
    pair = np.zeros(len(symbols), dtype=bool)
    pair[:-1] = ~right[:-1] & right[1:] & (texts[:-1] == texts[1:])
    starts = np.ones(len(symbols), dtype=bool)
    starts[1:] = ~pair[:-1]
    at = np.cumsum(starts) - 1
    joined = symbols.copy()
    where = np.flatnonzero(pair)
    joined[where] = mix(symbols[where] * _FIRST + symbols[where + 1] * _SECOND + np.uint64(level))
    # A right symbol at the start may belong to a pair with what stands before the range, and a
    # left symbol at the end to one with what follows; both are given up.
    inner = at[np.minimum(first + right[first], len(symbols) - 1)]
    outer = at[end - 1] + right[end - 1]
    inner = np.where(first + right[first] < end, inner, outer)
    return joined[starts], texts[starts], inner, outer


def anchors(words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a slice (their first words) and the name of each window's anchor."""
    count = len(words.name) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    windows = np.flatnonzero(words.text[:count] == words.text[width - 1 :])
    names = np.zeros(len(windows), dtype=np.uint64)
    open_ = np.arange(len(windows))
    symbols, texts = words.name, words.text
    symbols, texts, first, end = _collapse(symbols, texts, windows, windows + width)
    for level in range(1, ROUNDS + 1):
        if not len(open_):
            break
        next_symbols, next_texts, inner, outer = _join_pairs(symbols, texts, first, end, level)
        last = level == ROUNDS
        done = np.ones(len(open_), bool) if last else inner >= outer
        if done.any():
            low, high = first[done], end[done]
            best = symbols[low]
            for step in range(1, int((high - low).max())):
                other = symbols[np.minimum(low + step, high - 1)]
                best = np.minimum(best, other)
            names[open_[done]] = mix(best + np.uint64(level))
        go = ~done
        open_ = open_[go]
        if len(open_):
            symbols, texts, first, end = _collapse(next_symbols, next_texts, inner[go], outer[go])
    return windows, names


# --- packed exchange of names --------------------------------------------------------------------


def _pack(slice_no: int, keys: np.ndarray, ids: np.ndarray, bits: int) -> pa.RecordBatch:
    """Distinct (name, id) of a slice as rows per bucket; see the module text."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    begin = np.flatnonzero(fresh)
    stop = np.append(begin[1:], len(keys)) - 1
    low, high, unique = ids[begin], ids[stop], keys[begin]
    extra = np.zeros(len(keys), bool)
    extra[1:] = ~fresh[1:] & (ids[1:] != ids[:-1])
    group = np.cumsum(fresh) - 1
    extra_group, extra_ids = group[extra], ids[extra]
    bucket = (unique >> np.uint64(64 - bits)).astype(np.int32)
    present = np.unique(bucket)
    cut = np.append(np.searchsorted(bucket, present), len(bucket))
    extra_cut = np.searchsorted(extra_group, cut)
    rows = []
    for n, b in enumerate(present.tolist()):
        i, j, k, m = cut[n], cut[n + 1], extra_cut[n], extra_cut[n + 1]
        part = (unique[i:j].tobytes(), low[i:j].tobytes(), (high[i:j] - low[i:j]).tobytes())
        rows.append((b, 0, slice_no, *part, None))
        if k < m:
            at = (extra_group[k:m] - i).astype(np.uint32).tobytes()
            rows.append((b, 1, slice_no, None, extra_ids[k:m].tobytes(), None, at))
    columns = list(zip(*rows)) or [()] * 7
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    names = [part.split()[0] for part in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names
    )


class _Bucket:
    """What one bucket of names knows: per slice, its names and the least id over all slices."""

    def __init__(self):
        self.parts, self.slices = [], []
        self.least = None

    def add(self, slice_no: int, keys: bytes, low: bytes, spread: bytes) -> None:
        low_ids = np.frombuffer(low, np.int64)
        self.parts.append((np.frombuffer(keys, np.uint64), low_ids, low_ids + np.frombuffer(spread, np.int64)))
        self.slices.append(slice_no)

    def resolve(self, later_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest id per name; the (id, name) of the first ids that are to be told."""
        keys, low, high = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        begin = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
        sizes = np.diff(np.append(begin, len(keys)))
        least = np.empty(len(keys), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(low[order], begin), sizes)
        most = np.empty(len(keys), np.int64)
        most[order] = np.repeat(np.maximum.reduceat(high[order], begin), sizes)
        told = low > least if later_only else most > least
        ends = np.cumsum([len(p[0]) for p in self.parts])[:-1]
        self.least = dict(zip(self.slices, zip(np.split(least, ends), np.split(most, ends))))
        self.keys = {s: p[0] for s, p in zip(self.slices, self.parts)}
        return low[told], keys[told]

    def extras(self, slice_no: int, ids: bytes, at: bytes, later_only: bool):
        where = np.frombuffer(at, np.uint32)
        found = np.frombuffer(ids, np.int64)
        least, most = (x[where] for x in self.least[slice_no])
        told = found > least if later_only else most > least
        return found[told], self.keys[slice_no][where[told]]


def _lists(ids: np.ndarray, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(id, name) as rows per bucket of ids."""
    home = (ids % buckets).astype(np.int32)
    order = np.argsort(home, kind="stable")
    home, ids, keys = home[order], ids[order], keys[order]
    begin = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else []
    stops = [*begin[1:], len(home)] if len(home) else []
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(home[i]) for i in begin], pa.int32()),
            pa.array([ids[i:j].tobytes() for i, j in zip(begin, stops)], pa.binary()),
            pa.array([keys[i:j].tobytes() for i, j in zip(begin, stops)], pa.binary()),
        ],
        names=["bucket", "ids", "keys"],
    )


def repeated_names(packed: DataFrame, buckets: int, later_only: bool) -> DataFrame:
    """For names that several ids hold: which id holds which, as lists per bucket of ids.

    ``later_only`` leaves out the least id of each name.
    """

    def decide(batches):
        current, bucket, resolved = None, None, False

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal resolved
            if bucket is not None and not resolved:
                resolved = True
                yield _lists(*bucket.resolve(later_only), buckets)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for number, phase, slice_no, keys, low, spread, at in zip(*columns):
                if number != current:
                    yield from finish()
                    current, bucket, resolved = number, _Bucket(), False
                if phase == 0:
                    bucket.add(slice_no, keys, low, spread)
                else:
                    yield from finish()
                    yield _lists(*bucket.extras(slice_no, low, at, later_only), buckets)
        yield from finish()

    gathered = packed.repartition("bucket").sortWithinPartitions("bucket", "phase")
    return gathered.mapInArrow(decide, LISTS)


# --- documents with their lists -------------------------------------------------------------------


def _beside_lists(
    rows: DataFrame, lists: DataFrame, buckets: int, work: Callable, schema
) -> DataFrame:
    """Run ``work(serial, batch, ids, keys)`` on slices of rows with the listed names of their bucket.

    Rows and lists are shuffled once, by bucket of the id; the lists come first in each bucket.
    """
    empty = F.lit(None)
    kind = rows.schema["row"].dataType
    placed = rows.select(
        F.pmod("id", F.lit(buckets)).cast("int").alias("bucket"), F.lit(1).alias("phase"),
        "row", "id", "text", empty.cast("binary").alias("ids"), empty.cast("binary").alias("keys"),
    )
    listed = lists.select(
        "bucket", F.lit(0).alias("phase"), empty.cast(kind).alias("row"),
        empty.cast("bigint").alias("id"), empty.cast("string").alias("text"), "ids", "keys",
    )

    def run(batches):
        current, ids, keys, ready, count = None, [], [], None, 0
        for batch in slices(batches, "text"):
            numbers = batch.column("bucket").to_numpy()
            phases = batch.column("phase").to_numpy()
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(phases) != 0)) + 1
            for i, j in zip([0, *edges], [*edges, len(numbers)]):
                if numbers[i] != current:
                    current, ids, keys, ready = numbers[i], [], [], None
                part = batch.slice(i, j - i)
                if phases[i] == 0:
                    ids += [np.frombuffer(x, np.int64) for x in part.column("ids").to_pylist()]
                    keys += [np.frombuffer(x, np.uint64) for x in part.column("keys").to_pylist()]
                    continue
                if ready is None:
                    ready = (
                        np.concatenate(ids) if ids else np.zeros(0, np.int64),
                        np.concatenate(keys) if keys else np.zeros(0, np.uint64),
                    )
                    order = np.argsort(ready[0], kind="stable")
                    ready = (ready[0][order], ready[1][order])
                    ids, keys = [], []
                yield from work(_slice_number(count), part, *ready)
                count += 1

    together = placed.unionByName(listed).repartition("bucket").sortWithinPartitions("bucket", "phase")
    return together.mapInArrow(run, schema)


def _is_listed(names, texts, doc_ids, ids, keys) -> np.ndarray:
    """Which (text, name) of a slice are in its documents' lists."""
    starts = np.searchsorted(ids, doc_ids, "left")
    stops = np.searchsorted(ids, doc_ids, "right")
    sizes = stops - starts
    total = int(sizes.sum())
    if not total or not len(names):
        return np.zeros(len(names), bool)
    owner = np.repeat(np.arange(len(doc_ids)), sizes)
    at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    salt = mix(np.arange(len(doc_ids), dtype=np.uint64) * _FIRST)
    listed = np.unique(keys[at] ^ salt[owner])
    asked = names ^ salt[texts]
    where = np.minimum(np.searchsorted(listed, asked), len(listed) - 1)
    return listed[where] == asked


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    verbatim: bool = False,
) -> DataFrame:
    """Per row: ``row`` (its other columns), n_words, n_removed and kept, the words left.

    With ``verbatim`` the text of a row that loses nothing is kept as it is, white space and all.
    Three passes over the texts; between them only names travel.
    """
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("id"),
        F.col(text_col).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    buckets = (1 << bits) - 1

    def name_anchors(batches):
        for number, batch in enumerate(slices(batches, "text")):
            words = Words(batch.column("text"))
            windows, names = anchors(words, width)
            if not len(names):
                continue
            texts = words.text[windows]
            new = np.ones(len(names), bool)
            new[1:] = (names[1:] != names[:-1]) | (texts[1:] != texts[:-1])
            ids = batch.column("id").to_numpy()
            yield _pack(_slice_number(number), names[new], ids[texts[new]], bits)

    def name_windows(serial, batch, ids, keys):
        words = Words(batch.column("text"))
        windows, names = anchors(words, width)
        doc_ids = batch.column("id").to_numpy()
        chosen = windows[_is_listed(names, words.text[windows], doc_ids, ids, keys)]
        if len(chosen):
            whole = window_names(words.name, width)[chosen]
            yield _pack(serial, whole, doc_ids[words.text[chosen]], bits)

    def cut(serial, batch, ids, keys):
        words = Words(batch.column("text"))
        count = len(words.name) - width + 1
        gone = np.zeros(len(words.name) + 1, np.int64)
        if count > 0:
            windows = np.flatnonzero(words.text[:count] == words.text[width - 1 :])
            names = window_names(words.name, width)[windows]
            doc_ids = batch.column("id").to_numpy()
            starts = windows[_is_listed(names, words.text[windows], doc_ids, ids, keys)]
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + width, -1)
        gone = np.cumsum(gone)[:-1] > 0
        removed = np.diff(np.append(0, np.cumsum(gone))[words.first])
        data = words.data.tobytes()
        kept = []
        for k, count in enumerate(words.counts):
            i, j = words.first[k], words.first[k + 1]
            whole = data[words.text_start[k] : words.text_start[k + 1] - 1]
            if removed[k]:
                left = (w for w in range(i, j) if not gone[w])
                whole = b" ".join(data[words.start[w] : words.end[w]] for w in left)
            elif not verbatim:
                whole = b" ".join(whole.split())
            kept.append(whole.decode("utf-8"))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                pa.array(words.counts, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.string()),
            ],
            names=["row", "n_words", "n_removed", "kept"],
        )

    packed = rows.select("id", "text").mapInArrow(name_anchors, PACKED)
    shared = settle(repeated_names(packed, buckets, later_only=False), "anchors")
    slim = rows.select(F.struct("id").alias("row"), "id", "text")
    candidates = _beside_lists(slim, shared, buckets, name_windows, PACKED)
    repeats = settle(repeated_names(candidates, buckets, later_only=True), "windows")
    forget(shared)
    schema = StructType(
        [
            StructField("row", rows.schema["row"].dataType),
            StructField("n_words", LongType()),
            StructField("n_removed", LongType()),
            StructField("kept", StringType()),
        ]
    )
    return _beside_lists(rows, repeats, buckets, cut, schema)


def _slice_number(number: int) -> int:
    """A number for a slice that no other slice of the job has."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 32) + number
