"""Word boundaries and 64-bit names, computed over whole batches of UTF-8 text with numpy.

Names depend on content alone, so every task gives equal pieces of text the same name without a
shared dictionary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

_BYTE_NAMES = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(names: np.ndarray) -> np.ndarray:
    """Scramble 64-bit names so that all bits depend on all bits."""
    x = names.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(count: int) -> np.ndarray:
    """Odd multipliers of the positional hash."""
    return np.cumprod(np.full(max(count, 1), _STEP, dtype=np.uint64))


def slices(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``SLICE_BYTES`` of the text column each; a long text stays whole."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end


def joined(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a slice as one byte array, a newline after each, and each text's start."""
    texts = [b"" if v is None else v for v in pc.cast(column, pa.binary()).to_pylist()]
    data = b"\n".join([*texts, b""])
    if lower:
        data = data.lower()  # ASCII letters only, as bytes know no others
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)], dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8), starts


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts.

    ``start``/``end`` are byte positions in ``data``; ``first[d]:first[d + 1]`` are the words of
    text ``d``; ``name`` holds a 64-bit name of each word's bytes.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.text_start = joined(column, lower)
        inside = np.zeros(len(self.data) + 2, dtype=np.int8)
        inside[1:-1] = ~_WHITE[self.data]
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.text_start)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.name = self._names()

    def _names(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        sizes = self.end - self.start
        # Position within the word, for the bytes that belong to words only.
        offsets = np.cumsum(sizes) - sizes
        where = np.arange(int(sizes.sum()), dtype=np.int64)
        at = where - np.repeat(offsets, sizes)
        bytes_in = self.data[at + np.repeat(self.start, sizes)]
        terms = _BYTE_NAMES[bytes_in] * powers(int(sizes.max()))[at]
        return mix(np.add.reduceat(terms, offsets) + sizes.astype(np.uint64))


def window_names(names: np.ndarray, width: int) -> np.ndarray:
    """A name for each run of ``width`` consecutive names (fewer results than names)."""
    count = len(names) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for k, power in enumerate(powers(width)):
        total += names[k : k + count] * power
    return mix(total)
