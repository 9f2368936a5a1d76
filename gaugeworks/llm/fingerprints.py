"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, cut into pieces of at most ``PIECE_WORDS`` words, so that texts of one
line have parts too; a piece that repeats within a text counts once per occurrence. Each digest goes
to one cell in each of three parts of a table; a cell keeps the number of its digests, their
sum and the sum of their checks. Subtracting two sketches cancels what both texts hold, and
peeling cells that hold one digest recovers the differing digests. Likeness is the Jaccard
similarity that follows.

A sketch is as large as its own text needs to be peeled: the least power of two of cells per part
that does, which is tried when it is made and follows from the text alone. Sizes nest, as a
large table folds onto a smaller one. So any two sketches can be compared without their texts: the
larger is folded and both are subtracted. Where that cannot be peeled, as the texts differ by more than
the smaller one holds, both are peeled by themselves and their digests are sketched larger, again and
again, until the difference peels.

Defined cases: a null text is the empty text; two empty texts have likeness 1; equal ids are
ordered by text and a null id comes after all others; repeated rows follow each other; rows of equal
id, null ids among them, are handled by one task, piece by piece; a table of one row is followed by
itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeworks.llm.hashing import Words, mix, powers, slices

PIECE_WORDS = 8
PARTS = 3
# Neighbouring ids are handled in groups of about this many documents; at most MAX_GROUPS bounds
# reach the driver.
GROUP_DOCS = 1500
MAX_GROUPS = 100_000

_CHECK = np.uint64(0xC2B2AE3D27D4EB4F)
_OCCURRENCE = np.uint64(0x165667B19E3779F9)
_CELL = np.dtype([("count", "<i4"), ("sum", "<u8"), ("check", "<u8")])


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Piece digests of each text: (digest, text), texts ascending."""
    words = Words(pa.array(texts, pa.string()))
    if not len(words.name):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lines = np.cumsum(words.data == 10)[words.start]
    begins = np.ones(len(words.name), bool)
    begins[1:] = (lines[1:] != lines[:-1]) | (words.text[1:] != words.text[:-1])
    first = np.flatnonzero(begins)
    place = np.arange(len(words.name)) - np.repeat(first, np.diff(np.append(first, len(begins))))
    place %= PIECE_WORDS
    pieces = np.flatnonzero(place == 0)
    names = mix(np.add.reduceat(words.name * powers(PIECE_WORDS)[place], pieces))
    owner = words.text[pieces]
    # The k-th occurrence of a piece in a text has a digest of its own.
    order = np.lexsort((names, owner))
    same = np.zeros(len(names), bool)
    same[1:] = (names[order][1:] == names[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    runs = np.flatnonzero(~same)
    times = np.arange(len(names)) - np.repeat(runs, np.diff(np.append(runs, len(names))))
    names[order] = mix(names[order] + times.astype(np.uint64) * _OCCURRENCE)
    return names, owner


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ _CHECK)


class Sketches:
    """The tables of many texts, laid end to end; ``size[d]`` cells in each part of table ``d``."""

    def __init__(self, size: np.ndarray, seed: int = 0):
        self.size, self.seed = size.astype(np.int64), seed
        cells = self.size * PARTS
        self.base = np.cumsum(cells) - cells
        total = int(cells.sum())
        self.home = np.repeat(np.arange(len(cells)), cells)
        self.count = np.zeros(total, np.int64)
        self.sum = np.zeros(total, np.uint64)
        self.check = np.zeros(total, np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int) -> None:
        """Insert (sign 1) or remove (sign -1) digests."""
        signs = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        times = signs.astype(np.uint64)  # -1 wraps around, as the sums do
        size, sums, checks = self.size[owner], keys * times, _check(keys) * times
        for k in range(PARTS):
            hashed = mix(keys + np.uint64(1 + k + PARTS * self.seed)).astype(np.int64)
            at = self.base[owner] + k * size + (hashed & (size - 1))
            np.add.at(self.count, at, signs)
            np.add.at(self.sum, at, sums)
            np.add.at(self.check, at, checks)

    def chosen(self, tables: np.ndarray) -> Sketches:
        """Some of the tables, as sketches of their own."""
        out = Sketches(self.size[tables], self.seed)
        at = np.arange(len(out.count)) + (self.base[tables] - out.base)[out.home]
        out.count, out.sum, out.check = self.count[at], self.sum[at], self.check[at]
        return out

    def folded(self, size: np.ndarray) -> Sketches:
        """The same digests in tables of at most the same size."""
        out = Sketches(size, self.seed)
        own, less = self.size[self.home], out.size[self.home]
        part, cell = np.divmod(np.arange(len(self.count)) - self.base[self.home], own)
        at = out.base[self.home] + part * less + (cell & (less - 1))
        np.add.at(out.count, at, self.count)
        np.add.at(out.sum, at, self.sum)
        np.add.at(out.check, at, self.check)
        return out

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.size, self.seed)
        out.count, out.sum = self.count - other.count, self.sum - other.sum
        out.check = self.check - other.check
        return out

    def held(self) -> np.ndarray:
        """How many digests each table holds."""
        part = (np.arange(len(self.count)) - self.base[self.home]) // self.size[self.home]
        return np.bincount(self.home, np.where(part == 0, self.count, 0), len(self.size)).astype(np.int64)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Empty the tables as far as possible: (digest, owner, sign) of what was found."""
        found = []
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at]
            keys = self.sum[at] * sign.astype(np.uint64)
            pure = _check(keys) * sign.astype(np.uint64) == self.check[at]
            keys, owner, sign = keys[pure], self.home[at[pure]], sign[pure]
            if not len(keys):
                break
            order = np.lexsort((keys, owner))
            keys, owner, sign = keys[order], owner[order], sign[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            keys, owner, sign = keys[new], owner[new], sign[new]
            self.add(keys, owner, -sign)
            found.append((keys, owner, sign))
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def emptied(self) -> np.ndarray:
        """Which tables hold nothing any more."""
        left = (self.count != 0) | (self.sum != 0) | (self.check != 0)
        return np.bincount(self.home[left], minlength=len(self.size)) == 0

    def texts(self) -> list[str]:
        """Each table as a string."""
        table = np.zeros(len(self.count), _CELL)
        table["count"], table["sum"], table["check"] = self.count, self.sum, self.check
        data, item = table.tobytes(), _CELL.itemsize
        return [
            base64.b64encode(data[b * item : (b + PARTS * m) * item]).decode()
            for b, m in zip(self.base.tolist(), self.size.tolist())
        ]

    @classmethod
    def of_texts(cls, prints: list[str]) -> Sketches:
        """Tables from their strings."""
        tables = [np.frombuffer(base64.b64decode(t), _CELL) for t in prints]
        out = cls(np.array([len(t) // PARTS for t in tables], np.int64))
        whole = np.concatenate([*tables, np.zeros(0, _CELL)])
        out.count, out.sum, out.check = (
            whole["count"].astype(np.int64), whole["sum"].astype(np.uint64), whole["check"].astype(np.uint64)
        )
        return out


def sketched(keys: np.ndarray, owner: np.ndarray, tables: int) -> Sketches:
    """The sketch of each set of digests, at the least size at which it can be peeled."""
    held = np.bincount(owner, minlength=tables)
    # Two cells per part for four digests: somewhat more than peeling needs in large tables.
    size = 1 << np.ceil(np.log2(np.maximum(held / 2, 1))).astype(np.int64)
    todo = np.arange(tables)
    while len(todo):
        number = np.full(tables, -1)
        number[todo] = np.arange(len(todo))
        mine = number[owner] >= 0
        trial = Sketches(size[todo])
        trial.add(keys[mine], number[owner[mine]], 1)
        trial.peel()
        todo = todo[~trial.emptied()]
        size[todo] *= 2
    out = Sketches(size)
    out.add(keys, owner, 1)
    return out


def differences(one: Sketches, two: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All digests that the tables of each pair do not share: (digest, pair, sign).

    The sign is 1 for those of the first table and -1 for those of the second.
    """
    least = np.minimum(one.size, two.size)
    rest = one.folded(least).minus(two.folded(least))
    keys, pair, sign = rest.peel()
    done = rest.emptied()
    found = [(keys[done[pair]], pair[done[pair]], sign[done[pair]])]
    todo = np.flatnonzero(~done)
    if not len(todo):
        return found[0]
    # Their own digests, from which larger sketches are made.
    parts = []
    for side, sketches in ((1, one), (-1, two)):
        alone = sketches.chosen(todo)
        keys, pair, _ = alone.peel()
        if not alone.emptied().all():
            raise ValueError("a sketch is too small for its own text")
        parts.append((keys, pair, np.full(len(keys), side)))
    keys, pair, sign = (np.concatenate(x) for x in zip(*parts))
    size, left, seed = 2 * np.maximum(one.size, two.size)[todo], np.arange(len(todo)), 0
    while len(left):
        seed += 1
        number = np.full(len(todo), -1)
        number[left] = np.arange(len(left))
        mine = number[pair] >= 0
        larger = Sketches(size[left], seed)
        larger.add(keys[mine], number[pair[mine]], sign[mine])
        got, at, which = larger.peel()
        done = larger.emptied()
        found.append((got[done[at]], todo[left[at[done[at]]]], which[done[at]]))
        left = left[~done]
        size[left] *= 2
    return tuple(np.concatenate(x) for x in zip(*found))


def likeness(one: Sketches, two: Sketches) -> np.ndarray:
    """Jaccard similarity of the digest sets behind each pair of tables."""
    pairs = len(one.size)
    _, pair, sign = differences(one, two)
    only_one = np.bincount(pair[sign > 0], minlength=pairs)
    only_two = np.bincount(pair[sign < 0], minlength=pairs)
    held = one.held()
    union = held + only_two
    return np.where(union > 0, (held - only_one) / np.maximum(union, 1), 1.0)


def fingerprints(texts: list[str]) -> list[str]:
    """The sketch of each text, as a string."""
    return sketched(*digests(texts), len(texts)).texts()


def differing(one: str, two: str) -> tuple[set[int], set[int]]:
    """Digests only in the first and only in the second text, from their fingerprints alone."""
    keys, _, sign = differences(Sketches.of_texts([one]), Sketches.of_texts([two]))
    return set(keys[sign > 0].tolist()), set(keys[sign < 0].tolist())


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _describe(doc_ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all texts but the last, each followed by the next."""
    edited = [
        own[: len(own) - len(own) // 3] + following[: len(own) // 3]
        for own, following in zip(texts, texts[1:])
    ]
    count = len(edited)
    every = sketched(*digests(texts), len(texts))
    own, after = every.chosen(np.arange(count)), every.chosen(np.arange(1, count + 1))
    changed = sketched(*digests(edited), count)
    near_edited, near_next = likeness(own, changed), likeness(own, after)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids[:count], pa.int64()),
            pa.array([len(t) for t in texts[:count]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(own.texts()),
            pa.array(changed.texts()),
            pa.array(near_edited),
            pa.array(near_next),
        ],
        names=[part.split()[0] for part in SCHEMA.split(", ")],
    )


def fingerprint_versions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprints of every text and its edited version, and how alike they are.

    The edited version ends with the start of the next document in descending id order. Ids are
    cut into ranges at quantiles; each range is one sorted group, and the first document of
    the range below is sent along. The texts are shuffled once.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    keys = rows.select("key")
    groups = min(MAX_GROUPS, max(1, math.ceil(keys.count() / GROUP_DOCS)))
    shares = [k / groups for k in range(1, groups)]
    cuts = keys.approxQuantile("key", shares, 0.2 / groups) if shares else []
    bounds = np.unique(np.array([max(-(2**63), min(2**63 - 1, int(c))) for c in cuts], np.int64))

    @F.arrow_udf("int")
    def group_of(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, key.to_numpy(), "right").astype(np.int32))

    tops = sorted(
        (r["grp"], r["top"])
        for r in keys.select(group_of("key").alias("grp"), "key")
        .groupBy("grp")
        .agg(F.max("key").alias("top"))
        .collect()
    )
    # The top document of a range follows the last one of the range above; above all is the lowest.
    above = {top: tops[(n + 1) % len(tops)][0] for n, (_, top) in enumerate(tops)}

    @F.arrow_udf("array<struct<grp: int, guest: boolean>>")
    def homes(key: pa.Array) -> pa.Array:
        values = key.to_numpy()
        out = []
        for own, value in zip(np.searchsorted(bounds, values, "right").tolist(), values.tolist()):
            out.append([(own, False), (above[value], True)] if value in above else [(own, False)])
        kind = pa.list_(pa.struct([("grp", pa.int32()), ("guest", pa.bool_())]))
        return pa.array([[dict(zip(("grp", "guest"), h)) for h in hs] for hs in out], kind)

    def walk(batches):
        ids, texts, group = [], [], None
        for batch in slices(batches, "text"):
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "grp", "guest"))
            for doc_id, text, grp, guest in zip(*columns):
                if grp != group:
                    ids, texts, group, ended = [], [], grp, False
                if ended:
                    continue  # further guests of equal id
                ids.append(doc_id)
                texts.append(text)
                if guest:
                    ended = True
                    if len(texts) > 1:
                        yield _describe(ids, texts)
            if len(texts) > 1 and not ended:
                yield _describe(ids, texts)
                ids, texts = ids[-1:], texts[-1:]

    placed = rows.withColumn("home", F.explode(homes("key"))).select(
        "doc_id", "key", "text", "home.grp", "home.guest"
    )
    order = ["grp", "guest", F.desc("key"), "text"]
    gathered = placed.repartition("grp").sortWithinPartitions(*order)
    return gathered.select("doc_id", "text", "grp", "guest").mapInArrow(walk, SCHEMA)
