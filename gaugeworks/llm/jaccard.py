"""Near-duplicate links by n-gram Jaccard similarity, as a grouped prefix join.

A document is the set of its distinct word shingles. Documents with equal sets are one node.
Shingles are put into one global order (frequent ones last, the rest by name); two sets that are
similar enough must share a shingle among their first few in that order, the prefix. Nodes with
the same prefix and size form one group, and only groups are matched by prefix shingle.

Matching never lists all pairs of a busy shingle: first every node is compared with one likely
partner, its group's head or the central node of a bucket; connected nodes then form components,
and of each bucket only pairs from different components are expanded to members, where the
places of shared shingles allow a link at all. Those pairs are counted by shared prefix shingles,
which bounds the overlap, and survivors are verified on the whole sets. All links between different components are found, so the components are exact.

Names of shingles have 63 bits and nodes 128 bits; the method is exact but for equal names of
different shingles within one verified pair.

Defined cases: null text and text without words give an empty set, linked with nothing; a text
with fewer words than a shingle is one shingle; repeated rows are separate members of one node; a
null id is kept and never becomes a component id unless all members have none; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.llm.graph import components
from gaugeworks.llm.hashing import Words, mix, powers, slices, window_names
from gaugeworks.session import forget, in_rounds, settle

WIDTH, SIMILARITY = 5, Fraction(4, 5)
# Shingles in more than this share of a chunk's documents, and two at least, are candidates for the
# end of the order; so many documents must hold them in all.
FREQUENT_SHARE, FREQUENT_HOLDERS = 0.0001, 8
CHUNK_NAMES = 1 << 22
# The list is an ordering hint of fixed size, not a filter: results do not depend on it.
# Heads that share a shingle are a crowd from so many on, and then meet so many of them.
CROWD, CROWD_CENTRES = 32, 8
MAX_FREQUENT = 1 << 18
# The second comparison works off so many meetings of components for each row of theirs at a time.
MEETINGS_PER_ROW = 4


@dataclass(frozen=True)
class Likeness:
    """What a Jaccard similarity of at least ``least`` means for sizes, prefixes and overlaps."""

    least: Fraction

    def prefix(self, n: int) -> int:
        """Shingles of a set of n of which a similar set must hold one."""
        return n + 1 - -(-self.least.numerator * n // self.least.denominator)

    def beyond(self, n: Column) -> Column:
        """Shingles of a set that are not in its prefix."""
        return F.ceil(self.least.numerator * n / self.least.denominator) - 1

    def band(self, n: Column) -> Column:
        """Sizes in one band may be similar; partners are at most one band apart."""
        return F.floor(F.log(n.cast("double")) / -math.log(self.least)).cast("int")

    def sizes_fit(self, n_a: Column, n_b: Column) -> Column:
        return self.least.numerator * F.greatest(n_a, n_b) <= self.least.denominator * F.least(
            n_a, n_b
        )

    def reached(self, overlap: Column | int, sizes: Column | int) -> Column | bool:
        """An overlap is enough for two sets whose sizes add up to ``sizes``."""
        both = self.least.numerator + self.least.denominator
        return both * overlap >= self.least.numerator * sizes


_LAST = np.uint64(1 << 63)
_SIGN = np.uint64(1 << 63)


def _raw_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle names (63 bits) of each text."""
    words = Words(column, lower=True)
    names = window_names(words.name, width) >> np.uint64(1)
    out = []
    for k, count in enumerate(words.counts):
        first = words.first[k]
        if count >= width:
            out.append(np.unique(names[first : first + count - width + 1]))
        elif count:
            few = words.name[first : first + count]
            whole = mix(np.array([(few * powers(int(count))).sum() + np.uint64(count)], np.uint64))
            out.append(whole >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _node(names: np.ndarray) -> bytes:
    one, two = mix(names).sum(dtype=np.uint64), mix(names ^ np.uint64(0x5BD1E995AA)).sum(dtype=np.uint64)
    return struct.pack(">QQ", int(one), int(two))


def _prefix(names: np.ndarray, frequent: np.ndarray, count: int) -> np.ndarray:
    """The first names in the global order: frequent ones carry the top bit and come last."""
    if not len(frequent):
        return names[:count]
    for part in (names[: 2 * count], names):  # mostly, twice as many hold enough that are not frequent
        at = np.minimum(np.searchsorted(frequent, part), len(frequent) - 1)
        late = frequent[at] == part
        if len(part) - late.sum() >= count:
            break
    return np.concatenate([part[~late], part[late] | _LAST])[:count]


# Parities of 256 residues, as columns that the pair join can compare.
MARKS = [f"mark{k}" for k in range(4)]


def _marks(names: np.ndarray) -> np.ndarray:
    odd = np.bincount((names & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _parity(names: np.ndarray) -> bytes:
    """A bit per residue of the names: whether an odd number of them has it.

    The modulus is a power of two, at least twice their number.
    """
    residues = max(64, 1 << (2 * len(names) - 1).bit_length()) if len(names) else 64
    odd = np.bincount((names & np.uint64(residues - 1)).astype(np.int64), minlength=residues) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart(one: np.ndarray, two: np.ndarray) -> int:
    """Names that only one of two sets holds, at least, by the parities of both."""
    while len(one) != len(two):
        one, two = (one, two) if len(one) > len(two) else (two, one)
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    return int(np.bitwise_count(one ^ two).sum())


def _signed(names: np.ndarray) -> np.ndarray:
    """As BIGINT values that compare like the unsigned names."""
    return (names ^ _SIGN).view(np.int64)


def frequent_shingles(texts: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Shingles that many documents hold, at most ``MAX_FREQUENT``, sorted by name.

    Each chunk of about CHUNK_NAMES shingles reports what several of its different documents hold:
    also passages and texts with copies in one of thousands of documents, as the pairs that meet
    at them would grow with the square of the corpus. In prefixes, what a document shares with few
    comes first, so two that are not alike show it there.
    """

    def common(sets):
        names, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        many = counts >= max(2, math.ceil(FREQUENT_SHARE * len(sets)))
        return pa.RecordBatch.from_arrays(
            [pa.array(names[many].view(np.int64)), pa.array(counts[many])], names=["name", "docs"]
        )

    def report(batches):
        sets, held = {}, 0
        for batch in slices(batches, "text"):
            new = {_node(s): s for s in _raw_sets(batch.column("text"), width) if len(s)}
            held += sum(len(s) for node, s in new.items() if node not in sets)
            sets |= new
            if held >= CHUNK_NAMES:
                yield common(sets)
                sets, held = {}, 0
        if sets:
            yield common(sets)

    top = (
        texts.select("text")
        .mapInArrow(report, "name bigint, docs bigint")
        .groupBy("name")
        .agg(F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= FREQUENT_HOLDERS)
        .orderBy(F.desc("docs"), "name")
        .limit(MAX_FREQUENT)
    )
    return np.sort(top.select("name").toArrow()["name"].to_numpy().view(np.uint64))


def shingled(
    texts: DataFrame, frequent: np.ndarray, likeness: Likeness, width: int = WIDTH
) -> DataFrame:
    """Per row: doc_id, n, node, group (of prefix and size), last, parity and the prefix itself."""

    def describe(batches):
        for batch in slices(batches, "text"):
            sizes, nodes, groups, lasts, prefixes, parities = [], [], [], [], [], []
            marks = []
            for names in _raw_sets(batch.column("text"), width):
                n = len(names)
                sizes.append(n)
                nodes.append(_node(names))
                parities.append(_parity(names))
                marks.append(_marks(names))
                prefix = _prefix(names, frequent, likeness.prefix(n)) if n else names
                prefix = _signed(prefix)
                prefixes.append(prefix)
                groups.append(_node(np.append(prefix.view(np.uint64), np.uint64(n))))
                lasts.append(int(prefix[-1]) if n else None)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, prefixes)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array(groups, pa.binary()),
                    pa.array(lasts, pa.int64()),
                    pa.array(parities, pa.binary()),
                    *(pa.array(np.stack(marks)[:, k]) for k in range(len(MARKS))),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                names=["doc_id", "n", "node", "grp", "last", "parity", *MARKS, "prefix"],
            )

    return texts.mapInArrow(
        describe,
        "doc_id bigint, n bigint, node binary, grp binary, last bigint, parity binary, "
        + "".join(f"{mark} bigint, " for mark in MARKS)
        + "prefix array<bigint>",
    )


def _verified(
    texts: DataFrame, nodes: DataFrame, pairs: DataFrame, likeness: Likeness, width: int
) -> DataFrame:
    """The pairs (a, b) of node numbers whose whole sets are similar enough.

    Parities, which are short, tell most pairs that are not. Whole sets travel once per pair, so
    the others are compared in rounds of about half as many as there are nodes, which move each
    set once on average; parities in rounds of four pairs a node.
    """
    count = max(nodes.count(), 1)

    def sift(batches):
        for batch in batches:
            keep = []
            sizes = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()).tolist()
            for one, two, both in zip(batch.column("parity_a"), batch.column("parity_b"), sizes):
                x = np.frombuffer(one.as_buffer(), np.uint8)
                y = np.frombuffer(two.as_buffer(), np.uint8)
                keep.append(likeness.reached((both - _apart(x, y)) // 2, both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def sifted(some):
        for side in "ab":
            some = some.join(
                nodes.select(
                    F.col("nid").alias(side),
                    F.col("n").alias(f"n_{side}"),
                    F.col("parity").alias(f"parity_{side}"),
                ),
                side,
            )
        columns = "a", "b", "n_a", "n_b", "parity_a", "parity_b"
        return settle(some.select(*columns).mapInArrow(sift, "a bigint, b bigint"), "pairs")

    listed = settle(pairs.select("a", "b"), "listed")
    pairs = in_rounds(listed, "a", -(-listed.count() // (4 * count)), sifted)
    forget(listed)
    rounds = -(-2 * pairs.count() // count)
    wanted = pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).distinct()
    named = nodes.join(wanted, "nid", "left_semi").select(
        "nid", "node", F.col("doc_id").alias("rep_id")
    )

    def whole(batches):
        for batch in slices(batches, "text"):
            sets = _raw_sets(batch.column("text"), width)
            numbers, nodes_of = batch.column("nid").to_pylist(), batch.column("node").to_pylist()
            kept = [
                (number, s.tobytes())
                for number, node, s in zip(numbers, nodes_of, sets)
                if _node(s) == node
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in kept], pa.int64()),
                    pa.array([s for _, s in kept], pa.binary()),
                ],
                names=["nid", "names"],
            )

    sets = texts.join(named, texts["doc_id"].eqNullSafe(named["rep_id"])).select(
        "nid", "node", "text"
    )
    stored = settle(sets.mapInArrow(whole, "nid bigint, names binary"), "sets")

    def compare(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("names_a"), batch.column("names_b")):
                x = np.frombuffer(one.as_buffer(), np.uint64)
                y = np.frombuffer(two.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(likeness.reached(both, len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    if stored.groupBy("nid").count().filter("count > 1").isEmpty():
        sets = stored
    else:  # rows of equal id and text give a node's set several times
        sets = settle(stored.dropDuplicates(["nid"]), "sets")
        forget(stored)
    left = sets.select(F.col("nid").alias("a"), F.col("names").alias("names_a"))
    right = sets.select(F.col("nid").alias("b"), F.col("names").alias("names_b"))

    def compared(some):
        joined = some.join(left, "a").join(right, "b").select("a", "b", "names_a", "names_b")
        return settle(joined.mapInArrow(compare, "a bigint, b bigint"), "verified")

    links = in_rounds(pairs, "a", rounds, compared)
    forget(sets, pairs)
    return links


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    similarity: Fraction = SIMILARITY,
) -> DataFrame:
    """doc_id, n_shingles and component_id, the least id reachable over links, of every row.

    Two documents link if the Jaccard similarity of their shingles of ``width`` words is at
    least ``similarity``, a fraction between 0 and 1, both excluded.
    """
    likeness = Likeness(similarity)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = settle(shingled(texts, frequent_shingles(texts, width), likeness, width), "shingled")

    # Nodes, one per distinct set, numbered, with a row to fetch the text from.
    nodes = settle(
        rows.filter(F.col("n") > 0)
        .groupBy("node", "n", "grp", "last", "parity", *MARKS)
        .agg(F.min("doc_id").alias("doc_id"))
        .withColumn("nid", F.monotonically_increasing_id()),
        "nodes",
    )
    groups = nodes.groupBy("grp").agg(
        F.min(F.struct("nid", "node", "n")).alias("head"), F.count(F.lit(1)).alias("members")
    )
    heads = settle(
        groups.select("grp", "members", "head.nid", "head.node", "head.n").withColumnRenamed(
            "nid", "gid"
        ),
        "heads",
    )

    # Prefix shingles of group heads that more than one node holds.
    tokens = (
        rows.select("node", "prefix")
        .join(heads.select("node", "gid", "members"), "node")
        .dropDuplicates(["node"])
        .select("gid", "members", F.posexplode("prefix").alias("pos", "token"))
    )
    tokens = settle(tokens, "tokens")
    # Prefixes are most of the table and not used again.
    members = settle(rows.select("doc_id", "n", "node"), "members")
    forget(rows)
    shared = (
        tokens.groupBy("token").agg(F.sum("members").alias("holders")).filter(F.col("holders") > 1)
    )
    buckets = settle(
        tokens.select("token", "gid", "pos").join(shared.select("token"), "token"), "buckets"
    )
    forget(tokens)
    sizes = heads.select("gid", "n", likeness.band(F.col("n")).alias("band"))
    placed = settle(buckets.join(sizes, "gid"), "placed")
    forget(buckets)

    # First comparison. Members meet the head of their group; heads meet the set that holds one
    # of their shingles earliest, which of all holders has fewest shingles of its own.
    within = nodes.join(heads.filter("members > 1").select("grp", "gid"), "grp").select(
        F.col("gid").alias("a"), F.col("nid").alias("b")
    )
    centres = placed.groupBy("token", "band").agg(F.min(F.struct("pos", "gid", "n")).alias("c"))
    reached = centres.select(
        "token",
        F.col("c.gid").alias("a"),
        F.col("c.n").alias("n_a"),
        F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"),
    )
    likely = (
        placed.join(reached, ["token", "band"])
        .filter((F.col("a") != F.col("gid")) & likeness.sizes_fit(F.col("n_a"), F.col("n")))
        .groupBy("a", F.col("gid").alias("b"), "n_a", "n")
        .agg(F.count(F.lit(1)).alias("common"))
        .filter(
            likeness.reached(
                F.col("common")
                + F.greatest(likeness.beyond(F.col("n_a")), likeness.beyond(F.col("n"))),
                F.col("n_a") + F.col("n"),
            )
        )
        .groupBy("b")
        .agg(F.max(F.struct("common", "a")).alias("best"))
        .select(F.col("best.a").alias("a"), "b")
    )
    likely = settle(likely, "likely")
    # Where many heads share a shingle, most are alike, but not each to the one it met. They also
    # meet a few others, the same ones for all shingles of a group, so that few components are
    # left for the second comparison.
    few = [F.min(F.struct(F.xxhash64("gid", F.lit(k)), "gid", "n")) for k in range(CROWD_CENTRES)]
    crowds = (
        placed.groupBy("token", "band")
        .agg(F.count(F.lit(1)).alias("holders"), F.array(*few).alias("few"))
        .filter(F.col("holders") >= CROWD)
        .select("token", "band", F.explode(F.array_distinct("few.gid")).alias("a"))
    )
    crowded = (
        placed.join(crowds, ["token", "band"])
        .filter(F.col("a") != F.col("gid"))
        .select("a", F.col("gid").alias("b"))
    )
    crowded = settle(crowded.distinct(), "crowded")
    star = within.filter(F.col("a") != F.col("b")).union(likely).union(crowded).distinct()
    links = _verified(texts, nodes, star, likeness, width)
    forget(likely, crowded)
    roots = components(links)
    found = roots.withColumnRenamed("node", "nid")
    rooted = settle(
        nodes.join(found, "nid", "left").select(
            "nid", "n", "grp", "last", *MARKS, F.coalesce("root", "nid").alias("root")
        ),
        "rooted",
    )
    forget(roots)

    # Second comparison: pairs of different components only, per token and size band. The first
    # shingle that two linked sets share stands early in both: ``early`` is how early any shared
    # shingle of a node stands, and of two linked nodes the smaller one has it in a short prefix.
    early = placed.groupBy("gid").agg(F.min("pos").alias("early"))
    sides = settle(
        rooted.join(heads.select("grp", "gid"), "grp")
        .join(early, "gid")
        .select("gid", "nid", "n", "last", "root", "early", *MARKS, likeness.band(F.col("n")).alias("band")),
        "sides",
    )
    forget(rooted, heads)
    mixed = placed.select("token", "gid", "pos").join(sides, "gid")
    short = mixed.filter(likeness.reached(F.col("n") - F.col("early"), 2 * F.col("n")))
    smaller = short.select(
        "token",
        *(F.col(c).alias(f"{c}_a") for c in ("nid", "n", "last", "root", "early", "pos", *MARKS, "band")),
    )
    larger = mixed.select(
        "token",
        "band",
        *(F.col(c).alias(f"{c}_b") for c in ("nid", "n", "last", "root", "early", "pos", *MARKS)),
    )
    kinds = settle(larger.select("token", "band", "root_b").distinct(), "kinds")
    sum_n = F.col("n_a") + F.col("n_b")
    # What two sets can share when one shingle stands at these places of both.
    behind = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    around = F.least("pos_a", "pos_b") + behind
    # What only one of them holds, at least: see ``_parity``.
    apart = reduce(add, (F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in MARKS))
    first_ends = F.col("last_a") <= F.col("last_b")

    def overlapping(some):
        meetings = settle(
            some.select("token", "root_a", "band_a")
            .distinct()
            .withColumn("band", F.explode(F.array("band_a", F.col("band_a") + 1)))
            .join(kinds, ["token", "band"])
            .filter(F.col("root_a") != F.col("root_b")),
            "meetings",
        )
        common = (
            meetings.join(some, ["token", "root_a", "band_a"])
            .join(larger, ["token", "root_b", "band"])
            .filter(
                likeness.sizes_fit(F.col("n_a"), F.col("n_b"))
                & (
                    (F.col("n_a") < F.col("n_b"))
                    | ((F.col("n_a") == F.col("n_b")) & (F.col("nid_a") < F.col("nid_b")))
                )
                & likeness.reached(F.col("n_a") - F.col("early_a"), sum_n)
                & likeness.reached(F.col("n_b") - F.col("early_b"), sum_n)
                & likeness.reached(around, sum_n)
                & likeness.reached((sum_n - apart) / 2, sum_n)
            )
            .select(
                F.col("nid_a").alias("a"),
                F.col("nid_b").alias("b"),
                sum_n.alias("sum_n"),
                F.when(first_ends, likeness.beyond(F.col("n_a")))
                .otherwise(likeness.beyond(F.col("n_b")))
                .alias("beyond"),
            )
            .groupBy("a", "b", "sum_n", "beyond")
            .agg(F.count(F.lit(1)).alias("common"))
        )
        # Whichever prefix ends first: all its shingles that the other set holds are in ``common``.
        enough = likeness.reached(F.col("common") + F.col("beyond"), F.col("sum_n"))
        possible = settle(common.filter(enough), "possible")
        forget(meetings)
        return possible

    # Roots that share a shingle and a band meet each other: where that is far more than there are
    # rows, roots are worked off in rounds.
    meets = kinds.groupBy("token", "band").count().agg(
        F.sum(F.col("count") * (F.col("count") - 1)), F.sum("count")
    )
    expected, there = (float(x or 0) for x in meets.first())
    rounds = math.ceil(expected / max(MEETINGS_PER_ROW * there, 1))
    possible = in_rounds(smaller, "root_a", rounds, overlapping)
    forget(placed, sides, kinds)
    more = _verified(texts, nodes, possible, likeness, width)
    forget(possible)
    roots = components(links.union(more))
    final = roots.withColumnRenamed("node", "nid")
    forget(links, more)

    labelled = nodes.select("node", "nid").join(final, "nid", "left")
    labelled = labelled.select("node", F.coalesce("root", "nid").alias("root"))
    keyed = members.join(labelled, "node", "left")
    least = (
        nodes.select("node", "doc_id")
        .join(labelled, "node")
        .groupBy("root")
        .agg(F.min("doc_id").alias("least"))
    )
    result = keyed.join(least, "root", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    result = settle(result, "components")
    forget(members, nodes, roots)
    return result
