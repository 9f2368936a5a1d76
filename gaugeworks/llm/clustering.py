"""Exact centroid clustering of integer vectors with heap-ordered bounds.

A vector is kept if it has the asked number of components, none null or non-finite; component x
becomes floor(1024 x). Each round assigns every vector to the nearest centroid (squared Euclidean
distance, equal ones to the smaller number) and replaces a non-empty centroid by the floored mean of
its vectors.

Vectors are packed into blocks. Per block and cluster a heap holds one entry per assigned vector:
the gap between a lower bound of its distance to all other centroids and an upper bound of that to
its own. When centroids move, the gaps of a cluster all shrink by the same amount, the drift of its
own centroid plus the greatest drift of another. So entries are not touched: the
drift so far is kept as an offset of the cluster, entries are stored with the offset they came
with, and only entries at the top that the offset has reached are popped. Their vectors are
compared with all centroids exactly and pushed again. All others provably stay where they are.

The blocks are shuffled once, into a bucketed table. The state of a round (assignments, heaps and
change of the sums) is a small table bucketed alike, so rounds join both without a shuffle; it is
written to the shared folder, read by the next round and then deleted. Only centroids and their
sums (``k`` times ``dims`` numbers) reach the driver.

All arithmetic on vectors is exact: in floating point where all values stay below 2**53, in 64-bit
integers, or in Python integers for very large components. Bounds are rounded to the safe side.

Defined cases: fewer vectors than ``k`` give as many clusters as there are vectors; equal hashes of
first centroids go by id and components; a null id hashes as the text ``null``; repeated rows are
vectors of their own; components beyond 2**60 count as 2**60, distances and sums beyond a long as
the largest long; no vectors give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gaugeworks.session import forget, scratch_path, settle

SCALE = 1024
DIMS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
BLOCK_ROWS = 4096
BUCKET_BLOCKS = 4
MAX_BUCKETS = 50_000  # below Spark's own limit
LARGEST = 2**60
MAX_LONG = 2**63 - 1
_SLACK = 1e-9  # far above the rounding of any bound
_LOW_BITS = 30

BLOCKS = "block bigint, ids array<bigint>, vectors binary"
STATE = "block bigint, assigned binary, heaps array<binary>, delta array<bigint>, popped bigint"
_ENTRY = np.dtype([("key", "<f8"), ("row", "<i4")])


# --- blocks ----------------------------------------------------------------------------------


def kept_vectors(batch: pa.RecordBatch, dims: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and quantized vectors of the rows of a batch that take part."""
    ids, column = batch.column(0), batch.column(1)
    long_enough = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    ids, column = ids.filter(long_enough), column.filter(long_enough)
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = values.reshape(-1, dims)  # a null is not a number here
    finite = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(x[finite] * SCALE)
    return ids.filter(pa.array(finite)), np.clip(scaled, -LARGEST, LARGEST).astype(np.int64)


def to_blocks(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """The vectors that take part, up to ``BLOCK_ROWS`` in a row, as 32-bit numbers if they fit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, x = kept_vectors(batch, dims)
            for start in range(0, len(x), BLOCK_ROWS):
                part = x[start : start + BLOCK_ROWS]
                narrow = np.abs(part).max() < 2**31
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]),
                        pa.array([ids[start : start + BLOCK_ROWS].to_pylist()], pa.list_(pa.int64())),
                        pa.array([part.astype("<i4" if narrow else "<i8").tobytes()], pa.binary()),
                    ],
                    names=["block", "ids", "vectors"],
                )
                number += 1

    chosen = vectors.select(F.col(id_col).cast("bigint"), F.col(vector_col).cast("array<double>"))
    return chosen.mapInArrow(run, BLOCKS)


def matrix(data: bytes, rows: int, dims: int) -> np.ndarray:
    kind = "<i4" if len(data) == 4 * rows * dims else "<i8"
    return np.frombuffer(data, kind).reshape(rows, dims).astype(np.int64)


def first_centroids(blocks: DataFrame, k: int, seed: int, dims: int) -> list[list[int]]:
    """The vectors of the ``k`` smallest hashes of their ids, chosen per task, then overall."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            for ids, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                named = ("null" if i is None else i for i in ids)
                hashes = [hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in named]
                x = matrix(data, len(ids), dims)
                rows = heapq.nsmallest(k, range(len(ids)), lambda r: (hashes[r], x[r].tolist()))
                best += [(hashes[r], x[r].tolist()) for r in rows]
            best = heapq.nsmallest(k, best)
        yield pa.RecordBatch.from_arrays(
            [pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.list_(pa.int64()))],
            names=["hash", "vector"],
        )

    found = blocks.select("ids", "vectors").mapInArrow(run, "hash string, vector array<bigint>")
    return [list(row.vector) for row in found.orderBy("hash", "vector").limit(k).collect()]


# --- one block -------------------------------------------------------------------------------


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids, as integers or whole doubles."""
    dims = x.shape[1]
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * dims * most**2 < 2**53:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    if 4 * dims * most**2 < 2**63:
        return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)
    big = x.astype(object)
    return np.stack([((big - c.astype(object)) ** 2).sum(1) for c in centroids], axis=1)


class Block:
    """Assignments and heaps of the vectors of one block."""

    def __init__(self, x: np.ndarray, clusters: int, assigned: bytes | None, heaps: list[bytes] | None):
        self.x = x
        self.clusters = clusters
        new = assigned is None
        self.assigned = np.full(len(x), -1, "<i4") if new else np.frombuffer(assigned, "<i4").copy()
        self.packed = [b""] * clusters if new else heaps
        self.loaded: dict[int, list[tuple[float, int]]] = {}
        self.new = new

    def heap(self, cluster: int) -> list[tuple[float, int]]:
        if cluster not in self.loaded:
            entries = np.frombuffer(self.packed[cluster], _ENTRY)
            self.loaded[cluster] = list(zip(entries["key"].tolist(), entries["row"].tolist()))
        return self.loaded[cluster]

    def expired(self, offsets: list[float]) -> np.ndarray:
        """Pop the rows whose gap the drift has used up."""
        if self.new:
            return np.arange(len(self.x))
        rows = []
        for cluster, offset in enumerate(offsets):
            top = np.frombuffer(self.packed[cluster][: _ENTRY.itemsize], _ENTRY)
            if len(top) and top["key"][0] <= offset:
                heap = self.heap(cluster)
                while heap and heap[0][0] <= offset:
                    rows.append(heapq.heappop(heap)[1])
        return np.array(rows, np.int64)

    def assign(self, centroids: np.ndarray, offsets: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Rescan what has expired; the rows and where they belonged before."""
        rows = self.expired(offsets)
        before = self.assigned[rows]
        if len(rows):
            found = squared_distances(self.x[rows], centroids)
            nearest = np.argmin(found, axis=1)  # the first of equal ones
            self.assigned[rows] = nearest
            own = np.sqrt(found[np.arange(len(rows)), nearest].astype(np.float64))
            if self.clusters > 1:
                second = np.sqrt(np.sort(found, axis=1)[:, 1].astype(np.float64))
            else:
                second = np.full(len(rows), np.inf)
            offset = np.array(offsets)[nearest]
            keys = second * (1 - _SLACK) - own * (1 + _SLACK) + offset * (1 - _SLACK) - _SLACK
            for cluster in np.unique(nearest).tolist():
                mine = nearest == cluster
                heap = self.heap(cluster)
                for entry in zip(keys[mine].tolist(), rows[mine].tolist()):
                    heapq.heappush(heap, entry)
        return rows, before

    def packed_heaps(self) -> list[bytes]:
        for cluster, heap in self.loaded.items():
            self.packed[cluster] = np.array(heap, _ENTRY).tobytes()
        return self.packed

    def change(self, rows: np.ndarray, before: np.ndarray) -> np.ndarray:
        """What the rows that moved add to each cluster: count, and sums in two parts.

        The parts, above and below ``_LOW_BITS`` bits, cannot overflow in one block.
        """
        moved = before != self.assigned[rows]
        rows, before = rows[moved], before[moved]
        x = self.x[rows]
        parts = np.concatenate(
            [np.ones((len(rows), 1), np.int64), x >> _LOW_BITS, x & ((1 << _LOW_BITS) - 1)], axis=1
        )
        total = np.zeros((self.clusters, parts.shape[1]), np.int64)
        np.add.at(total, self.assigned[rows], parts)
        came_from = before >= 0
        np.subtract.at(total, before[came_from], parts[came_from])
        return total.reshape(-1)


# --- rounds ----------------------------------------------------------------------------------


def _bucketed(frame: DataFrame, label: str, buckets: int) -> DataFrame:
    """``settle`` into a table bucketed by block, so that tables alike join without a shuffle."""
    spark, path = frame.sparkSession, scratch_path(frame.sparkSession, label)
    name = f"{label}_{uuid.uuid4().hex}"
    writer = frame.write.format("parquet").option("path", path)
    writer.bucketBy(buckets, "block").saveAsTable(name)
    table = spark.table(name)
    table.settled_path, table.table_name = path, name
    return table


def _discard(*tables: DataFrame) -> None:
    for table in tables:
        table.sparkSession.sql(f"DROP TABLE {table.table_name}")
        forget(table)


def _with_state(blocks: DataFrame, state: DataFrame | None) -> DataFrame:
    if state is None:
        return blocks.select(
            "block", "ids", "vectors",
            F.lit(None).cast("binary").alias("assigned"), F.lit(None).cast("array<binary>").alias("heaps"),
        )
    # The state is the small side: it is hashed, and the vectors need no sort.
    kept = state.select("block", "assigned", "heaps").hint("shuffle_hash")
    return blocks.join(kept, "block").select("block", "ids", "vectors", "assigned", "heaps")


def next_state(
    blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, offsets: list[float]
) -> DataFrame:
    """Assign all vectors to the nearest of the centroids; ``state`` is that of the round before."""
    clusters, dims = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64())
        for batch in batches:
            for number, ids, data, assigned, heaps in zip(*(c.to_pylist() for c in batch.columns)):
                block = Block(matrix(data, len(ids), dims), clusters, assigned, heaps)
                rows, before = block.assign(centroids, offsets)
                delta = block.change(rows, before).tolist()
                row = (number, block.assigned.tobytes(), block.packed_heaps(), delta, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([value], kind) for value, kind in zip(row, types)],
                    names=["block", "assigned", "heaps", "delta", "popped"],
                )

    return _with_state(blocks, state).mapInArrow(run, STATE)


def summed_change(state: DataFrame, clusters: int, dims: int) -> tuple[list[int], list[list[int]]]:
    """The change of all blocks: counts, and sums as whole numbers of any size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(clusters * (1 + 2 * dims), np.int64)
        for batch in batches:
            values = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False)
            total += values.reshape(-1, len(total)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["delta"])

    summed = (
        state.select("delta")
        .mapInArrow(run, "delta array<bigint>")
        .select(F.posexplode("delta").alias("place", "part"))
        .groupBy("place")
        .agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("part"))
        .collect()  # clusters times (1 + 2 dims) numbers
    )
    width = 1 + 2 * dims
    flat = [0] * (clusters * width)
    for place, part in summed:
        flat[place] = int(part)
    counts = [flat[c * width] for c in range(clusters)]
    sums = [
        [
            (flat[c * width + 1 + d] << _LOW_BITS) + flat[c * width + 1 + dims + d]
            for d in range(dims)
        ]
        for c in range(clusters)
    ]
    return counts, sums


def drifts(before: np.ndarray, after: np.ndarray) -> list[float]:
    """By how much each cluster's gaps shrink: its own drift plus the greatest of another."""
    moves = [
        math.sqrt(sum((int(a) - int(b)) ** 2 for a, b in zip(*pair))) * (1 + _SLACK)
        for pair in zip(before, after)
    ]
    return [
        own + max((other for j, other in enumerate(moves) if j != c), default=0.0)
        for c, own in enumerate(moves)
    ]


def assigned_vectors(
    blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, offsets: list[float]
) -> DataFrame:
    """vec_id, cluster and exact squared distance of every vector."""
    clusters, dims = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, data, assigned, heaps in zip(*(c.to_pylist() for c in batch.columns)):
                x = matrix(data, len(ids), dims)
                block = Block(x, clusters, assigned, heaps)
                block.assign(centroids, offsets)
                distance = np.empty(len(x), np.int64)
                for cluster in range(clusters):
                    mine = block.assigned == cluster
                    found = squared_distances(x[mine], centroids[cluster : cluster + 1])[:, 0]
                    if found.dtype == object:
                        found = np.array([min(v, MAX_LONG) for v in found], np.int64)
                    distance[mine] = found.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(block.assigned), pa.array(distance)],
                    names=["vec_id", "cluster", "distance"],
                )

    return _with_state(blocks, state).mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = DIMS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
) -> DataFrame:
    """vec_id, cluster, distance and the sums and centroid digest of its cluster, per vector.

    ``cluster_inertia`` and ``inertia`` are the distances summed over the cluster and over all,
    ``centroid_sha256`` is the digest of the centroid's components as decimal numbers.
    """
    spark = vectors.sparkSession
    buckets = min(MAX_BUCKETS, max(1, -(-vectors.count() // (BLOCK_ROWS * BUCKET_BLOCKS))))
    packed = to_blocks(vectors, id_col, vector_col, dims).repartition(buckets, "block")
    blocks = _bucketed(packed, "blocks", buckets)
    first = first_centroids(blocks, clusters, seed, dims)
    if not first:
        _discard(blocks)
        return spark.createDataFrame([], RESULT)
    centroids = np.array(first, np.int64)
    k = len(centroids)
    counts, sums = [0] * k, [[0] * dims for _ in range(k)]
    offsets, state = [0.0] * k, None
    for _ in range(rounds):
        after = _bucketed(next_state(blocks, state, centroids, offsets), "state", buckets)
        if state is not None:
            _discard(state)
        state = after
        more, added = summed_change(state, k, dims)
        counts = [a + b for a, b in zip(counts, more)]
        sums = [[a + b for a, b in zip(*pair)] for pair in zip(sums, added)]
        moved = [
            [total // count for total in sums[c]] if (count := counts[c]) else centroids[c].tolist()
            for c in range(k)
        ]
        before, centroids = centroids, np.array(moved, np.int64)
        offsets = [a + b for a, b in zip(offsets, drifts(before, centroids))]
    found = settle(assigned_vectors(blocks, state, centroids, offsets), "assigned")
    _discard(blocks, *([state] if state is not None else []))
    # One row per cluster.
    per_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")))
    inertia = {row[0]: int(row[1]) for row in per_cluster.collect()}
    overall = min(sum(inertia.values()), MAX_LONG)
    summary = [
        (c, min(total, MAX_LONG), overall, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for c, total in inertia.items()
    ]
    named = spark.createDataFrame(
        summary, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return found.join(F.broadcast(named), "cluster").select(*columns)


RESULT = (
    "vec_id bigint, cluster int, distance bigint, "
    "cluster_inertia bigint, inertia bigint, centroid_sha256 string"
)
