"""Exact top-k search by inner product, as a Voronoi join.

Vectors are assigned to the nearest of a few pivots. A group's summary is its size, its radius and
its ``k + 1`` smallest distances to the pivot p. For any x of the group, q.x lies within
|q| d(x, p) of q.p; so the summaries alone give every query a score that at least k other vectors
reach, and an upper bound for each group. A query is sent only to groups whose upper bound
reaches that score; groups are cut into blocks of bounded size, so many equal vectors are spread,
and each block solves its queries locally. Pivots and summaries are bounded by parameters.

Components are taken as floor(1024 x). Defined cases: vectors that are null or empty, or hold
null or non-finite components, and rows with a null id take no part; vectors of different length
have no score with each other; repeated rows are candidates and queries of their own, and only the
query's own row is left out; equal scores go to the smaller id; fewer candidates than k give
fewer rows; components beyond 2**60 count as 2**60 and scores beyond a long as the largest long;
extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from gaugeworks.llm.clustering import kept_vectors
from gaugeworks.session import settle

SCALE = 1024
PIVOTS = 128
K = 10
QUERY_EVERY = 100
MOST = 2**63 - 1


def _block_rows(rows: int) -> int:
    """Rows of a block: few enough to spread a small table, at most 8192 in a large one."""
    return min(8192, max(256, rows // 512))


def quantized(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim and the quantized vector of every row that takes part."""

    def quantize(batches):
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            for dim in pc.unique(pc.list_value_length(batch.column(1))).to_pylist():
                if not dim:
                    continue
                ids, x = kept_vectors(batch, dim)
                small = (np.abs(x) < 2**31).all(axis=1)
                found = [row.astype("<i4" if fits else "<i8").tobytes() for row, fits in zip(x, small)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([dim] * len(x), pa.int32()), pa.array(found, pa.binary())],
                    names=["vec_id", "dim", "vector"],
                )

    return (
        vectors.select(
            F.col(id_col).cast("bigint").alias("vec_id"),
            F.col(vector_col).cast("array<double>").alias("vector"),
        )
        .mapInArrow(quantize, "vec_id bigint, dim int, vector binary")
        .withColumn("row", F.monotonically_increasing_id())
    )


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of 32-bit or, where they do not fit, 64-bit numbers, as whole doubles."""
    rows = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    data = b"".join(rows)
    if len(data) == 4 * dim * len(rows):
        return np.frombuffer(data, "<i4").reshape(-1, dim).astype(np.float64)
    kinds = ["<i4" if len(row) == 4 * dim else "<i8" for row in rows]
    return np.array([np.frombuffer(row, kind).astype(np.float64) for row, kind in zip(rows, kinds)])


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    most = np.abs(queries).max() * np.abs(data).max() * queries.shape[1]
    if most < 2**53:
        return (queries @ data.T).astype(np.int64)
    a, b = queries.astype(np.int64), data.astype(np.int64)
    if most < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def _by_dim(dims: np.ndarray):
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    query_every: int = QUERY_EVERY,
    pivots: int = PIVOTS,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors for each query."""
    stored = settle(quantized(vectors, id_col, vector_col), "vectors")
    count = stored.count()
    limit = _block_rows(count)
    # Pivots are the different vectors of least hash: about four times as many as wanted pass a
    # threshold, and one of each dimension always does.
    hashed = stored.select("dim", "vector", F.xxhash64("vector").alias("hash"))
    threshold = -(2**63) + min(2**64 - 1, 2**64 * 4 * pivots // max(1, count))
    first = hashed.groupBy("dim").agg(F.min(F.struct("hash", "vector")).alias("v"))
    few = hashed.filter(F.col("hash") <= threshold).union(first.select("dim", "v.vector", "v.hash"))
    by_hash = Window.partitionBy("dim").orderBy("hash", "vector")
    chosen = (
        few.distinct()
        .withColumn("n", F.row_number().over(by_hash))
        .filter(F.col("n") <= pivots)
        .select("dim", "vector")
        .collect()
    )
    centres: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in chosen}:
        centres[dim] = _matrix(sorted(bytes(r["vector"]) for r in chosen if r["dim"] == dim), dim)

    def assign(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            group, distance = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim, at in _by_dim(dims):
                x, p = _matrix(batch.column("vector").take(pa.array(at)), dim), centres[dim]
                square = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :]
                group[at] = square.argmin(1)
                distance[at] = np.sqrt(np.maximum(square.min(1), 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(group), pa.array(distance)],
                names=[*batch.schema.names, "grp", "distance"],
            )

    grouped = settle(
        stored.mapInArrow(
            assign, "vec_id bigint, dim int, vector binary, row bigint, grp int, distance double"
        ),
        "voronoi",
    )
    # k + 1 smallest distances per group, kept per salted part first: no group meets in one task.
    salted = grouped.withColumn("salt", F.pmod("row", F.lit(64)))
    near = Window.partitionBy("dim", "grp", "salt").orderBy("distance", "row")
    nearest = (
        salted.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1)
        .groupBy("dim", "grp").agg(F.slice(F.sort_array(F.collect_list("distance")), 1, k + 1).alias("nearest"))
    )
    summaries = (
        grouped.groupBy("dim", "grp")
        .agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"))
        .join(nearest, ["dim", "grp"])
        .collect()
    )
    bounds: dict[int, tuple] = {}
    for dim in centres:
        own = sorted((s for s in summaries if s["dim"] == dim), key=lambda s: s["grp"])
        bounds[dim] = (
            np.array([s["grp"] for s in own]),
            np.array([s["radius"] for s in own]),
            np.array([max(1, math.ceil(s["n"] / limit)) for s in own]),
            [np.array(s["nearest"]) for s in own],
        )

    def route(batches):
        """Queries, once for each block they may find a result in."""
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            source, groups, parts = [], [], []
            for dim, at in _by_dim(dims):
                q = _matrix(batch.column("vector").take(pa.array(at)), dim)
                numbers, radius, blocks, closest = bounds[dim]
                middle = q @ centres[dim][numbers].T
                norm = np.sqrt((q * q).sum(1))[:, None]
                owner = np.repeat(np.arange(len(numbers)), [len(c) for c in closest])
                lower = middle[:, owner] - norm * np.concatenate(closest)[None, :]
                lower.sort(axis=1)
                # The query itself may be one of the k + 1 vectors.
                sure = lower[:, -(k + 1)] if lower.shape[1] > k else np.full(len(at), -np.inf)
                upper = middle + norm * radius[None, :]
                slack = 1e-9 * (np.abs(middle) + norm * radius[None, :]) + 1e-6
                row, column = np.nonzero(upper + slack >= sure[:, None])
                repeats = blocks[column]
                source.append(np.repeat(at[row], repeats))
                groups.append(np.repeat(numbers[column], repeats))
                starts = np.cumsum(repeats) - repeats
                parts.append(np.arange(int(repeats.sum())) - np.repeat(starts, repeats))
            if not source:
                continue
            rows = batch.select(["vec_id", "dim", "vector", "row"]).take(pa.array(np.concatenate(source)))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(np.concatenate(groups), pa.int32()), pa.array(np.concatenate(parts), pa.int32())],
                names=["vec_id", "dim", "vector", "row", "grp", "part"],
            )

    sizes = {(s["dim"], s["grp"]): max(1, math.ceil(s["n"] / limit)) for s in summaries}

    def place(batches):
        """Data rows, each to one block of its group."""
        for batch in batches:
            keys = zip(batch.column("dim").to_pylist(), batch.column("grp").to_pylist())
            parts = np.array([sizes[key] for key in keys], np.int64)
            part = batch.column("row").to_numpy() % np.maximum(parts, 1)
            rows = batch.select(["vec_id", "dim", "vector", "row", "grp"])
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(part, pa.int32())],
                names=["vec_id", "dim", "vector", "row", "grp", "part"],
            )

    kinds = "vec_id bigint, dim int, vector binary, row bigint, grp int, part int"
    data = grouped.mapInArrow(place, kinds).withColumn("asks", F.lit(False))
    queries = grouped.filter(F.col("vec_id") % query_every == 0).mapInArrow(route, kinds)
    block = ["dim", "grp", "part"]
    together = data.unionByName(queries.withColumn("asks", F.lit(True)))
    together = together.repartition(*block).sortWithinPartitions(*block, "asks")

    def solve(batches):
        current, held, data, ids, rows = None, [], None, None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in block])
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(keys) != 0).any(0) | (np.diff(asks.astype(int)) != 0)) + 1
            for i, j in zip([0, *edges], [*edges, len(asks)]):
                key = tuple(keys[:, i])
                if key != current:
                    current, held, data = key, [], None
                part = batch.slice(i, j - i)
                if not asks[i]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if data is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    data = _matrix(table.column("vector"), int(key[0]))
                    ids, rows = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
                yield from best(part, data, ids, rows, int(key[0]))

    def best(part, data, ids, rows, dim):
        own = part.column("row").to_numpy()
        scores = _scores(_matrix(part.column("vector"), dim), data)
        out = []
        for n in range(len(own)):
            other = np.flatnonzero(rows != own[n])
            if len(other) > k:
                least = np.partition(scores[n, other], len(other) - k)[len(other) - k]
                other = other[scores[n, other] >= least]
            order = other[np.lexsort((ids[other], -scores[n, other]))][:k]
            out.append((np.full(len(order), n), ids[order], scores[n, order]))
        at = np.concatenate([o[0] for o in out])
        yield pa.RecordBatch.from_arrays(
            [
                part.column("vec_id").take(pa.array(at)),
                part.column("row").take(pa.array(at)),
                pa.array(np.concatenate([o[1] for o in out]), pa.int64()),
                pa.array(np.concatenate([o[2] for o in out]), pa.int64()),
            ],
            names=["query_id", "row", "vec_id", "score"],
        )

    local = together.mapInArrow(solve, "query_id bigint, row bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return (
        local.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
