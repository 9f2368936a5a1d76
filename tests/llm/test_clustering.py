import hashlib
import io
import random
from contextlib import redirect_stdout

import brute
import numpy as np
import pytest

from gaugeworks.llm import clustering
from gaugeworks.llm.clustering import Block, cluster, drifts, squared_distances

SCHEMA = "vec_id bigint, embedding array<double>"


def wanted(rows, dims, k, rounds, seed=3):
    kept = [
        (i, [int(c) for c in np.floor(np.array(v, float) * 1024)])
        for i, v in rows
        if v is not None and len(v) == dims and None not in v and np.isfinite(v).all()
    ]
    name = lambda i: f"{seed}:{'null' if i is None else i}".encode()
    first = sorted((hashlib.sha256(name(i)).hexdigest(), v) for i, v in kept)[:k]
    centroids = [v for _, v in first]

    def assign():
        square = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
        return [min((square(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if mine:
                centroids[j] = [sum(column) // len(mine) for column in zip(*mine)]
    found = assign()
    sums = {}
    for d, j in found:
        sums[j] = sums.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [
        (i, j, d, sums[j], sum(sums.values()), digest[j]) for (i, _), (d, j) in zip(kept, found)
    ]


def vectors(seed, dims=6):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(dims)]) for i in range(500)]
    rows += [(1000 + i, list(rows[0][1])) for i in range(200)]  # one common vector
    rows += [(5, list(rows[5][1])), (5, list(rows[5][1]))]  # repeated rows
    rows += [(2000 + i, [float(i % 3)] * dims) for i in range(30)]  # ties
    rows += [(1, None), (2, []), (3, [float("nan")] * dims), (4, [None] + [0.0] * (dims - 1))]
    rows += [(6, [float("inf")] * dims), (7, [1.0] * (dims + 1)), (None, [0.5] * dims)]
    return rows


@pytest.mark.parametrize("seed,k,rounds", [(1, 8, 10), (2, 3, 4), (3, 1, 2), (4, 5, 0)])
def test_equals_plain_rounds(spark, table, monkeypatch, seed, k, rounds):
    table([])
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 64)
    monkeypatch.setattr(clustering, "BUCKET_BLOCKS", 3)
    rows = vectors(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS cluster", "2 AS block")
    got = cluster(frame, dims=6, clusters=k, rounds=rounds).collect()
    assert brute.by_id(map(tuple, got)) == brute.by_id(wanted(rows, 6, k, rounds))


def test_large_components_take_part(spark, table):
    table([])
    rows = [(i, [float(i)] * 2) for i in range(20)]
    rows += [(100, [3e5, -3e5]), (101, [3e7, 1.0]), (102, [2.5e5, -3e5])]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = cluster(frame, dims=2, clusters=4, rounds=5).collect()
    assert brute.by_id(map(tuple, got)) == brute.by_id(wanted(rows, 2, 4, 5))
    # Beyond what the result can hold: no error, and the longs end at their largest value.
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0])], SCHEMA)
    rows = cluster(far, dims=2, clusters=1, rounds=1).collect()
    assert {r.inertia for r in rows} == {2**63 - 1} and len(rows) == 2


def test_few_and_no_vectors(spark, table):
    table([])
    rows = [(1, [0.0, 1.0]), (2, [5.0, 1.0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = cluster(frame, dims=2).collect()
    assert brute.by_id(map(tuple, got)) == brute.by_id(wanted(rows, 2, 8, 10))
    none = cluster(frame.filter("false"), dims=2)
    assert none.collect() == [] and none.columns[:3] == ["vec_id", "cluster", "distance"]


def test_only_expired_gaps_are_rescanned():
    """Far fewer vectors are compared than a plain round would, and none that should is missed."""
    rng = np.random.default_rng(5)
    x = rng.integers(-2000, 2000, (4000, 16)) + 6000 * rng.integers(0, 5, (4000, 1))
    centroids = x[:5].copy()
    assigned, heaps, offsets, compared = None, None, [0.0] * 5, []
    for _ in range(12):
        block = Block(x, 5, assigned, heaps)
        rows, _ = block.assign(centroids, offsets)
        compared.append(len(rows))
        exact = squared_distances(x, centroids)
        assert (block.assigned == exact.argmin(axis=1)).all()
        assigned, heaps = block.assigned.tobytes(), block.packed_heaps()
        moved = np.array(
            [x[block.assigned == c].sum(axis=0) // max(1, (block.assigned == c).sum()) for c in range(5)]
        )
        offsets = [a + b for a, b in zip(offsets, drifts(centroids, moved))]
        centroids = moved
    assert compared[0] == 4000 and compared[-1] < 400


def test_heaps_are_heaps():
    x = np.arange(200).reshape(100, 2)
    block = Block(x, 3, None, None)
    block.assign(x[[0, 40, 90]], [0.0] * 3)
    for data in block.packed_heaps():
        keys = np.frombuffer(data, clustering._ENTRY)["key"]
        assert all(keys[(k - 1) // 2] <= keys[k] for k in range(1, len(keys)))


def test_rounds_join_without_a_shuffle(spark, table):
    table([])
    frame = spark.createDataFrame(vectors(1), SCHEMA)
    packed = clustering.to_blocks(frame, "vec_id", "embedding", 6).repartition(4, "block")
    blocks = clustering._bucketed(packed, "blocks", 4)
    centroids = np.array(clustering.first_centroids(blocks, 3, 3, 6))
    state = clustering._bucketed(clustering.next_state(blocks, None, centroids, [0.0] * 3), "state", 4)
    out = io.StringIO()
    with redirect_stdout(out):
        clustering.next_state(blocks, state, centroids, [0.0] * 3).explain("formatted")
    assert "ShuffledHashJoin" in out.getvalue() and "Exchange" not in out.getvalue()
    clustering._discard(blocks, state)
