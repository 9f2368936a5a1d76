import random

import brute
import numpy as np
import pytest

from gaugeworks.llm import nearest
from gaugeworks.llm.nearest import top_k


def wanted(rows, k, every):
    good = [(n, i, np.floor(np.array(v, float) * 1024).astype(np.int64)) for n, (i, v) in enumerate(rows)
            if i is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for n, i, q in good:
        if i % every == 0:
            scored = sorted((-int(q @ x), j) for m, j, x in good if m != n and len(x) == len(q))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return brute.by_id(out)


@pytest.mark.parametrize("pivots,block", [(128, None), (6, 16), (1, 4)])
def test_exact_results(spark, table, monkeypatch, pivots, block):
    table([])
    if block:
        monkeypatch.setattr(nearest, "_block_rows", lambda rows: block)
    rng = random.Random(pivots)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 5]]) for i in range(400)]
    rows += [(1000 + i, list(rows[0][1])) for i in range(60)]  # one common vector, with ties
    rows += [(0, list(rows[7][1])), (0, list(rows[7][1])), (2000, [1.0, 2.0]), (2001, [0.5, 0.5])]
    rows += [(3000, None), (3100, []), (3200, [float("nan")] * 8), (3300, [None] + [0.0] * 7), (None, [0.1] * 8)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = top_k(frame.withColumn("row", frame["vec_id"]), pivots=pivots, query_every=20)
    assert brute.by_id([tuple(r) for r in got.collect()]) == wanted(rows, 10, 20)


def test_few_and_no_vectors(spark, table):
    table([])
    frame = spark.createDataFrame([(100, [0.1, 0.2]), (7, [0.3, -0.4])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in top_k(frame).collect()] == [(100, 1, 7, 102 * 307 - 204 * 410)]
    assert top_k(frame.filter("false")).collect() == []


def test_large_components_take_part(spark, table):
    table([])
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    rows += [(200, [3e6, -3e6, 1.0, 0.0]), (201, [2.5e6, 1e6, 0.5, 2.0]), (300, [-2e6, 1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = top_k(frame, query_every=20, pivots=8)
    assert brute.by_id([tuple(r) for r in got.collect()]) == wanted(rows, 10, 20)
    far = spark.createDataFrame([(100, [1e300, 0.0]), (7, [1e300, 1.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in top_k(far).collect()] == [(100, 1, 7, 2**63 - 1)]
