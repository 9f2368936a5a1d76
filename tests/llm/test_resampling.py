import hashlib
import math
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from gaugeworks.llm import resampling
from gaugeworks.llm.resampling import SliceFeatures, bucket_counts, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, max_n):
    w = WORD.findall(brute.lower(text))
    return [" ".join(w[k : k + n]) for n in range(1, max_n + 1) for k in range(len(w) - n + 1)]


def bucket(gram, buckets):
    return zlib.crc32(gram.encode()) % buckets


def wanted(rows, target, max_n=1, buckets=10_000, min_words=20, seed=2024, percent=10):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for gram in grams(text, max_n):
                counts[bucket(gram, buckets)] += 1
    total, goal = sum(s), sum(t)
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (goal + buckets))))
        for b in range(buckets)
    ]
    out = []
    for doc_id, text, *_ in rows:
        g = [gain[bucket(x, buckets)] for x in grams(text, max_n)]
        weight = sum(g) // len(g) if g else 0
        name = f"{seed}:{'null' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        draw = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(g), weight, weight + draw, len(WORD.findall(brute.lower(text)))])
    order = sorted(
        (r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0)
    )
    drawn = len(order) * percent // 100
    return [tuple(r[:4]) for r in out], [(r[0], r[3], k + 1) for k, r in enumerate(order[:drawn])]


@pytest.mark.parametrize("max_n,percent,range_rows", [(1, 10, 1 << 20), (1, 100, 7), (3, 60, 5)])
def test_equals_brute_force(spark, table, corpus, monkeypatch, max_n, percent, range_rows):
    monkeypatch.setattr(resampling, "RANGE_ROWS", range_rows)
    rows = list(corpus) + [(950, "Ünïcode ÀB\x00c d’e 12_3", "en", "s", 0)]
    target = [corpus[4][1], None, "", corpus[8][1], "ka1 lo2 Ka1"]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    got = resample(table(rows), items, max_n=max_n, buckets=500, percent=percent).collect()
    scores, drawn = wanted(rows, target, max_n, 500, percent=percent)
    assert brute.by_id([tuple(r)[:4] for r in got]) == brute.by_id(scores)
    mine = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [(r.doc_id, r.score, r.rank) for r in mine] == drawn
    assert len(drawn) > 2


def test_no_feature_crosses_texts():
    column = pa.array(["a b", None, "", "c", "!?", "d e f"])
    found = SliceFeatures(column, 2, 97)
    texts = [[], [], [], [], [], []]
    for doc, b in zip(found.doc.tolist(), found.bucket.tolist()):
        texts[doc].append(b)
    for text, got in zip(column.to_pylist(), texts):
        assert sorted(got) == sorted(bucket(g, 97) for g in grams(text, 2))
    assert found.words.tolist() == [2, 0, 0, 1, 0, 3]
    assert found.features.tolist() == [3, 0, 0, 1, 0, 5]


def test_a_very_long_text_and_its_very_long_word(spark, table):
    rows = [(1, "ab " * 200_000 + "x" * 300_000, "en", "s", 0), (2, "ab", "en", "s", 0)]
    counts = bucket_counts(table(rows), "text", 1, 1000)
    assert counts.sum() == 200_002 and counts[bucket("x" * 300_000, 1000)] == 1


def test_empty_tables(spark, table):
    none = spark.createDataFrame([], "text string")
    assert resample(table([]), none).collect() == []
    got = resample(table([(1, "one two", "en", "s", 0)]), none).collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in got] == [(1, 2, None)]


def test_gains_prefer_the_target():
    gain = resampling.gains(np.array([10, 10, 0]), np.array([5, 0, 0]))
    assert gain[0] > 0 > gain[1] and gain[0] - gain[1] == pytest.approx(1000 * np.log(6), abs=1)
