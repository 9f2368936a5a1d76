import random
from fractions import Fraction
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest

from gaugeworks.llm import jaccard
from gaugeworks.llm.graph import components
from gaugeworks.llm.hashing import Words
from gaugeworks.llm.jaccard import near_duplicates
from gaugeworks.llm.substrings import anchors, remove_repeats
from gaugeworks.session import run_folder


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (1, 60)])
def test_components_equal_brute_force(table, corpus, width, percent):
    found = near_duplicates(table(corpus), width=width, similarity=Fraction(percent, 100))
    assert brute.by_id(tuple(r) for r in found.collect()) == brute.by_id(
        brute.components(corpus, width, percent)
    )


def test_near_copies_of_one_text_with_many_edits(table, monkeypatch):
    """A hot group whose members are only partly linked, all shingles of it frequent or none."""
    rng = random.Random(8)
    base = brute.sentence(rng, 70).split()
    rows = []
    for k in range(90):
        copy = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 5, 9))):
            copy[rng.randrange(70)] = f"e{rng.randrange(40)}"
        rows.append((k, " ".join(copy), "en", "s", 1))
    wanted = brute.by_id(brute.components(rows))
    assert len({w[2] for w in wanted}) > 5
    for share in (jaccard.FREQUENT_SHARE, 2.0):
        monkeypatch.setattr(jaccard, "FREQUENT_SHARE", share)
        found = near_duplicates(table(rows), width=3, similarity=Fraction(9, 10))
        assert brute.by_id(tuple(r) for r in found.collect()) == wanted


def test_a_passage_of_few_documents_comes_late(table):
    """Eight of 2,400 documents in one batch hold it; each has enough shingles of its own."""
    rng = random.Random(5)
    passage = brute.sentence(rng, 12)
    rows = [
        (k, f"{brute.sentence(rng, 12)} {passage if k % 300 == 0 else ''}", "en", "s", 1) for k in range(2400)
    ]
    frequent = jaccard.frequent_shingles(table(rows, 1), 5)
    assert set(jaccard._raw_sets(pa.array([passage]), 5)[0]) <= set(frequent)


def test_prefixes_are_the_first_in_order():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 40):
        names = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for listed in (0, 1, n // 2, n):
            frequent = np.sort(rng.choice(names, listed, replace=False))
            order = sorted(names, key=lambda x: (x in frequent, x))
            for count in (1, (n + 1) // 2, n):
                found = jaccard._prefix(names, frequent, count)
                assert [int(x) & ((1 << 63) - 1) for x in found] == [int(x) for x in order[:count]]
                assert list(found) == sorted(found)


def test_parities_never_say_too_much():
    rng = np.random.default_rng(2)
    for sizes in ((1, 1), (3, 400), (400, 430), (2000, 2500)):
        for shared in (0, min(sizes) // 2, min(sizes)):
            pool = np.unique(rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64))
            one, two = pool[: sizes[0]], pool[sizes[0] - shared : sizes[0] - shared + sizes[1]]
            apart = jaccard._apart(*(np.frombuffer(jaccard._parity(s), np.uint8) for s in (one, two)))
            real = len(np.setxor1d(one, two))
            assert apart <= real
            assert apart >= real / 3 or len(one) * 5 < len(two)


def test_rounds_give_the_same(table, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "MEETINGS_PER_ROW", 0.02)
    found = near_duplicates(table(corpus), width=3, similarity=Fraction(6, 10))
    assert brute.by_id(tuple(r) for r in found.collect()) == brute.by_id(brute.components(corpus, 3, 60))


def test_only_the_result_is_left_on_disk(spark, table, corpus):
    with run_folder(spark) as folder:
        near_duplicates(table(corpus))
        assert [p.name.partition("-")[0] for p in Path(folder).iterdir()] == ["components"]


def test_no_documents(table):
    assert near_duplicates(table([])).collect() == []
    assert remove_repeats(table([])).collect() == []


def test_components_of_a_long_path(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101)]
    random.Random(1).shuffle(pairs)
    got = components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("verbatim", [False, True])
def test_repeats_equal_brute_force(table, corpus, verbatim):
    got = remove_repeats(table(corpus), verbatim=verbatim).collect()
    wanted = brute.without_repeats(corpus)
    if verbatim:
        wanted = [(*w[:3], w[3] if w[2] else r[1] or "") for w, r in zip(wanted, corpus)]
    assert brute.by_id([(r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in got]) == brute.by_id(wanted)
    assert sum(w[2] for w in wanted) > 500
    assert {r.row.lang for r in got} == {"en"} and {r.row.bucket for r in got} == {-1}


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "dd", "e"]  # few words, so that runs are common
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    texts += ["a " * 50, "a " * 13, "b " + "a " * 20 + "b"]
    found = {}
    words = Words(pa.array(texts))
    plain = [w for t in texts for w in t.split()]
    windows, names = anchors(words, 13)
    for first, name in zip(windows, names):
        assert found.setdefault(tuple(plain[first : first + 13]), name) == name
    assert len(np.unique(names)) > 100
