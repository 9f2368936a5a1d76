import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gaugeworks.llm import packing
from gaugeworks.llm.packing import (
    ShardIndex, Statistics, corpus_statistics, encoded, pack_documents, retrieval_order,
)
from gaugeworks.llm.tokens import END_ID, WordEncoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "é ́x é", "İ ΣΣ ẞ", "it's we're x\x1cy\x85z", "é힣 가 ½①٠", "﻿a‍b", "A\nB\r\n\tC\x0bD\x0cE",
       "<|endoftext|> a<|startoftext|>b", "don't'll 'S", "a,b 3.5% (x) y!! z?", "10 0 00 a0b", "“q” — r…"]


@pytest.fixture(scope="module")
def tokenizer():
    plain = Tokenizer.from_file(VOCABULARY)
    plain.encode_special_tokens = True
    return plain


def test_cached_words_give_the_tokenizers_ids(tokenizer, corpus, monkeypatch):
    texts = [t or "" for _, t, *_ in corpus] + ODD
    for cache in (1_000_000, 50):
        monkeypatch.setattr("gaugeworks.llm.tokens.CACHE_WORDS", cache)
        encoder = WordEncoder(VOCABULARY)
        for start in range(0, len(texts), 9):
            part = texts[start : start + 9]
            got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode([t.encode() for t in part])]
            assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


@pytest.mark.parametrize("shard", [1 << 19, 3000])
def test_every_id_in_one_piece_without_padding(table, corpus, tokenizer, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
    rows = pack_documents(table(corpus), VOCABULARY).collect()
    texts = {}
    for doc_id, text, *_ in corpus:
        texts.setdefault((doc_id, text), 0)
        texts[doc_id, text] += 1
    wanted = []
    for (doc_id, text), times in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4")
        wanted.append((doc_id, ids, times))
    spans = {}
    for r in rows:
        match = [w for w in wanted if w[0] == r.doc_id and len(w[1]) == r.doc_tokens
                 and zlib.crc32(w[1][r.start : r.start + r.length].tobytes()) == r.ids_crc32]
        assert match
        spans[r.doc_id] = spans.get(r.doc_id, 0) + r.length
    total = {}
    for doc_id, ids, times in wanted:
        total[doc_id] = total.get(doc_id, 0) + times * len(ids)
    assert spans == total
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 and (n & (n - 1) == 0) for n in sequences.values())
    assert pack_documents(table([]), VOCABULARY).collect() == []


def test_neighbours_share_rare_ids():
    common = list(range(100))
    docs = [np.array([*common, 1000 + k % 3, 2000 + k, END_ID], "<u2") for k in range(9)]
    index = ShardIndex(docs)
    used = np.zeros(9, bool)
    used[0] = True
    best = index.neighbours(docs[0][:-1], used)
    assert set(best[:2].tolist()) == {3, 6} and 0 not in best
    assert sorted(retrieval_order(docs)) == list(range(9))
    assert retrieval_order([np.array([END_ID], "<u2")] * 3) == [0, 1, 2]


def test_every_id_of_a_seed_is_asked_for():
    # Sixty ids of the seed are rarer than the forty it shares with the last document.
    shared = np.arange(5000, 5040)
    docs = [np.array([*range(60), *shared, END_ID], "<u2")]
    docs += [np.array([*range(1000 + 9 * k, 1009 + 9 * k), 5000, END_ID], "<u2") for k in range(4)]
    docs.append(np.array([*shared, END_ID], "<u2"))
    best = ShardIndex(docs).neighbours(docs[0][:-1], np.arange(6) == 0)
    assert best.tolist() == [5, 1, 2, 3, 4]


def test_neighbours_follow_the_whole_score():
    rng = np.random.default_rng(5)
    docs = [np.append(rng.zipf(1.3, rng.integers(30, 300)) % 3000, END_ID).astype("<u2") for _ in range(80)]
    mean = sum(len(d) - 1 for d in docs) / len(docs)
    words = [d[:-1].tolist() for d in docs]
    index = ShardIndex(docs)
    for seed in range(0, 80, 7):
        scores = np.zeros(80)
        for term in set(words[seed]):
            holders = sum(term in w for w in words)
            idf = np.log(1 + (80 - holders + 0.5) / (holders + 0.5))
            for k, w in enumerate(words):
                n = w.count(term)
                norm = packing.K1 * (1 - packing.B + packing.B * len(w) / mean)
                scores[k] += idf * n * (packing.K1 + 1) / (n + norm)
        got = index.neighbours(docs[seed][:-1], np.arange(80) == seed)
        assert set(got.tolist()) == set(np.flatnonzero(scores > 0).tolist()) - {seed}
        assert np.all(np.diff(scores[got]) < 1e-9)


def test_statistics_are_those_of_all_documents(table, corpus, tokenizer):
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for _, t, *_ in corpus]
    found, total = corpus_statistics(encoded(table(corpus), VOCABULARY, "doc_id", "text"))
    wanted = np.zeros(1 << 16, int)
    for x in ids:
        wanted[list(set(x))] += 1
    assert found.holders.tolist() == wanted.tolist()
    assert (found.count, total) == (len(ids), sum(len(x) + 1 for x in ids))
    assert found.mean == pytest.approx(sum(map(len, ids)) / len(ids))
    assert corpus_statistics(encoded(table([]), VOCABULARY, "doc_id", "text"))[1] == 0


def test_shards_weigh_ids_by_the_whole_corpus():
    # In the shard 7 is in two documents and 8 in three; in the corpus 7 is in nearly all.
    docs = [np.array([*x, END_ID], "<u2") for x in ([7, 8], [7, 1], [8, 2], [8, 3])]
    holders = np.ones(1 << 16, int)
    holders[[7, 8]] = 900, 30
    used = np.arange(4) == 0
    alone = ShardIndex(docs).neighbours(docs[0][:-1], used)
    within = ShardIndex(docs, Statistics(1000, 2.0, holders)).neighbours(docs[0][:-1], used)
    assert alone.tolist() == [1, 2, 3] and within.tolist() == [2, 3, 1]
    assert retrieval_order(docs, 0, Statistics(1000, 2.0, holders)) == [0, 2, 3, 1]


def test_packing_hands_the_corpus_statistics_to_every_shard(monkeypatch):
    counts = []

    class Kept:
        @staticmethod
        def get():
            return Kept()

        def partitionId(self):
            return 0

    monkeypatch.setattr(packing, "TaskContext", Kept)
    monkeypatch.setattr(packing, "SHARD_TOKENS", 20)
    monkeypatch.setattr(packing, "retrieval_order",
                        lambda docs, filled, stats: counts.append(stats.count) or list(range(len(docs))))
    docs = [np.array([k, END_ID], "<u2") for k in range(40)]
    batch = packing.pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "ids": [d.tobytes() for d in docs]})
    list(packing._lay_out([batch], packing.Statistics(40, 1.0, np.ones(1 << 16, int))))
    assert len(counts) == 4 and set(counts) == {40}
