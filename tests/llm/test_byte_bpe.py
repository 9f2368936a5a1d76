import random

import numpy as np
import public_tokenizers
import pytest

from gaugeworks.llm.byte_bpe import byte_bpe, chunk_ends, cut, decode_ids, encode_texts
from gaugeworks.llm.queries import BYTE_VOCABULARY

VOCABULARY = (BYTE_VOCABULARY, public_tokenizers.PATTERN)
PARTS = [" ", "  ", "'s", "'re", "'ll", "'", "\n", "a", "bc", "é", "漢", "1", "22", "!!", "?'", " \t",
         "x" * 30, " " * 40, "'" * 25, "👍", "<|endoftext|>", " ", "́"]


def plain(text):
    """Each match of the pattern by itself, as pairs are merged by rank."""
    bpe = byte_bpe(*VOCABULARY)
    ids = []
    for match in bpe.pattern.findall(text or ""):
        parts = [bytes([b]) for b in match.encode()]
        while len(parts) > 1:
            pairs = [bpe.ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            at = min(range(len(pairs)), key=pairs.__getitem__)
            if pairs[at] == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        ids += [bpe.ranks[p] for p in parts]
    return ids


def texts(seed, count=50):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(300))) for _ in range(count)]
    return [None, "", "a", "word " * 300, "y" * 400 + " " * 500 + "z", "’" * 200, *made]


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (300, 90), (1 << 15, 1 << 10)])
def test_chunks_give_the_ids_of_whole_texts(spark, table, chunk, overlap):
    made = texts(chunk)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(made)]
    rows += [(3, made[3], "en", "s", 0), (None, made[4], "en", "s", 0)]  # a repeated and a null id
    encoded = encode_texts(table(rows), *VOCABULARY, chunk=chunk, overlap=overlap)
    got = [
        (r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded).decode())
        for r in decode_ids(encoded, *VOCABULARY).collect()
    ]
    wanted = [(i, plain(t), t or "") for i, t, *_ in rows]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_texts_without_stitches_for_long(spark, table):
    """Runs much longer than a chunk, whose chunks must all be merged, beside ordinary text."""
    made = [" " * 3000 + "x", "a" * 3000, "1" * 2500 + "b " * 400, "no end" + "\n" * 2000, "é" * 1500]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(made)]
    got = encode_texts(table(rows), *VOCABULARY, chunk=128, overlap=32).collect()
    bpe = byte_bpe(*VOCABULARY)
    assert {r.doc_id: bytes(r.ids) for r in got} == {i: bpe.encode(t).tobytes() for i, t, *_ in rows}


def test_white_space_beyond_the_stack_of_the_matcher():
    bpe = byte_bpe(*VOCABULARY)
    text = "a" + " " * 1_500_000 + "b"
    ids = bpe.encode(text)
    assert bpe.decode(ids) == text.encode() and len(ids) == 1_500_001


def test_chunks_cover_and_overlap():
    rng = random.Random(4)
    for size in (1, 100, 128, 161, 1000):
        data = "".join(rng.choice("aé漢👍") for _ in range(size)).encode()
        places = list(cut(data, 64, 16))
        assert places[0][0] == 0 and places[-1][1] == len(data)
        for (_, end), (start, _) in zip(places, places[1:]):
            assert end - start >= 12
        assert "".join(data[s:e].decode() for s, e in places) or not data


def test_overlaps_usually_agree(spark, table):
    """Ordinary text is stitched without merging."""
    text = "the quick brown fox, isn't it 42? " * 100
    chunks = spark.createDataFrame(
        [(0, k, s, e == len(text), text[s:e].encode()) for k, (s, e) in enumerate(cut(text.encode(), 200, 60))],
        "text_id bigint, chunk int, start bigint, last boolean, data binary",
    )
    rows = sorted(chunk_ends(chunks, 60, *VOCABULARY).collect(), key=lambda r: r.chunk)
    assert all(set(a.tail) & set(b.head) for a, b in zip(rows, rows[1:]))


def test_no_texts(spark, table):
    assert decode_ids(encode_texts(table([]), *VOCABULARY), *VOCABULARY).collect() == []
    with pytest.raises(ValueError):
        encode_texts(table([]), *VOCABULARY, chunk=100, overlap=90)
