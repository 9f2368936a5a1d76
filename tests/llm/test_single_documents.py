"""Operators that look at one document, page or neighbour at a time."""

import hashlib
import html
import random
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugeworks.llm import extraction, fingerprints, licenses, quality
from gaugeworks.llm.attribution import allocate, byte_encoder, line_starts, section_tokens
from gaugeworks.llm.fingerprints import differing, fingerprint_versions
from gaugeworks.llm.licenses import evaluate, identifiers, postfix, scan_licenses

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- quality ---


def marked(count, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(count):
        words = brute.sentence(rng, rng.randint(5, 60)).split()
        good = k % 4 != 0
        rows.append((k, " ".join(w if good else w.upper() + "!!" for w in words), good))
    return rows


def test_quality_on_held_out_documents(spark, table, monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 4)
    rows = marked(240, 2)
    docs = table([(i, t, "en", "s", 1) for i, t, _ in rows] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0)])
    labels = spark.createDataFrame(
        [(i, int(g), 0) for i, _, g in rows] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int"
    )
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score_documents(docs, model).collect()}
    assert len(got) == 242
    held = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].held_out for i, _ in held)
    assert np.mean([got[i].predicted == g for i, g in held]) > 0.95
    assert got[900].score == got[901].score and 0 < got[900].score < 1
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_do_not_matter(spark, table):
    rows = marked(60, 3)
    docs = table([(i, t, "en", "s", 1) for i, t, _ in rows])
    flip = lambda i, g: int(g) ^ (zlib.crc32(str(i).encode()) % 4 == 2)
    tables = [
        spark.createDataFrame([(i, f(i, g)) for i, _, g in rows], "doc_id bigint, quality int")
        for f in (lambda i, g: int(g), flip)
    ]
    one, two = (quality.fit(docs, t, max_sample=40) for t in tables)
    assert np.array_equal(one.table, two.table) and one.bias == two.bias


def test_no_labels_and_no_documents(spark, table):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.fit(table([]), none)
    assert quality.score_documents(table([]), model).collect() == []
    assert model.scores(["any text", ""]).tolist() == [0.5, 0.5]


def test_features_are_found_anywhere_in_the_text():
    model = quality.QualityModel(np.arange(1 << quality.BUCKET_BITS, dtype=np.float32) / 1e5, 0.0)
    texts = ["alpha beta", "", "x", "gamma\ndelta ü"]
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])


# --- token counts ---


def test_section_tokens_add_up(table, corpus):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    rows = section_tokens(table(corpus), RANKS).collect()
    totals, sizes = {}, {}
    for r in rows:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.n_tokens
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_chars
    wanted, chars = {}, {}
    for doc_id, text, *_ in corpus:
        wanted[doc_id] = wanted.get(doc_id, 0) + len(plain.encode(text or "", add_special_tokens=False).ids)
        chars[doc_id] = chars.get(doc_id, 0) + len(text or "")
    assert totals == wanted and sizes == chars
    assert section_tokens(table([]), RANKS).collect() == []


@pytest.mark.parametrize("text", ["", "a\n\n  b\n", "\n", "é\n\n\nü 😀\n x", "a\r\n \n\nb", "word\n \n \nnext"])
def test_sections_by_token_offsets(text):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    offsets = plain.encode(text, add_special_tokens=False).offsets
    starts = [0] + [k + 1 for k, c in enumerate(text) if c == "\n" and k + 1 < len(text)]
    wanted = [0] * len(starts)
    for first, _ in offsets:
        wanted[max(k for k, s in enumerate(starts) if s <= first)] += 1
    got, _ = allocate(byte_encoder(RANKS).ends(text), line_starts(text.encode()))
    assert got.tolist() == wanted


def test_rules_for_crossing_tokens():
    ends, starts = np.array([1, 4, 6, 9]), np.array([0, 2, 5])
    assert [allocate(ends, starts, rule)[0].tolist() for rule in ("start", "end", "most")] == [[2, 1, 1], [1, 1, 2], [1, 2, 1]]
    assert allocate(ends, starts)[1].tolist() == [1, 1, 0]
    with pytest.raises(ValueError):
        allocate(ends, starts, "other")


# --- fingerprints ---


@pytest.mark.parametrize("group", [1500, 7])
def test_versions(table, corpus, monkeypatch, group):
    monkeypatch.setattr(fingerprints, "GROUP_DOCS", group)
    order = sorted(corpus, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    got = fingerprint_versions(table(corpus)).collect()
    wanted = []
    for own, after in zip(order, [*order[1:], order[0]]):
        text, following = own[1] or "", after[1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        wanted.append((own[0], len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert brute.by_id([(r.doc_id, r.n_chars, r.edited_sha256) for r in got]) == brute.by_id(wanted)
    prints = {}
    texts = {(i, len(t or "")): t or "" for i, t, *_ in corpus}
    for r in got:
        text = texts[r.doc_id, r.n_chars]
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprint_versions(table([])).collect() == []


def test_likeness_is_the_jaccard_similarity_of_the_pieces():
    rng = random.Random(6)
    lines = [[brute.sentence(rng, 7) for _ in range(rng.randint(0, 80))] for _ in range(40)]
    changed = [[x for x in ls if rng.random() < 0.8] + [brute.sentence(rng, 7)] * rng.randint(0, 9) for ls in lines]
    one, two = (["\n".join(x) for x in side] for side in (lines, changed))
    made = [fingerprints.sketched(*fingerprints.digests(texts), len(texts)) for texts in (one, two)]
    got = fingerprints.likeness(*made)

    def pieces(ls):
        return {(x, ls[:k].count(x)) for k, x in enumerate(ls)}

    for a, b, near in zip(lines, changed, got):
        x, y = pieces(a), pieces(b)
        assert near == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


def test_peeling_gives_the_differing_digests():
    a, b = "one line\ntwo lines\nthree", "one line\ntwo lines here\nthree\nfour"
    prints = fingerprints.fingerprints([a, b])
    only_a, only_b = differing(*prints)
    keys = [set(fingerprints.digests([t])[0].tolist()) for t in (a, b)]
    assert (only_a, only_b) == (keys[0] - keys[1], keys[1] - keys[0])
    many = fingerprints.fingerprints(["\n".join(map(str, range(900))), "", "7\nx", "\n".join(map(str, range(5, 905)))])
    assert [len(found) for found in differing(many[0], many[1])] == [900, 0]
    assert [len(found) for found in differing(many[2], many[0])] == [1, 899]
    assert [len(found) for found in differing(many[0], many[3])] == [5, 5]
    with pytest.raises(ValueError, match="too small"):
        fingerprints.differing(fingerprints.Sketches(np.array([1])).texts()[0], _overfull())


def _overfull():
    """A table of three cells that holds ten digests."""
    small = fingerprints.Sketches(np.array([1]))
    small.add(*fingerprints.digests(["\n".join("abcdefghij")]), 1)
    return small.texts()[0]


def test_returned_fingerprints_tell_what_the_row_says(spark, table, corpus):
    """The likeness of a row is that of its fingerprints, found without any text."""
    rows = fingerprint_versions(table(corpus)).collect()
    prints = {}
    for r in rows:
        prints.setdefault(r.doc_id, []).append(r.fingerprint)
        pair = [fingerprints.Sketches.of_texts([t]) for t in (r.fingerprint, r.edited_fingerprint)]
        assert fingerprints.likeness(*pair)[0] == r.near_edited
    ids = sorted((i for i in prints if i is not None and len(prints[i]) == 1), reverse=True)
    near = {r.doc_id: r.near_next for r in rows}
    for a, b in zip(ids, ids[1:]):
        if not any(b < i < a for i in prints if i is not None):
            pair = [fingerprints.Sketches.of_texts(prints[i]) for i in (a, b)]
            assert fingerprints.likeness(*pair)[0] == near[a]
    by_text = {}
    texts = {}
    for i, t, *_ in corpus:
        texts.setdefault(i, t or "")
    for i in ids:
        assert by_text.setdefault(texts[i], prints[i][0]) == prints[i][0]


# --- licenses ---


def test_license_places(table, corpus):
    texts = ["Licensed under CC BY-NC 4.0.", "all rights-reserved ALL  RIGHTS\nRESERVED", "cc by cc by", "",
             "GNU General Public License, version 3", "É general public licenseé", "x cc", "by",
             "// SPDX-License-Identifier: MIT OR (GPL-2.0 WITH Classpath-exception-2.0)\ncode"]
    rows = [(1000 + k, t, "en", "s", 1) for k, t in enumerate(texts)] + corpus
    got = scan_licenses(table(rows)).collect()
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wanted = []
    for doc_id, text, *_ in rows:
        w = pattern.findall(brute.lower(text))
        places = [
            (k, label)
            for phrase, label in licenses.BASE_PHRASES.items()
            for k in range(len(w))
            if w[k : k + len(phrase.split())] == phrase.split()
        ]
        ends = (min(places)[0], max(places)[0]) if places else (None, None)
        wanted.append((doc_id, len(w), len(places), *ends, ",".join(sorted({p[1] for p in places}))))
    assert brute.by_id([tuple(r)[:6] for r in got]) == brute.by_id(wanted)
    by = {r.doc_id: r for r in got}
    assert by[1000].labels == "cc-by,cc-by-nc" and by[1008].labels == "gpl-2.0,mit"
    assert by[1008].freedom == 0.9 and by[1003].score == 0.0
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert scan_licenses(table([])).collect() == []


@pytest.mark.parametrize("text,order", [
    ("MIT", ["mit"]), ("a or b and c", ["a", "b", "c", "and", "or"]), ("(a or b) and c", ["a", "b", "or", "c", "and"]),
    ("a with x and b", ["a", "x", "with", "b", "and"]), ("a or b or c", ["a", "b", "or", "c", "or"]),
    ("a b", None), ("(a", None), ("a)", None), ("or a", None), ("", None), ("()", None), ("a and", None), ("a ; b", None),
])
def test_expressions(text, order):
    assert postfix(text) == order


@pytest.mark.parametrize("line,expression", [
    (": MIT */", "MIT"), (" MIT this file is part of", "MIT"), (": (MIT OR Apache-2.0) AND BSD-3-Clause -->", "(MIT OR Apache-2.0) AND BSD-3-Clause"),
    (":\nMIT is here", ""), ("", ""), (": see below", ""), (": MIT OR", "MIT"), (": (MIT", ""), (": MIT.", "MIT"),
    (": GPL-2.0-only WITH Classpath-exception-2.0;", "GPL-2.0-only WITH Classpath-exception-2.0"), (": GPL-2.0 WITH care", "GPL-2.0"),
    ("\t:\tmit\r\nor gpl", "mit"), (": mitigation", ""), (": MIT) OR GPL", "MIT"), (": Foo-1.0 OR MIT", ""),
])
def test_expressions_behind_tags(line, expression):
    text = f"// SPDX-License-Identifier{line}"
    assert licenses.tagged(text) == ([expression] if expression else [])
    assert not expression or evaluate(expression) is not None


def test_very_long_lines_behind_tags():
    text = "SPDX-License-Identifier: " + "MIT OR " * 100_000 + "MIT" + " (" * 100_000
    assert len(licenses.tagged(text)[0]) == 700_003
    assert licenses.scan_text(text * 2)[5] == "mit"


def test_values_of_expressions():
    assert evaluate("mit or gpl-3.0") == 0.9 and evaluate("mit and gpl-3.0") == 0.3
    assert evaluate("gpl-3.0 with y") == pytest.approx(0.65) and evaluate("mit or") is None
    assert identifiers("MIT OR GPL-2.0 WITH Classpath-exception-2.0") == {"mit", "gpl-2.0"}


# --- pages ---


@pytest.fixture(scope="module")
def trees():
    return extraction.boost(*extraction.made_samples(120))


def test_generated_pages_are_extracted(trees):
    maker, exact = extraction._Maker(77), 0
    for _ in range(60):
        made = maker.page()
        page = extraction.parse(made)
        kept = {e for e, t, _ in page.pieces if extraction.MARK in t}
        wanted = extraction.blocks(page, np.array([k in kept for k in range(len(page.tag))]))
        exact += extraction.extract_text(trees, [made.replace(extraction.MARK, "")])[0] == wanted.replace(extraction.MARK, "")
    assert exact >= 57


def test_choices_never_contradict(trees):
    maker = extraction._Maker(5)
    for _ in range(10):
        page = extraction.parse(maker.page())
        kept = extraction.decode(page, np.random.default_rng(1).normal(size=len(page.tag)))
        assert all(kept[page.parent[k]] or not kept[k] for k in range(1, len(page.tag)))


@pytest.mark.parametrize("source,wanted", [
    ("<article><p>a &lt;b&gt;\n  c&amp;d &am</p><p><b>e<br>f<p>g</article><footer>h</footer>", "a <b> c&d &am\ne f\ng"),
    ("<article><p>x<!-- no --><script>var t='</p>'</script> y</p><style>p{}</style></article>", "x y"),
    ("", ""), ("<nav><ul><li><a href='/'>home</a></li></ul></nav>", ""),
])
def test_markup_cases(trees, source, wanted):
    assert extraction.extract_text(trees, [source])[0] == wanted


def test_pages_table(spark, table):
    table([])
    rows = [(1, "u", "<article><p>one two</p></article>"), (1, "u", "<article><p>one two</p></article>"), (2, None, None), (None, "v", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("x"))
    got = extraction.extract_pages(pages).collect()
    assert brute.by_id([tuple(r) for r in got]) == brute.by_id(
        [(1, "u", "one two", 7), (1, "u", "one two", 7), (2, None, "", 0), (None, "v", "", 0)]
    )
    assert extraction.extract_pages(pages.filter("false")).collect() == []


def test_blocks_fold_white_space():
    page = extraction.parse("<div> a\n<i>b</i><p>c &nbsp; d</p></div>e")
    assert extraction.blocks(page, np.ones(len(page.tag), bool)) == "a b\nc d\ne"
    assert html.unescape("&amp") == "&"


def test_training_takes_all_of_four_thousand_labels(spark, table, monkeypatch):
    rows = [(k, f"word{k % 7} text{k}", "en", "web", 10) for k in range(5000)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(5000)], "doc_id bigint, quality int")
    # The task that trains says what it was given, in place of the model's table.
    def given(batches):
        labels = np.array([label for label, _, _ in quality.training_samples(batches)], "<f4")
        yield pa.RecordBatch.from_arrays([pa.array([labels.tobytes()]), pa.array([0.0])], names=["weights", "bias"])

    monkeypatch.setattr(quality, "_train_in_task", given)
    model = quality.fit(table(rows), labels)
    seen = list(zip(model.table.astype(int).tolist()))
    usable = labels.filter(~quality.held_out(F.col("doc_id"))).count()
    assert len(seen) == usable > 2000
    assert [s[0] for s in seen] == sorted(s[0] for s in seen)


def test_training_does_not_depend_on_how_rows_arrive(spark, table):
    rows = [(k, f"word{k % 7} text{k % 31}", "en", "web", 10) for k in range(60)] + [(99, None, "en", "web", 0)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, quality int")
    one, two = (quality.fit(table(rows, parts), labels) for parts in (1, 5))
    assert (one.table == two.table).all() and one.bias == two.bias and one.table.any()
    assert quality.fit(table(rows), labels.filter("false")).scores(["a", ""]).tolist() == [0.5, 0.5]


def test_training_looks_at_all_of_the_pages_that_tell_their_parts(spark, table):
    table([])
    long = "<article>" + "<p>good text</p>" * 2100 + "</article><footer><p>the end</p></footer>"
    pages = [f"<div><p>plain {k}</p></div>" for k in range(60)] + [f"<p><!--<main>--> {k}</p>" for k in range(20)]
    pages += [f"<MAIN><p>one {k}</p></MAIN><nav><p>menu</p></nav>" for k in range(3)] + [long]
    frame = spark.createDataFrame([(k, "u", h) for k, h in enumerate(pages)], "page_id bigint, url string, html string")
    found = extraction.told_samples(frame, max_pages=4).toArrow().to_batches()
    rows, labels = extraction.read_samples(found)
    wanted = []
    for source in pages[-4:]:
        page = extraction.parse(source)
        good, used = extraction._labels(page, extraction.told_by_markup(page))
        wanted.append(good[used])
    wanted = np.concatenate(wanted)
    assert len(wanted) > 2100
    assert len(rows) == len(labels) == len(wanted)
    assert labels.sum() == wanted.sum()


def test_trees_grown_in_a_task_are_those_grown_here(spark, table, monkeypatch):
    table([])
    pages = [f"<main><p>one {k}</p></main><nav><p>menu</p></nav>" for k in range(5)]
    frame = spark.createDataFrame([(k, "u", h) for k, h in enumerate(pages)], "page_id bigint, url string, html string")
    made = extraction.made_samples(3)
    monkeypatch.setattr(extraction, "made_samples", lambda count: made)
    rows, labels = extraction.read_samples(extraction.told_samples(frame).toArrow().to_batches())
    wanted = extraction.boost(np.concatenate([made[0], rows]), np.concatenate([made[1], labels]))
    got = extraction.fit(frame.repartition(3))
    assert (got.column == wanted.column).all() and (got.above == wanted.above).all()
    assert (got.leaf == wanted.leaf).all() and got.base == wanted.base
