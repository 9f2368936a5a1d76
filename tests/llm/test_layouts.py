"""Extraction on layouts that the generator of training pages does not make, and broken pages."""

import random
import time

import brute
import pytest

from gaugeworks.llm import dom, extraction


@pytest.fixture(scope="module")
def trees():
    return extraction.boost(*extraction.made_samples(120))


def prose(rng, count):
    return ". ".join(brute.sentence(rng, rng.randint(8, 16)).capitalize() for _ in range(count)) + "."


def links(rng, count):
    return "".join(f"<li><a href='/{k}'>{brute.sentence(rng, 2)}</a></li>" for k in range(count))


def blog(rng, body):
    """No article element; everything in divisions with names of another language."""
    inner = "".join(f"<div class='absatz'>{p}</div>" for p in body)
    return (
        f"<div id='kopf'><ul>{links(rng, 6)}</ul></div><div id='inhalt'><h1>{body[0][:30]}</h1>{inner}</div>"
        f"<div id='fuss'><ul>{links(rng, 9)}</ul></div>"
    )


def news(rng, body):
    """Comments of readers and an advert within the article."""
    inner = "".join(f"<p>{p}</p>" for p in body)
    ad = f"<div class='ad-slot'><a href='/buy'>{brute.sentence(rng, 4)}</a></div>"
    said = "".join(f"<div class='comment'><b>user{k}</b><p>{brute.sentence(rng, 7)}</p></div>" for k in range(4))
    return f"<nav><ul>{links(rng, 8)}</ul></nav><article>{inner}{ad}<section class='comments'>{said}</section></article>"


def table_page(rng, body):
    """A page of the old kind: columns in a table, no classes at all."""
    inner = "<br><br>".join(body)
    return (
        f"<table><tr><td><ul>{links(rng, 10)}</ul></td><td>{inner}</td>"
        f"<td><form><input><button>go</button></form><ul>{links(rng, 5)}</ul></td></tr></table>"
    )


def docs_page(rng, body):
    """A manual: a section per heading, a table of contents beside it."""
    inner = "".join(f"<section><h2>{brute.sentence(rng, 3)}</h2><p>{p}</p></section>" for p in body)
    return f"<aside class='toc'><ul>{links(rng, 12)}</ul></aside><main>{inner}</main><footer>{brute.sentence(rng, 9)}</footer>"


def spans(rng, body):
    """Deep nesting with meaningless class names."""
    inner = "".join(f"<div class='x{k}q'><div><span>{p}</span></div></div>" for k, p in enumerate(body))
    return f"<div class='a1'><div class='b2'><ul>{links(rng, 7)}</ul></div><div class='c3'>{inner}</div></div>"


LAYOUTS = [blog, news, table_page, docs_page, spans]


def measured(trees, layout, pages=12):
    """Share of the extracted words that belong, and of those that belong and are extracted."""
    rng, hits, given, wanted = random.Random(layout.__name__), 0, 0, 0
    for _ in range(pages):
        body = [prose(rng, rng.randint(2, 5)) for _ in range(rng.randint(3, 8))]
        got = extraction.extract_text(trees, [f"<html><body>{layout(rng, body)}</body></html>"])[0]
        good, found = " ".join(body).split(), got.split()
        left = {}
        for word in good:
            left[word] = left.get(word, 0) + 1
        for word in found:
            if left.get(word):
                left[word] -= 1
                hits += 1
        given += len(found)
        wanted += len(good)
    return hits / max(1, given), hits / wanted


@pytest.mark.parametrize("layout", LAYOUTS, ids=lambda f: f.__name__)
def test_unseen_layouts(trees, layout):
    precision, recall = measured(trees, layout)
    print(layout.__name__, round(precision, 3), round(recall, 3))
    assert precision > 0.8 and recall > 0.95


BROKEN = ["<a ", "<b>", "<b><p>", '<a "', "<a '>", '<a ">" ', "<!", "<?", "</script", "<li>", "<div><p>", "<table><td>", "</b"]


@pytest.mark.parametrize("unit", BROKEN)
def test_broken_pages_take_linear_time(unit):
    took = []
    for size in (1 << 17, 1 << 20):
        start = time.perf_counter()
        dom.parse(unit * (size // len(unit)))
        took.append(time.perf_counter() - start)
    # Eight times the page; a quadratic parser would take 64 times as long.
    assert took[1] < max(0.5, 24 * took[0])


def test_a_tag_that_never_ends_is_text():
    page = dom.parse("<p>one</p> two < three <a href='x")
    assert "".join(text for _, text, _ in page.pieces) == "one two < three <a href='x"
    page = dom.parse("<p title='a>b'>c</p><q x='>d")
    assert [text for _, text, _ in page.pieces] == ["c", "d"]
