"""Main text of pages: boosted trees over DOM elements, decoded from the root down.

Every element gets the log-odds that it belongs to the article, from features of its own and its
subtree's text density, attribute words, depth and siblings. An element counts as kept only inside
kept ancestors; the set of kept elements is the one of highest total log-odds under that rule, so no
choice contradicts another. The trees are grown in one task, on generated layouts whose parts
are known and on at most ``MAX_PAGES`` pages whose own article or main element tells the parts.

Defined cases: a null page is empty; a page without main text gives the empty string; broken
markup is mended as browsers do in the common cases, and an unclosed comment hides the rest; a
truncated character reference stays as it is; repeated rows are extracted alike; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.llm.boosting import Boosted, boost
from gaugeworks.llm.dom import FEATURES, SIDE_WORDS, Page, blocks, features, parse
from gaugeworks.llm.hashing import slices

MAX_PAGES = 200
MADE_PAGES = 300
MARK = "⁠"  # marks article text in generated pages

_ASIDE_TAGS = frozenset("nav footer aside form".split())


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which elements are kept: the best choice in which kept elements have kept ancestors."""
    gain = odds.copy()
    for k in range(len(gain) - 1, 0, -1):
        gain[page.parent[k]] += max(0.0, gain[k])
    kept = np.zeros(len(gain), bool)
    kept[0] = True
    for k in range(1, len(gain)):
        kept[k] = kept[page.parent[k]] and gain[k] > 0
    return kept


def _labels(page: Page, article_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per element whether its subtree holds article text; and whether it has any text at all."""
    good, any_text = np.zeros(len(page.tag), bool), np.zeros(len(page.tag), bool)
    for (element, text, _), keep in zip(page.pieces, article_text):
        if text.strip():
            good[element] |= keep
            any_text[element] = True
    for k in range(len(page.tag) - 1, 0, -1):
        good[page.parent[k]] |= good[k]
        any_text[page.parent[k]] |= any_text[k]
    return good, any_text


def told_by_markup(page: Page) -> np.ndarray | None:
    """Article text of a page with one article or main element; None without."""
    inside = np.zeros(len(page.tag), np.int64)
    found = 0
    for k in range(1, len(page.tag)):
        inside[k] = inside[page.parent[k]]
        if page.tag[k] in ("article", "main"):
            found += 1
            inside[k] = max(inside[k], 1)
        elif page.tag[k] in _ASIDE_TAGS or any(w in SIDE_WORDS for w in page.words[k]):
            inside[k] = -1
    if not found:
        return None
    return np.array([inside[element] > 0 for element, _, _ in page.pieces], bool)


# --- generated pages -----------------------------------------------------------------------------


class _Maker:
    """Writes pages of varied layout; article text carries MARK."""

    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def text(self, low: int, high: int, mark: bool = False) -> str:
        r = self.random
        words = ["".join(r.choices(("ta", "re", "on", "mi", "el", "su", "ka", "no"), k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for k in range(7, len(words), 9):
            words[k] += r.choice(".,.")
        return (MARK if mark else "") + " ".join(words).capitalize() + "."

    def items(self, count: int, tag: str = "ul") -> str:
        body = "".join(f'<li><a href="/x">{self.text(1, 4)}</a></li>' for _ in range(count))
        return f"<{tag}>{body}</{tag}>"

    def named(self, *words: str) -> str:
        r = self.random
        word = r.choice(words)
        if r.random() < 0.3:
            word = r.choice(("site-", "main-", "page-", "b-")).replace("main-", "x-") + word
        return f'{r.choice(("class", "class", "id"))}="{word}"'

    def article(self) -> str:
        r = self.random
        parts = [f"<h1>{self.text(3, 9, True)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.72:
                inner = self.text(3, 90, True)
                if r.random() < 0.3:
                    inner += f' <a href="/y">{self.text(1, 4, True)}</a> {self.text(2, 20, True)}'
                if r.random() < 0.15:
                    inner = f"<b>{inner}<br>" if r.random() < 0.5 else f"<b>{inner}</b>"
                tag = "div" if r.random() < 0.08 else "p"
                parts.append(f"<{tag}>{inner}</{tag}>")
            elif kind < 0.8:
                parts.append(f"<h2>{self.text(2, 7, True)}</h2>")
            elif kind < 0.86:
                lines = "".join(f"<li>{self.text(2, 15, True)}</li>" for _ in range(r.randint(2, 6)))
                parts.append(f"<ul>{lines}</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{self.text(5, 40, True)}</p></blockquote>")
            elif kind < 0.93:
                cells = "".join(f"<td>{self.text(1, 5, True)}</td>" for _ in range(r.randint(2, 5)))
                parts.append(f"<table><tr>{cells}</tr></table>")
            else:
                parts.append(self.aside())
        return "".join(parts)

    def aside(self) -> str:
        r = self.random
        kind = r.randrange(6)
        if kind == 0:
            return f'<div {self.named("ad", "ads", "advert", "promo", "sponsored", "banner")}>{self.text(3, 40)}</div>'
        if kind == 1:
            return f'<div {self.named("related", "recommended", "share", "social", "tags")}>{self.items(r.randint(2, 6))}</div>'
        if kind == 2:
            return f'<form action="/s" {self.named("search", "newsletter", "subscribe", "login")}><label>{self.text(1, 5)}</label><input name="q"><p>{self.text(2, 12)}</p></form>'
        if kind == 3:
            return f'<aside {self.named("sidebar", "widget", "toc")}><h3>{self.text(1, 3)}</h3><p>{self.text(5, 40)}</p>{self.items(r.randint(1, 6))}</aside>'
        if kind == 4:
            return f'<div {self.named("notice", "cookie", "consent", "alert", "popup")}><p>{self.text(5, 30)}</p></div>'
        return f'<div {self.named("byline", "author", "meta", "breadcrumb")}>{self.text(2, 8)}</div>'

    def comments(self) -> str:
        r = self.random
        one = lambda: f'<div class="comment"><b>{self.text(1, 2)}</b><p>{self.text(4, 60)}</p></div>'
        if r.random() < 0.4:
            one = lambda: f"<li><p>{self.text(4, 60)}</p></li>"
        body = "".join(one() for _ in range(r.randint(1, 7)))
        tag = r.choice(("section", "div", "ol"))
        return f'<{tag} {self.named("comments", "replies", "respond", "disqus")}><h3>{self.text(1, 3)}</h3>{body}</{tag}>'

    def page(self) -> str:
        r = self.random
        chance = lambda p, made: made() if r.random() < p else ""
        opening, closing = r.choice(
            [
                ("<article>", "</article>"),
                ("<main>", "</main>"),
                ("<main><article>", "</article></main>"),
                (f'<div {self.named("content", "post", "entry", "story", "article")}>', "</div>"),
                (f'<div {self.named("content", "main", "body")}><div>', "</div></div>"),
                ("<div>", "</div>"),
                ("<section>", "</section>"),
                ("<table><tr><td>", "</td></tr></table>"),
            ]
        )
        menu = lambda: f"<nav>{self.items(r.randint(3, 9))}</nav>"
        div_menu = lambda: f'<div {self.named("menu", "nav", "navbar", "toolbar")}>{self.items(r.randint(3, 9))}</div>'
        head = lambda: f"<header><p>{self.text(1, 8)}</p>{chance(0.5, menu)}</header>"
        div_head = lambda: f'<div {self.named("header", "masthead", "topbar")}><h2>{self.text(1, 4)}</h2></div>'
        foot = lambda: f"<footer>&copy; {self.text(2, 25)}{chance(0.3, lambda: self.items(4))}</footer>"
        div_foot = lambda: f'<div {self.named("footer", "copyright", "legal")}><p>{self.text(3, 30)}</p></div>'
        side = lambda: f'<div {self.named("sidebar", "widget")}><p>{self.text(4, 50)}</p>{self.items(r.randint(2, 7))}</div>'
        inner_comments = r.random() < 0.3
        wide = r.random() < 0.4
        return (
            "<html><body>"
            + ("<div id=\"wrap\">" if wide else "")
            + chance(0.5, head) + chance(0.3, div_head) + chance(0.5, menu) + chance(0.3, div_menu)
            + chance(0.6, self.aside) + chance(0.3, side)
            + opening + self.article() + (self.comments() if inner_comments else "") + closing
            + chance(0.4, self.aside) + chance(0.35, self.comments) + chance(0.3, side)
            + chance(0.3, self.aside) + chance(0.6, foot) + chance(0.35, div_foot)
            + ("</div>" if wide else "")
            + "</body></html>"
        )


def made_samples(count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements of generated pages."""
    maker = _Maker(seed)
    rows, labels = [], []
    for _ in range(count):
        page = parse(maker.page())
        good, used = _labels(page, np.array([MARK in text for _, text, _ in page.pieces], bool))
        page.pieces = [(e, t.replace(MARK, ""), b) for e, t, b in page.pieces]
        rows.append(features(page)[used])
        labels.append(good[used])
    return np.concatenate(rows), np.concatenate(labels).astype(float)


def _told_samples(batches):
    for batch in batches:
        rows, labels = [], []
        for source in batch.column("html").to_pylist():
            page = parse(source or "")
            told = told_by_markup(page)
            if told is None or not told.any():
                continue
            good, used = _labels(page, told)
            rows.append(features(page)[used].astype("<f4").tobytes())
            labels.append(good[used].astype("u1").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.binary()), pa.array(labels, pa.binary())], names=["rows", "labels"]
        )


def _told_column(html: Column) -> Column:
    """Whether a page's own markup tells its article, as an Arrow batch function."""

    @F.arrow_udf("boolean")
    def tells(column: pa.Array) -> pa.Array:
        told = (told_by_markup(parse(source or "")) for source in column.to_pylist())
        return pa.array([t is not None and bool(t.any()) for t in told], pa.bool_())

    return tells(html)


def told_samples(pages: DataFrame, html_col: str = "html", max_pages: int = MAX_PAGES) -> DataFrame:
    """Features and labels of all elements of at most ``max_pages`` pages that tell their parts.

    Only pages with such a tag somewhere are parsed to choose.
    """
    source = F.col(html_col).alias("html")
    chosen = pages.select(source, F.xxhash64(html_col).alias("hash")).dropna()
    chosen = chosen.filter(F.col("html").rlike("(?i)<(article|main)")).filter(_told_column(F.col("html")))
    told = chosen.orderBy("hash", "html").limit(max_pages).select("html")
    return told.mapInArrow(_told_samples, "rows binary, labels binary")


def read_samples(batches) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``told_samples`` as arrays, in an order that does not depend on how they arrive."""
    found = sorted(pair for batch in batches for pair in zip(*(c.to_pylist() for c in batch.columns)))
    rows = [np.frombuffer(r, "<f4").reshape(-1, FEATURES) for r, _ in found]
    labels = [np.frombuffer(m, "u1").astype(float) for _, m in found]
    return np.concatenate([np.zeros((0, FEATURES)), *rows]), np.concatenate([np.zeros(0), *labels])


_FIELDS = (("column", "<i8"), ("above", "<f8"), ("leaf", "<f8"))


def fit(pages: DataFrame, html_col: str = "html", max_pages: int = MAX_PAGES) -> Boosted:
    """Trees from generated pages and from ``told_samples``, grown in one task.

    The task holds the elements of ``max_pages`` pages; only the trees reach the driver.
    """
    made_rows, made_labels = made_samples(MADE_PAGES)

    def grow(batches):
        rows, labels = read_samples(batches)
        model = boost(np.concatenate([made_rows, rows]), np.concatenate([made_labels, labels]))
        parts = [np.ascontiguousarray(getattr(model, name), kind).tobytes() for name, kind in _FIELDS]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([part], pa.binary()) for part in parts), pa.array([len(model.column)]), pa.array([model.base])],
            names=[*(name for name, _ in _FIELDS), "trees", "base"],
        )

    schema = "column binary, above binary, leaf binary, trees bigint, base double"
    row = told_samples(pages, html_col, max_pages).repartition(1).mapInArrow(grow, schema).first()
    parts = (np.frombuffer(row[name], kind).reshape(row.trees, -1) for name, kind in _FIELDS)
    return Boosted(*parts, row.base)


def extract_text(model: Boosted, sources: list[str]) -> list[str]:
    """The main text of each page."""
    parsed = [parse(source) for source in sources]
    if not parsed:
        return []
    odds = model.log_odds(np.concatenate([features(page) for page in parsed]))
    ends = np.cumsum([len(page.tag) for page in parsed])[:-1]
    return [blocks(page, decode(page, part)) for page, part in zip(parsed, np.split(odds, ends))]


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, text and n_chars of every page; one pass without a shuffle after fitting."""
    model = fit(pages, html_col)

    def extract(batches):
        for batch in slices(batches, "html"):
            texts = extract_text(model, [h or "" for h in batch.column("html").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    slim = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
    )
    return slim.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
