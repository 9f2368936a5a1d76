"""A small DOM of a page: elements with their text, and what a classifier may know about each."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass, field

import numpy as np

# Element kinds of the HTML standard.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset(
    "button datalist head iframe noscript object option script select style svg template textarea "
    "title".split()
)
RAW = frozenset("script style textarea title".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("article body button div form html main section table td th ul ol dl".split())

# Words in class, id and role attributes that tell what a part of a page is.
MAIN_WORDS = frozenset("article articlebody body content entry main post prose story text".split())
SIDE_WORDS = frozenset(
    "ad ads advert advertisement alert aside author banner breadcrumb breadcrumbs byline comment "
    "comments consent cookie cookies copyright disqus footer form gdpr header legal links login "
    "masthead menu meta modal nav navbar navigation newsletter notice pagination pager popup promo "
    "promoted recommended related reply replies respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe tags teaser toc toolbar topbar widget".split()
)
TAG_KINDS = {
    **dict.fromkeys("p blockquote pre figcaption".split(), 1),
    **dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), 2),
    **dict.fromkeys("ul ol dl menu".split(), 3),
    **dict.fromkeys("li dt dd".split(), 4),
    **dict.fromkeys("table tbody thead tr td th".split(), 5),
    **dict.fromkeys("article main".split(), 6),
    **dict.fromkeys("nav footer header aside".split(), 7),
    **dict.fromkeys("form fieldset label input button dialog".split(), 8),
    **dict.fromkeys("div section body html".split(), 9),
    **dict.fromkeys("a b i em strong span small code".split(), 10),
}

_TAG_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
# Possessive: what is read once is not tried again.
_TAG_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NAMED = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Page:
    """Elements in page order (0 is the root) and text pieces as (element, text, block)."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    words: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    pieces: list[tuple[int, str, int]] = field(default_factory=list)


class _Marks:
    """Comments, declarations and tags of a page, in one pass forward.

    A tag whose quotes are never closed would be read to the end of the page in vain. From the
    first such tag on, tags end at the next ``>``, quoted or not, so that no part of a page is read
    more than a few times however it is broken.
    """

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.quotes = True

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """The next mark: start, end, name ('' if none), whether it closes, and attributes."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            at = start + 1
            if source.startswith("!--", at):
                end = source.find("-->", at + 3)
                return start, len(source) if end < 0 else end + 3, "", False, ""
            if start > self.last:
                continue  # nothing that is closed by > starts here
            if source.startswith(("!", "?"), at):
                return start, source.index(">", at) + 1, "", False, ""
            if name := _TAG_NAME.match(source, at):
                end = self._end(name.end())
                attributes = source[name.end() : end - 1]
                return start, end, name[1].lower(), source[at] == "/", attributes
        return None

    def _end(self, at: int) -> int:
        if self.quotes:
            if rest := _TAG_REST.match(self.source, at):
                return rest.end()
            self.quotes = False
        return self.source.index(">", at) + 1


class _Open:
    """The open elements, and where those of each tag are on the stack."""

    def __init__(self, page: Page):
        self.page = page
        self.stack = [0]
        self.depths: dict[str, list[int]] = {}
        self.scopes = [0]
        self.unseen = 0

    def push(self, number: int) -> None:
        tag = self.page.tag[number]
        self.depths.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(number)
        self.unseen += tag in UNSEEN

    def cut(self, depth: int) -> None:
        """Close the element at ``depth`` and all in it."""
        while len(self.stack) > depth:
            tag = self.page.tag[self.stack.pop()]
            self.depths[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
            self.unseen -= tag in UNSEEN

    def innermost(self, tag: str) -> int:
        """The depth of the innermost open element of a tag, 0 if there is none."""
        depths = self.depths.get(tag)
        return depths[-1] if depths else 0


def parse(source: str) -> Page:
    """Elements and text of a page; broken nesting is mended as browsers do in the common cases.

    The time is linear in the length of the page, well-formed or not.
    """
    page, block, at = Page(), 0, 0
    marks, opened = _Marks(source), _Open(page)
    while mark := marks.after(at):
        start, end, name, closes, attributes = mark
        if start > at and not opened.unseen:
            page.pieces.append((opened.stack[-1], source[at:start], block))
        at = end
        if not name:
            continue
        if closes:
            if depth := opened.innermost(name):
                opened.cut(depth)
            block += name in BLOCK
            continue
        closing = CLOSED_BY.get(name, set()) | ({"p"} if name in BLOCK else set())
        depth = max(map(opened.innermost, closing), default=0)
        if depth and depth >= opened.scopes[-1]:
            opened.cut(depth)
        block += name in BLOCK
        if name == "br" and not opened.unseen:
            page.pieces.append((opened.stack[-1], " ", block))
        number = len(page.tag)
        page.tag.append(name)
        page.parent.append(opened.stack[-1])
        found = [a or b or c for a, b, c in _NAMED.findall(attributes)] if attributes else []
        page.words.append(tuple(_WORD.findall(_CAMEL.sub(" ", " ".join(found)).lower())))
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b", re.I).search(source, at)
            end = source.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else len(source)
            continue
        opened.push(number)
    if at < len(source) and not opened.unseen:
        page.pieces.append((opened.stack[-1], source[at:], block))
    return page


FEATURES = 34


def features(page: Page) -> np.ndarray:
    """One row per element: density, attribute words, depth and sibling statistics."""
    count = len(page.tag)
    parent = np.array(page.parent)
    own = np.zeros(count)
    linked = np.zeros(count)
    stops = np.zeros(count)
    in_link = np.zeros(count, bool)
    for k in range(1, count):
        in_link[k] = page.tag[k] == "a" or in_link[parent[k]]
    for element, text, _ in page.pieces:
        size = len(text.strip())
        own[element] += size
        linked[element] += size * in_link[element]
        stops[element] += text.count(".") + text.count(",")
    kinds = np.array([TAG_KINDS.get(t, 0) for t in page.tag])
    main = np.array([any(w in MAIN_WORDS for w in ws) for ws in page.words])
    side = np.array([any(w in SIDE_WORDS for w in ws) for ws in page.words])
    inner = np.ones(count)
    text, links, dots = own.copy(), linked.copy(), stops.copy()
    paragraphs, inputs = (kinds == 1).astype(float), (kinds == 8).astype(float)
    anchors = np.array([t == "a" for t in page.tag], float)
    children = np.zeros(count)
    for k in range(count - 1, 0, -1):
        up = parent[k]
        for values in (inner, text, links, dots, paragraphs, inputs, anchors):
            values[up] += values[k]
        children[up] += 1
    depth = np.zeros(count)
    above_main, above_side = main.copy(), side.copy()
    in_article, in_side = kinds == 6, kinds == 7
    in_form, in_list = kinds == 8, (kinds == 3) | (kinds == 4)
    place = np.zeros(count)
    seen = np.zeros(count)
    for k in range(1, count):
        up = parent[k]
        depth[k] = depth[up] + 1
        place[k] = seen[up]
        seen[up] += 1
        for flags in (above_main, above_side, in_article, in_side, in_form, in_list):
            flags[k] |= flags[up]
    up = np.maximum(parent, 0)
    whole = max(1.0, text[0])
    siblings = np.maximum(children[up], 1)
    hashed = np.zeros((count, 8))
    for k, ws in enumerate(page.words):
        for w in ws:
            hashed[k, zlib.crc32(w.encode()) % 8] = 1
    return np.column_stack(
        [
            depth, kinds, own, text, text / inner, text / whole, links / np.maximum(text, 1),
            dots / np.maximum(text, 1), inner, children, siblings, place / siblings,
            np.arange(count) / count, text[up], text / np.maximum(text[up], 1),
            text[up] / siblings, main, side, above_main, above_side, in_article, in_side, in_form,
            in_list, paragraphs, anchors / inner, hashed,
        ]
    )


def blocks(page: Page, kept: np.ndarray) -> str:
    """The text of the kept elements: a line per block, white space folded."""
    lines: list[str] = []
    current, parts = None, []
    for element, text, block in [*page.pieces, (0, "", -1)]:
        if block != current:
            line = " ".join(html.unescape("".join(parts)).split())
            if line:
                lines.append(line)
            current, parts = block, []
        if kept[element]:
            parts.append(text)
    return "\n".join(lines)
