"""License scans: an automaton finds tags and notice phrases, expressions are evaluated.

Texts are lower-cased (A-Z only) and reduced to words of letters, digits and non-ASCII
characters. One Aho-Corasick automaton over the words finds all phrases, overlapping ones included,
and another one over the text finds identifier tags. Behind a tag, on its line, the longest well-formed
expression of known identifiers is taken, so that a comment's end or prose behind it is no part of
it. It is parsed by the shunting-yard method (``with`` binds tighter than ``and``, ``and`` tighter than ``or``) and evaluated:
an ``or`` is as permissive as its best side, an ``and`` as its worst, and an exception lifts its
license half of the way to free use.

``score`` is the evidence for a license notice: 0 without any, otherwise one minus the product
of what each different label leaves open.

Defined cases: a null text is empty; texts without words or phrases have no labels, empty strings
and score 0; a tag without a known identifier on its line gives no label and no value; very long
lines are read once; repeated rows are scanned alike; a null id is kept; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeworks.llm.hashing import slices

# The base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Further notice phrases and their labels.
PHRASES = {
    "affero general public license": "agpl",
    "apache license": "apache",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "free documentation license": "gfdl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd",
    "unlicense": "unlicense",
    "zlib license": "zlib",
}

# How freely works under a license may be used, by the start of its identifier.
FREEDOM = {
    "agpl": 0.2,
    "apache": 0.9,
    "artistic": 0.7,
    "bsd": 0.9,
    "bsl": 0.9,
    "cc-by": 0.8,
    "cc-by-nc": 0.3,
    "cc-by-nd": 0.3,
    "cc-by-sa": 0.6,
    "cc0": 1.0,
    "epl": 0.6,
    "eupl": 0.5,
    "gfdl": 0.4,
    "gpl": 0.3,
    "isc": 0.9,
    "lgpl": 0.5,
    "mit": 0.9,
    "mpl": 0.6,
    "public-domain": 1.0,
    "reserved": 0.0,
    "unlicense": 1.0,
    "zlib": 0.9,
}

# Fixed value: the identifier tag, as it stands in a text and as words.
TAG = "spdx-license-identifier"
TAG_WORDS = "spdx license identifier"
PHRASE_EVIDENCE, TAG_EVIDENCE = 0.7, 0.95

_BEHIND_TAG = re.compile(r"[ \t]*:?")
_ON_LINE = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
_BINDING = {"or": 1, "and": 2, "with": 3}
_TO_WORDS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    """The words of a text, lower-cased."""
    return text.encode("utf-8").lower().translate(_TO_WORDS).split()


@lru_cache(maxsize=1)
def automaton():
    """The automaton over all phrases, each between spaces; built once per worker."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {**BASE_PHRASES, **PHRASES, TAG_WORDS: None}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def tag_automaton():
    """The automaton that finds identifier tags in lower-cased text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word(TAG, TAG)
    found.make_automaton()
    return found


def places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word, phrase) of every place where a phrase's words stand consecutively, in order."""
    line = b" " + b" ".join(words) + b" "
    text = line.decode("utf-8")
    hits = sorted((end - len(phrase) - 1, phrase) for end, phrase in automaton().iter(text))
    out, word, at = [], 0, 0
    for start, phrase in hits:
        word += text.count(" ", at, start)
        at = start
        out.append((word, phrase))
    return out


def postfix(expression: str) -> list[str] | None:
    """A license expression in postfix order, or None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand_next, at = True, 0
    expression = expression.strip()
    while at < len(expression):
        token = _TOKEN.match(expression, at)
        if not token:
            return None
        at, name = token.end(), token[1].lower()
        if name == "(":
            if not operand_next:
                return None
            stack.append(name)
        elif name == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif name in _BINDING:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _BINDING[stack[-1]] >= _BINDING[name]:
                out.append(stack.pop())
            stack.append(name)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(name)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def _family(identifier: str) -> str | None:
    """The longest known name an identifier is or starts with, as in ``gpl`` of ``gpl-2.0-only``."""
    known = [n for n in FREEDOM if identifier == n or re.match(rf"{re.escape(n)}[-+0-9]", identifier)]
    return max(known, key=len, default=None)


def _freedom(identifier: str) -> float:
    return FREEDOM.get(_family(identifier), 0.5)


def expression_at(text: str, at: int) -> str:
    """The longest well-formed expression of known identifiers from a place on, on its line."""
    start = best = at = _BEHIND_TAG.match(text, at).end()
    depth, operand_next, before = 0, True, ""
    while token := _ON_LINE.match(text, at):
        name = token[1].rstrip(".:-").lower() or token[1]
        if name == "(":
            if not operand_next or before == "with":
                break
            depth += 1
        elif name == ")":
            if operand_next or not depth:
                break
            depth -= 1
        elif name in _BINDING:
            if operand_next:
                break
            operand_next = True
        elif operand_next and ("exception" in name if before == "with" else _family(name)):
            operand_next = False
        else:
            break
        at = token.start(1) + len(name)
        before = name
        if not operand_next and not depth:
            best = at
    return text[start:best].strip()


def tagged(text: str) -> list[str]:
    """The expressions behind all identifier tags of a text."""
    lowered = text.translate(_LOWER)
    found = (expression_at(text, end + 1) for end, _ in tag_automaton().iter(lowered))
    return [expression for expression in found if expression]


def evaluate(expression: str) -> float | None:
    """How freely a work under a license expression may be used, from 0 to 1."""
    order = postfix(expression)
    if order is None:
        return None
    values: list[float] = []
    for name in order:
        if name in _BINDING:
            right, left = values.pop(), values.pop()
            combined = {
                "or": max(left, right),
                "and": min(left, right),
                "with": left + (1 - left) / 2,
            }
            values.append(combined[name])
        else:
            values.append(_freedom(name))
    return values[0]


def identifiers(expression: str) -> set[str]:
    """License identifiers of an expression; what follows ``with`` is an exception, not a license."""
    names = [t[1].lower() for t in _TOKEN.finditer(expression) if t[1] not in "()"]
    return {
        name
        for before, name in zip(["", *names], names)
        if name not in _BINDING and before != "with"
    }


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double, freedom double"
)


def scan_text(text: str) -> tuple:
    """The scan of one text, in the order of SCHEMA after doc_id."""
    words = words_of(text)
    found = places(words)
    base = [(word, BASE_PHRASES[phrase]) for word, phrase in found if phrase in BASE_PHRASES]
    evidence: dict[str, float] = {}
    for _, phrase in found:
        label = BASE_PHRASES.get(phrase) or PHRASES.get(phrase)
        if label:
            evidence[label] = PHRASE_EVIDENCE
    values = []
    if any(phrase == TAG_WORDS for _, phrase in found):
        for expression in tagged(text):
            values.append(evaluate(expression))
            evidence.update(dict.fromkeys(identifiers(expression), TAG_EVIDENCE))
    open_ = 1.0
    for weight in evidence.values():
        open_ *= 1 - weight
    return (
        len(words),
        len(base),
        base[0][0] if base else None,
        base[-1][0] if base else None,
        ",".join(sorted({label for _, label in base})),
        ",".join(sorted(evidence)),
        1 - open_ if evidence else 0.0,
        min(values) if values else None,
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License places and labels of every document, in one pass without a shuffle.

    ``freedom`` is the least value of the document's tagged expressions, null without one.
    """

    def scan(batches):
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] * 2
        for batch in slices(batches, "text"):
            rows = [scan_text(text or "") for text in batch.column("text").to_pylist()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(scan, SCHEMA)
