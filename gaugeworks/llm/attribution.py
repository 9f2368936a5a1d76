"""Token counts of sections: whole texts are encoded once, tokens go to sections by their span.

A byte-level tokenizer loses nothing, so the byte lengths of a text's tokens give the span of each
token. Sections are intervals of the text; tokens and sections are both in order, so joining them
is one binary search per token. A token that crosses into further sections is allocated by a
named rule: ``start`` gives it to the section of its first byte, ``end`` to that of its last,
``most`` to the one that holds most of its bytes (the earlier one if equal). Every token goes to
exactly one section, so sections add up to the text.

Defined cases: a null or empty text is one empty section without tokens; a text that ends with a
newline has no further section after it; a null id is kept; repeated rows are counted each; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeworks.llm.hashing import slices

RULES = ("start", "end", "most")

# Fixed value: how the vocabulary splits text before merging.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

SCHEMA = (
    "doc_id bigint, section bigint, first_char bigint, n_chars bigint, n_tokens bigint, "
    "n_crossing bigint"
)


class ByteEncoder:
    """A byte-level encoding from a rank file, and the byte length of each id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {
                base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)
            }
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def ends(self, text: str) -> np.ndarray:
        """Where each token of a text ends, in bytes."""
        return np.cumsum(self.sizes[self.encoding.encode_ordinary(text)])


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder per worker process and rank file."""
    return ByteEncoder(path)


def line_starts(data: bytes) -> np.ndarray:
    """Byte positions where the lines of a text start; a line includes its newline."""
    after = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.concatenate([[0], after[after < len(data)]]).astype(np.int64)


def allocate(token_ends: np.ndarray, starts: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and tokens per section that cross out of the section they begin in.

    ``starts`` are the ascending first bytes of the sections; the first one is 0.
    """
    first = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    begin = np.searchsorted(starts, first, "right") - 1
    end = np.searchsorted(starts, token_ends - 1, "right") - 1
    crossing = begin != end
    if rule == "start":
        section = begin
    elif rule == "end":
        section = end
    elif rule == "most":
        section = begin.copy()
        for k in np.flatnonzero(crossing):
            inside = np.arange(begin[k], end[k] + 1)
            edges = np.append(starts[inside[1:]], token_ends[k])
            shares = np.diff(np.concatenate([[first[k]], edges]))
            section[k] = inside[shares.argmax()]
    else:
        raise ValueError(f"the rule must be one of {RULES}")
    count = len(starts)
    return np.bincount(section, minlength=count), np.bincount(begin[crossing], minlength=count)


def section_tokens(
    docs: DataFrame,
    ranks: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    rule: str = "start",
) -> DataFrame:
    """One row per line of each text: its place, size and tokens; one pass without a shuffle."""
    if rule not in RULES:
        raise ValueError(f"the rule must be one of {RULES}")

    def count(batches):
        encoder = byte_encoder(ranks)
        for batch in slices(batches, "text"):
            parts = []
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            owners = []
            for doc_id, text in rows:
                text = text or ""
                data = text.encode("utf-8")
                starts = line_starts(data)
                tokens, crossing = allocate(encoder.ends(text), starts, rule)
                # Bytes that begin a character, counted up to each section.
                begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
                chars = np.concatenate([[0], np.cumsum(begins)])
                first = chars[starts]
                size = np.diff(np.append(first, len(text)))
                parts.append((np.arange(len(starts)), first, size, tokens, crossing))
                owners += [doc_id] * len(starts)
            columns = [np.concatenate(c) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)],
                names=[part.split()[0] for part in SCHEMA.split(", ")],
            )

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(count, SCHEMA)
