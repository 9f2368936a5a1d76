"""Token ids of whole texts, with a bounded cache of encoded words per worker."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from gaugeworks.llm.hashing import Words

CACHE_WORDS = 500_000
RUN_WORDS = 2000
END_ID = 2

# Punctuation other than apostrophes: behind an ASCII letter at the end of a word, the tokenizer's
# own pattern always parts it from the word.
_TAIL = rb"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
_MARK = b"0"
# How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {chr(b): b for b in _PRINTABLE}
_BYTES.update({chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))})
_PLAIN_LIMIT = "\u0180"  # below it, letters need no composing and lower-case one by one


def _token_bytes(token: str, suffix: str) -> bytes:
    """The bytes a token stands for, with a zero byte for the end of a word."""
    ends = token.endswith(suffix)
    core = token.removesuffix(suffix) if ends else token
    return bytes(_BYTES[c] for c in core) + (b"\0" if ends else b"")


class WordEncoder:
    """Ids of a lower-casing word BPE whose tokens never span white space.

    Such a tokenizer encodes a text as the concatenation of its words' encodings, so each
    different word is encoded once while it is in a table (of about ``CACHE_WORDS``, or of the words
    of one call). Words are looked up by 64-bit names, all words of a call at once.
    Ids are little-endian 16-bit numbers; the vocabulary must be smaller than 2**16.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        # The known words by name, ascending: where their ids begin in ``flat``, and how many.
        self.names = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u2")
        self.cache: dict[bytes, bytes] = {}
        self.mark = self._ids(_MARK)
        if len(self.mark) != 1:
            raise ValueError("a digit must be a token of its own")
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        special = {token.content for token in self.tokenizer.get_added_tokens_decoder().values()}
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        ranks = {}
        for token, number in vocabulary.items():
            self.ends_word[number] = token.endswith(suffix)
            if token not in special:
                ranks[_token_bytes(token, suffix)] = number
        # The same merges for words of plain letters, which need neither composing nor parting, by a
        # faster library. Ids rise in the order of the merges, so they serve as its ranks; the end
        # of a word, which marks tokens of their own, is a byte that no such word holds.
        self.plain = tiktoken.Encoding(
            "words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={}
        )

    def _ids(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """16-bit ids of each UTF-8 text."""
        ids, first = self.encode_column(pa.array(texts, pa.binary()))
        return [part.tobytes() for part in np.split(ids, first[1:-1])] if texts else []

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end; those of text ``d`` are ``ids[first[d]:first[d + 1]]``."""
        # Only ASCII white space separates words here; other white space is left to the tokenizer.
        words = Words(column, lower=True)
        different, example, which = np.unique(words.name, return_index=True, return_inverse=True)
        row = self._rows(different)
        missing = np.flatnonzero(row < 0)
        if len(missing):
            data, at = words.data.tobytes(), example[missing]
            places = zip(words.start[at].tolist(), words.end[at].tolist())
            self._remember(different[missing], [data[start:end] for start, end in places], different)
            row = self._rows(different)
        size, begin = self.size[row][which], self.begin[row][which]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
        return ids, ends[words.first]

    def _rows(self, names: np.ndarray) -> np.ndarray:
        """The rows of words in the table, -1 for those that are not in it."""
        if not len(self.names):
            return np.full(len(names), -1)
        row = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[row] == names, row, -1)

    def _remember(self, names: np.ndarray, words: list[bytes], needed: np.ndarray) -> None:
        """Add words to the table; when it is full, only those that are ``needed`` now stay."""
        if len(self.names) + len(names) > CACHE_WORDS:
            kept = self._rows(needed)
            self._keep(kept[kept >= 0])
        if len(self.cache) > CACHE_WORDS // 4:
            self.cache.clear()  # only the parts of words that several words share
        self._learn(set(words))
        learned = [self.cache[word] for word in words]
        size = np.array([len(ids) // 2 for ids in learned], np.int64)
        begin = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(learned), "<u2")])
        order = np.argsort(np.concatenate([self.names, names]), kind="stable")
        self.names = np.concatenate([self.names, names])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.begin = np.concatenate([self.begin, begin])[order]

    def _keep(self, rows: np.ndarray) -> None:
        size, begin = self.size[rows], self.begin[rows]
        ends = np.cumsum(size)
        self.flat = self.flat[np.arange(int(size.sum())) + np.repeat(begin - (ends - size), size)]
        self.names, self.size, self.begin = self.names[rows], size, ends - size

    def _learn(self, words: set[bytes]) -> None:
        # ``bytes.isalpha`` knows ASCII letters only, which are lower-case here.
        cache, rest = self.cache, set()
        parted, stems, tails = [], [], []  # bytes alone, which the garbage collector does not walk
        letters = {w for w in words if w.isalpha()}
        for word in words.difference(letters):
            stem = word.rstrip(_TAIL)
            if len(stem) < len(word) and b"a" <= stem[-1:] <= b"z":
                tail = word[len(stem) :]
                parted.append(word)
                stems.append(stem)
                tails.append(tail)
                (letters if stem.isalpha() else rest).add(stem)
                rest.add(tail)
            else:
                rest.add(word)
        letters.difference_update(cache)
        plain = list(letters)
        self._encode_letters(plain, [w.decode("ascii") for w in plain])
        accented, marked, others = [], [], []
        for part in rest.difference(cache):
            word = part.decode("utf-8", "replace")
            if word.isalpha() and max(word) < _PLAIN_LIMIT and "\u0130" not in word:
                accented.append((part, word.lower()))
            else:
                (marked if _MARK in part else others).append(part)
        self._encode_letters(*zip(*accented)) if accented else None
        for part in marked:
            self.cache[part] = np.array(self._ids(part), "<u2").tobytes()
        # Many words in one call, told apart by a digit, which is always a token of its own.
        for start in range(0, len(others), RUN_WORDS):
            run = others[start : start + RUN_WORDS]
            ids = np.array(self._ids((b" " + _MARK + b" ").join(run)), "<u2")
            marks = np.flatnonzero(ids == self.mark[0])
            self._store(run, ids, [0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)])
        for word, stem, tail in zip(parted, stems, tails):
            cache[word] = cache[stem] + cache[tail]

    def _encode_letters(self, keys, words) -> None:
        """Words of plain letters, told apart by the suffix of each word's last token."""
        for start in range(0, len(keys), RUN_WORDS):
            text = "".join(f"{word}\0" for word in words[start : start + RUN_WORDS])
            ids = np.array(self.plain.encode_ordinary(text), "<u2")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            self._store(keys[start : start + RUN_WORDS], ids, [0, *ends[:-1]], ends)

    def _store(self, run: list[bytes], ids: np.ndarray, begins, ends) -> None:
        if len(begins) != len(run) or len(ends) != len(run):
            raise ValueError("words could not be told apart")
        data = ids.tobytes()
        self.cache.update(
            zip(run, [data[2 * begin : 2 * end] for begin, end in zip(begins, ends)])
        )


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    return WordEncoder(path)
