"""Byte-level BPE encoding and decoding of texts of any length.

A text is encoded as its pre-tokens are, one by one. Texts longer than a chunk are cut into
overlapping chunks that different tasks pre-tokenize. A chunk but the first starts anywhere, so
its first boundaries may be wrong; but a pre-token follows from the text behind its start alone, so
as soon as two neighbours share one boundary in their overlap, they share all later ones. There
they are stitched: a piece is the text from one shared boundary to the next, and pieces are encoded in
parallel. Only the boundaries in the overlaps are compared, not texts. Where an overlap has no
shared boundary (a run of white space or of letters as long as the overlap), the two chunks are merged
and pre-tokenized again, until all neighbours agree. By induction from the first chunk, all
stitches are boundaries of the whole text.

A boundary near the end of a chunk counts only if the pattern needed no character behind the
chunk to find it, and boundaries behind white space do not count, since a piece that ends there would
be parted otherwise. Decoding concatenates the bytes of the ids' tokens.

Chunks and pieces of long texts are written to the shared folder between these steps. Short texts
(one chunk) are encoded where they are read, without a shuffle.

Defined cases: null and empty texts have no ids; repeated rows and null ids are rows of their own;
special tokens' names are ordinary text; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from gaugeworks.llm.hashing import slices
from gaugeworks.session import forget, settle

CHUNK_BYTES = 1 << 15
OVERLAP_BYTES = 1 << 10
# The pattern may look at two characters behind the end of a match ('re, 've, 'll).
LOOK_AHEAD = 2
# Longer runs of white space overflow the stack of tiktoken's pattern matcher.
LONG_RUN = 1 << 17

_LONG_SPACE = regex.compile(rf"\s{{{LONG_RUN}}}")


class ByteBpe:
    """Ids of a text and bytes of ids, for one file of ranks and one pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            split = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in split}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding(
            Path(path).name, pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={}
        )
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and _LONG_SPACE.search(text):
            matches = (m.group().encode() for m in self.pattern.finditer(text))
            ids = [i for m in matches for i in self.encoding._encode_single_piece(m)]
            return np.array(ids, "<u4")
        return np.array(self.encoding.encode_ordinary(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def boundaries(self, data: bytes) -> np.ndarray:
        """Byte positions in ``data`` where a pre-token ends, other than in white space.

        White space behind which a text is cut would be matched as one run, where the whole text
        may part its last character; any other end of a pre-token is the same in both.
        """
        ends = [m.end() for m in self.pattern.finditer(data.decode()) if not m[0][-1].isspace()]
        return np.append(_char_starts(data), len(data))[ends]


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One encoder per worker process."""
    return ByteBpe(path, pattern)


def _char_starts(data: bytes) -> np.ndarray:
    return np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)


def _char_start(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a character of the UTF-8 text starts."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def cut(data: bytes, chunk: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Places of chunks of ``chunk`` bytes that reach ``overlap`` bytes into the next one."""
    count = max(1, -(-(len(data) - overlap) // chunk))
    for k in range(count):
        start = _char_start(data, k * chunk)
        end = _char_start(data, (k + 1) * chunk + overlap) if k + 1 < count else len(data)
        yield start, end


CHUNK = "text_id bigint, chunk int, start bigint, last boolean, data binary"
ENDS = "text_id bigint, chunk int, head array<bigint>, tail array<bigint>"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(),
             "array<bigint>": pa.list_(pa.int64())}
    fields = [pair.split() for pair in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    arrays = [pa.array(list(c), types[kind]) for c, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def cut_texts(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """The overlapping chunks of long texts (columns ``text_id`` and ``text``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for text_id, data in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                for k, (start, end) in enumerate(cut(data, chunk, overlap)):
                    yield _batch(CHUNK, [(text_id, k, start, end == len(data), data[start:end])])

    return texts.select("text_id", "text").mapInArrow(run, CHUNK)


def chunk_ends(chunks: DataFrame, overlap: int, path: str, pattern: str) -> DataFrame:
    """Boundaries at the head and the tail of each chunk, as places in the whole text."""
    reach = overlap + 4  # chunks start up to three bytes late

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            rows = []
            for text_id, chunk, start, last, data in zip(*(c.to_pylist() for c in batch.columns)):
                ends = bpe.boundaries(data)
                sure = 0 if last else _char_starts(data)[-LOOK_AHEAD]
                # What starts at a boundary of the chunk before is right from its start on.
                head = np.append(0, ends[ends <= reach])
                tail = ends[(ends >= len(data) - reach) & (ends <= sure)]
                rows.append((text_id, chunk, (head + start).tolist(), (tail + start).tolist()))
            yield _batch(ENDS, rows)

    return chunks.mapInArrow(run, ENDS)


def stitches(ends: DataFrame) -> DataFrame:
    """Per chunk ``first``: where it and the chunk before first agree, null where they do not.

    Of the first chunk of a text it is 0.
    """
    ordered = Window.partitionBy("text_id").orderBy("chunk")
    shared = F.array_min(F.array_intersect(F.lag("tail").over(ordered), "head"))
    first = F.when(F.col("chunk") == 0, F.lit(0).cast("bigint")).otherwise(shared)
    return ends.select("text_id", "chunk", first.alias("first"))


def merge_chunks(chunks: DataFrame, agreed: DataFrame) -> DataFrame:
    """Chunks with each one that has no stitch appended to the one before, numbered anew."""
    upto = Window.partitionBy("text_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    groups = agreed.withColumn("merged", (F.count("first").over(upto) - 1).cast("int"))

    def run(key, table):
        table = table.sort_by("chunk")
        starts, parts = table.column("start").to_pylist(), table.column("data").to_pylist()
        own = [part[: after - at] for part, at, after in zip(parts, starts, starts[1:])]
        data = b"".join([*own, parts[-1]])
        last = table.column("last")[table.num_rows - 1].as_py()
        batch = _batch(CHUNK, [(key[0].as_py(), key[1].as_py(), starts[0], last, data)])
        return pa.Table.from_batches([batch])

    return (
        chunks.join(groups.drop("first"), ["text_id", "chunk"])
        .groupBy("text_id", "merged")
        .applyInArrow(run, CHUNK)
    )


def pieces(chunks: DataFrame, agreed: DataFrame) -> DataFrame:
    """text_id, chunk and data of the text between one stitch and the next."""
    ordered = Window.partitionBy("text_id").orderBy("chunk")
    bounds = agreed.withColumn("until", F.lead("first").over(ordered))
    begin = F.col("first") - F.col("start")
    size = F.coalesce("until", F.col("start") + F.length("data")) - F.col("first")
    data = F.substring("data", (begin + 1).cast("int"), size.cast("int"))
    return chunks.join(bounds, ["text_id", "chunk"]).select("text_id", "chunk", data.alias("data"))


def encode_pieces(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Replace ``data`` by ``ids``: little-endian unsigned 32-bit numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in slices(batches, "data"):
            at = batch.schema.get_field_index("data")
            ids = [bpe.encode((v or b"").decode()).tobytes() for v in batch.column(at).to_pylist()]
            yield batch.set_column(at, "ids", pa.array(ids, pa.binary()))

    kept = [f"{name} {kind}" for name, kind in rows.dtypes if name != "data"]
    return rows.select(*[c for c in rows.columns if c != "data"], "data").mapInArrow(
        run, ", ".join([*kept, "ids binary"])
    )


def encode_long(
    texts: DataFrame, path: str, pattern: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES
) -> DataFrame:
    """text_id and ids of texts that are cut into chunks."""
    chunks = settle(cut_texts(texts, chunk, overlap), "chunks")
    while True:
        # Chunks are few and large, and files hold those of one task: deal them out evenly.
        dealt = chunks.repartition("text_id", "chunk")
        agreed = settle(stitches(chunk_ends(dealt, overlap, path, pattern)), "stitches")
        if agreed.filter(F.col("first").isNull()).isEmpty():
            break
        merged = settle(merge_chunks(chunks, agreed), "chunks")
        forget(chunks, agreed)
        chunks = merged
    parts = encode_pieces(pieces(chunks, agreed), path, pattern)
    in_order = F.sort_array(F.collect_list(F.struct("chunk", "ids"))).getField("ids")
    return parts.groupBy("text_id").agg(_concat(in_order).alias("ids"))


def _concat(parts):
    return F.aggregate(parts, F.lit(b""), lambda all_before, part: F.concat(all_before, part))


def encode_texts(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK_BYTES,
    overlap: int = OVERLAP_BYTES,
) -> DataFrame:
    """doc_id and ``ids`` (little-endian unsigned 32-bit numbers) of every document."""
    if not 8 <= overlap <= chunk - 16:
        raise ValueError("an overlap must be shorter than its chunk")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk + overlap
    short = encode_pieces(
        texts.filter(~long).select("doc_id", F.col("text").cast("binary").alias("data")), path, pattern
    )
    named = settle(
        texts.filter(long).withColumn("text_id", F.monotonically_increasing_id()), "long-texts"
    )
    ids = encode_long(named, path, pattern, chunk, overlap)
    return short.unionByName(named.select("doc_id", "text_id").join(ids, "text_id").drop("text_id"))


def decode_ids(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the bytes of the tokens of each row's ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in slices(batches, ids_col):
            ids = batch.column(ids_col).to_pylist()
            data = [bpe.decode(np.frombuffer(v or b"", "<u4")) for v in ids]
            yield batch.append_column("decoded", pa.array(data, pa.binary()))

    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in rows.dtypes), "decoded binary"])
    return rows.mapInArrow(run, schema)
