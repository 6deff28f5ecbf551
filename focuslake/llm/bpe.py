"""Byte-level BPE: texts to ids and back, with long texts cut into overlapping chunks.

A text of up to CHUNK bytes is encoded in its row. A longer one is cut into chunks of CHUNK characters that run
OVERLAP characters into the next, one row each, dealt out over all tasks. Every chunk is split into pre-tokens by the
pattern, from wherever it begins. The pattern never looks back, so where two neighbouring chunks have a boundary
in common they agree on all that follows: the least such boundary within the overlap is the joint. The text between
joints is a piece, encoded by itself, and a text's ids are those of its pieces on end. Where an overlap has no common
boundary (one pre-token fills it), the chunks on both sides go into one piece.

Two kinds of boundaries make no joint. The pattern looks ahead, so those within two characters of a chunk's end may be
wrong. And boundaries must be firm: a letter, digit or sign before, a character of another kind behind. A piece that ends
there is split as it is within its text, and it is a boundary in every version of Unicode.

Decoding takes the bytes of each id from a table and puts them on end.

Null texts are empty texts, which have no ids. Rows are encoded one by one: a null ``doc_id`` stays, repeated rows and
ties stay as they are, empty tables give empty results. Only ``doc_id`` and ``text`` are read, so other columns of any
name do no harm. A task holds a batch of short texts, or one long text while it is cut and put together; a pre-token
of any length is merged by one task, as its ids depend on all of it.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import shared_folder
from .components import stored
from .words import batch, bound_batches, repeat_ranges, texts

CHUNK = 1 << 15
OVERLAP = 1 << 10
LOOK_AHEAD = 2
PART_IDS = 1 << 18      # ids decoded at a time
HELD_BYTES = 8 << 20
HELD_ROWS = 10_000
_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_DECODED = pa.schema([*_ENCODED, ("decoded", pa.binary())])
_CHUNKS = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("start", pa.int64()),
                     ("body", pa.string())])
_BOUNDS = pa.schema([*_CHUNKS, ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])
_IDS = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("ids", pa.binary())])
ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = f"{ENCODED}, decoded binary"
CHUNKS = "row string, doc_id long, part long, parts long, start long, body string"
BOUNDS = f"{CHUNKS}, head array<long>, tail array<long>"
IDS = "row string, doc_id long, piece long, ids binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte sequences of a vocabulary file and their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_encodings: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """One encoding for all batches of a task."""
    key = (path, pattern)
    if key not in _encodings:
        import tiktoken

        name = hashlib.sha256(repr(key).encode()).hexdigest()
        _encodings[key] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _encodings[key]


def plain(column: pa.Array) -> Iterator[str]:
    """Texts of a column; null is empty, and bytes that are no UTF-8 are replaced."""
    for raw in column.cast(pa.large_binary()):
        yield (raw.as_py() or b"").decode("utf-8", "replace")


def in_pieces(schema: pa.Schema, rows: Iterator[tuple], size) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= HELD_BYTES or len(held) >= HELD_ROWS:
            yield batch(schema, *zip(*held))
            held, n = [], 0
    if held:
        yield batch(schema, *zip(*held))


def _ids(e, text: str) -> bytes:
    return np.array(e.encode_ordinary(text), "<u4").tobytes()


def encode_short(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """ENCODED for texts that are one piece each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path, pattern)

        def rows(b):
            for i, text in zip(b.column(0).to_pylist(), plain(b.column(1))):
                ids = _ids(e, text)
                yield i, len(ids) // 4, ids

        for b in batches:
            yield from in_pieces(_ENCODED, rows(b), lambda r: len(r[2]))

    return docs.mapInArrow(run, ENCODED)


# --- long texts -----------------------------------------------------------------------------------

def cut(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """CHUNKS: characters start:start + chunk + overlap of each text; the last chunk reaches the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0

        def rows(b):
            nonlocal number
            for i, text in zip(b.column(0).to_pylist(), plain(b.column(1))):
                number += 1
                parts = max(1, -(-(len(text) - overlap) // chunk))
                for p in range(parts):
                    stop = len(text) if p == parts - 1 else p * chunk + chunk + overlap
                    yield f"{task}-{number}", i, p, parts, p * chunk, text[p * chunk:stop]

        for b in batches:
            yield from in_pieces(_CHUNKS, rows(b), lambda r: len(r[5]))

    return docs.mapInArrow(run, CHUNKS)


def kind(c: str) -> str:
    """letter, digit, space or sign; empty for a character that has no kind yet."""
    if c.isspace():
        return "space"
    return {"L": "letter", "N": "digit"}.get(unicodedata.category(c)[0], "sign" if unicodedata.category(c) != "Cn" else "")


def is_firm(body: str, b: int) -> bool:
    before, behind = kind(body[b - 1]), kind(body[b])
    if not before or not behind or before == "space" or before == behind:
        return False
    return (before, behind) != ("sign", "letter")   # an apostrophe and letters may be one pre-token


def pre_tokenise(chunks: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """BOUNDS: with the boundaries of each chunk in the overlaps with its neighbours, as places in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)

        def rows(b):
            for row, doc, p, parts, start, body in zip(*(c.to_pylist() for c in b.columns)):
                found = [0, *(m.end() for m in compiled.finditer(body))]
                head = [start + x for x in found if x <= overlap] if p else []
                sure = range(chunk, len(body) - LOOK_AHEAD + 1) if p < parts - 1 else ()
                yield row, doc, p, parts, start, body, head, [start + x for x in found if x in sure and is_firm(body, x)]

        for b in batches:
            yield from in_pieces(_BOUNDS, rows(b), lambda r: len(r[5]))

    return bound_batches(chunks).mapInArrow(run, BOUNDS)


def pieces(bounds: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(row, doc_id, piece, text): whole text between joints; ``bounds`` is a stored table."""
    left = bounds.where(F.col("part") < F.col("parts") - 1).select("row", "part", "tail")
    right = bounds.where("part > 0").select("row", (F.col("part") - 1).alias("part"), "head")
    joints = left.join(right, ["row", "part"]).select("row", "part", F.array_min(F.array_intersect("tail", "head")).alias("joint"))
    # For each chunk the joint in front of it and the one behind it.
    none = F.lit(None).cast("long")
    both = joints.select("row", "part", none.alias("begin"), F.col("joint").alias("stop")).union(
        joints.select("row", F.col("part") + 1, "joint", none))
    sides = both.groupBy("row", "part").agg(F.max("begin").alias("begin"), F.max("stop").alias("stop"))
    numbered = sides.withColumn("piece", F.count("begin").over(Window.partitionBy("row").orderBy("part")))
    sized = numbered.withColumn("members", F.count("*").over(Window.partitionBy("row", "piece")))
    found = bounds.drop("head", "tail").join(sized, ["row", "part"], "left")
    size = F.length("body").cast("long")
    begin = F.coalesce("begin", "start") - F.col("start")
    stop = F.when(F.col("part") == F.col("parts") - 1, size).otherwise(F.coalesce(F.col("stop") - F.col("start"), F.lit(chunk)))
    text = F.substring("body", (begin + 1).cast("int"), (stop - begin).cast("int"))
    parts = found.select("row", "doc_id", F.coalesce("piece", F.lit(0)).alias("piece"), "part", "members", text.alias("text"))
    single = parts.where("members is null or members = 1").select("row", "doc_id", "piece", "text")
    several = parts.where("members > 1").groupBy("row", "piece").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("text"))
    return single.unionByName(several)


def encode_pieces(found: DataFrame, path: str, pattern: str) -> DataFrame:
    """ENCODED from pieces, one row per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path, pattern)
        for b in batches:
            yield from in_pieces(_IDS, ((r, d, p, _ids(e, t)) for r, d, p, t in zip(*(c.to_pylist() for c in b.columns))), lambda r: len(r[3]))

    ids = bound_batches(found.select("row", "doc_id", "piece", "text")).mapInArrow(run, IDS)
    ordered = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    joined = ids.groupBy("row").agg(F.first("doc_id").alias("doc_id"),
                                    F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x["ids"])), "")).alias("ids"))
    return joined.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, folder: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every text as unsigned 32-bit integers, least byte first.

    ``path`` is a file of ranks, ``pattern`` splits texts into pre-tokens. Long texts leave a table of chunks in ``folder``.
    """
    if not 2 * LOOK_AHEAD <= overlap <= chunk:
        raise ValueError("an overlap is longer than what the pattern looks ahead, and reaches into one chunk only")
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "bpe")
    known = texts(docs)
    long = F.octet_length(F.coalesce("text", F.lit(""))) > chunk
    chunks = cut(known.where(long), chunk, overlap).repartition("row", "part")
    bounds = stored(pre_tokenise(chunks, pattern, chunk, overlap), f"{folder}/chunks")
    return encode_short(known.where(~long), path, pattern).union(encode_pieces(pieces(bounds, chunk), path, pattern))


# --- decoding -------------------------------------------------------------------------------------

class Bytes:
    """The bytes of all ids on end, and where those of each begin."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for raw, i in ranks.items():
            by_id[i] = raw
        self.size = np.array([len(x) for x in by_id], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        return self.flat[repeat_ranges(self.begin[ids], self.size[ids])].tobytes()


_tables: dict[str, Bytes] = {}


def byte_table(path: str) -> Bytes:
    """One table for all batches of a task."""
    if path not in _tables:
        _tables[path] = Bytes(read_ranks(path))
    return _tables[path]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)

        def rows(b):
            for i, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                yield i, n, raw, b"".join(table.of(np.frombuffer(raw, "<u4", min(PART_IDS, n - k), 4 * k)) for k in range(0, n, PART_IDS))

        for b in batches:
            yield from in_pieces(_DECODED, rows(b), lambda r: len(r[2]) + len(r[3]))

    return bound_batches(encoded).select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)


def digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
