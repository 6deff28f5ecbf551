"""Token ids in binary files: ranks by frequency, byte-aligned lengths, control bytes kept apart.

``encode_documents`` turns texts into id arrays with a public tokenizer, ``write_ids`` ranks the ids by
their count over all documents and writes files in ascending ``doc_id`` order, and ``read_ids`` reads
the files back. A file (``*.ids``, little-endian) holds

    8 bytes    "FOCUSID1"
    int64 x 3  documents d, ids n, data bytes b
    uint8 x d  1 where doc_id is not null
    int64 x d  doc_id
    int64 x d  ids of the document
    (n+3)//4   control bytes: two bits per rank, its length in bytes less one
    b          the bytes of all ranks

and ``ranks.bin`` beside them holds the same first 8 bytes and the ids by rank as uint32. Nulls are empty texts and give only the
end id; a null ``doc_id`` is kept and comes first; repeated rows stay, in order of their ids; empty
tables give no files' rows. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..session import shared_folder
from .words import SLICE_BYTES, batch, repeat_ranges, slices, span_hashes, texts, words

END_ID = 2
SHARD_IDS = 4_000_000
CACHE_WORDS = 1_200_000
CACHE_PARTS = 300_000
MAGIC = b"FOCUSID1"

_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.large_binary())])
_SHARDS = pa.schema([("shard", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema([("shard", pa.string()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.large_binary())])
ENCODED = "doc_id long, n_tokens long, ids binary"
SHARDS = "shard string, part long, number long, n_docs long, n_ids long"
READ = "shard string, doc_id long, before long, n_tokens long, ids binary"


class Encoder:
    """Encodes chunks between white space once each.

    This tokenizer drops white space, so a text's ids are those of its chunks. Chunks of Latin letters,
    digits and ASCII signs are cut here by the tokenizer's own split pattern and given to its BPE
    model; any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Fixed value: the split pattern of the vocabulary file; a line feed ends a chunk.
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n").findall
        self.plain = regex.compile(r"[\x21-\x7e¡-įı-ſ]+").fullmatch
        show = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # The characters by which the model knows bytes; asked for one by one.
        self.shown = {b: show(chr(b))[0][0] for b in range(33, 127)}
        for code in range(0xA1, 0x180):
            for b, c in zip(chr(code).encode(), show(chr(code))[0][0]):
                self.shown[b] = c
        self._clear_parts()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 1
        self.flat[0] = END_ID
        self.begin, self.count = np.zeros(1, np.int64), np.ones(1, np.int64)  # slot 0 is the end id

    def _clear_parts(self) -> None:
        self.parts: dict[str, int] = {"\n": 0}
        self.part_ids = np.zeros(0, np.uint32)
        self.part_stop = np.zeros(1, np.int64)   # where the ids of each part end; part 0 has none

    def _learn(self, parts: set[str]) -> None:
        """Ids of parts not met before."""
        tokenize, ids, stop = self.model.tokenize, [], []
        for part in parts:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.shown)
            ids += [t.id for t in tokenize(shown)]
            stop.append(len(ids))
            self.parts[part] = len(self.parts)
        self.part_stop = np.concatenate([self.part_stop, len(self.part_ids) + np.array(stop, np.int64)])
        self.part_ids = np.concatenate([self.part_ids, np.array(ids, np.uint32)])

    def _plain(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids on end and their number for each of some plain chunks."""
        if len(self.parts) > CACHE_PARTS:
            self._clear_parts()
        cut = self.cut("\n".join(chunks).lower())
        self._learn(set(cut) - self.parts.keys())
        known = self.parts
        numbers = np.array([known[x] for x in cut] + [0], np.int64)
        start = np.concatenate([[0], self.part_stop[:-1]])
        counts = (self.part_stop - start)[numbers]
        ids = self.part_ids[repeat_ranges(start[numbers], counts)]
        return ids, np.diff(np.cumsum(counts)[numbers == 0], prepend=0)

    def _store(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        slots = len(self.begin) + np.arange(len(counts))
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.used += len(ids)
        return slots

    def slots(self, hashes: np.ndarray, s, w) -> np.ndarray:
        """The slot of each word, encoding those not met before."""
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > CACHE_WORDS:
            self._clear()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            data, where = s.data.tobytes(), first[fresh]
            new = [data[i:j].decode("utf-8", "replace") for i, j in zip(w.start[where].tolist(), w.end[where].tolist())]
            whole = "".join(new)   # mostly plain, and then no chunk is asked by itself
            if self.plain(whole) and "<|" not in whole:
                plain = np.ones(len(new), bool)
            else:
                plain = np.array([self.plain(x) is not None and "<|" not in x for x in new])
            slots = np.empty(len(new), np.int64)
            if plain.any():
                slots[plain] = self._store(*self._plain([x for x, p in zip(new, plain) if p]))
            if not plain.all():
                others = [self.tokenizer.encode(x, add_special_tokens=False).ids for x, p in zip(new, plain) if not p]
                slots[~plain] = self._store(np.array([i for x in others for i in x], np.uint32), np.array([len(x) for x in others]))
            self.keys = np.insert(self.keys, at[fresh], unique[fresh])
            self.slot = np.insert(self.slot, at[fresh], slots)
        return self.slot[np.searchsorted(self.keys, unique)][back]

    def encode(self, s) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, an end id behind each text, and the number of ids of each text."""
        w = words(s)
        ends = w.row[1:]
        # Ids do not depend on the case of letters, but for the names of special tokens.
        exact = b"<|" in s.data.tobytes()
        hashes = span_hashes(s, w.start, w.end, fold=not exact)
        slots = np.insert(self.slots(~hashes if exact else hashes, s, w), ends, 0)
        counts = self.count[slots]
        ids = self.flat[repeat_ranges(self.begin[slots], counts)]
        sums = np.concatenate([[0], np.cumsum(counts)])
        bounds = sums[w.row + np.arange(len(w.row))]
        return ids, np.diff(bounds)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker, so words met before stay known."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_bytes(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer).get_vocab().values()) < 1 << 16 else 4


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids on end in bytes, the end id last.

    Two bytes for each id where the vocabulary allows it, else four; see ``id_bytes``.
    """
    width = id_bytes(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoder = _encoder(tokenizer)
            for s in slices(b.column(1), 2 * SLICE_BYTES):
                ids, counts = encoder.encode(s)
                raw = ids.astype(f"<u{width}").tobytes()
                at = np.concatenate([[0], np.cumsum(counts)]) * width
                values = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), s.rows, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
                yield batch(_ENCODED, b.column(0).slice(s.first, s.rows), counts, values)

    return texts(docs).mapInArrow(run, ENCODED)


# --- control bytes and data bytes -----------------------------------------------------------------

_LENGTHS = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = ranks.astype(np.uint32)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros((len(ranks) + 3) // 4 * 4, np.uint8)
    padded[:len(ranks)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    stop = np.cumsum(extra.astype(np.int64) + 1)
    at = stop - extra - 1
    data = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    for k in range(4):
        some = extra >= k
        data[at[some] + k] = (ranks[some] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control, data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The values behind ``pack``: lengths come from a table by control byte."""
    lengths = _LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    out = np.zeros(n, np.uint32)
    for k in range(4):
        some = lengths > k
        out[some] |= data[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def shard_bytes(doc_ids: list, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    there = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    head = np.array([len(doc_ids), len(ranks), len(data)], "<i8")
    return b"".join([MAGIC, *(x.tobytes() for x in (head, there, numbers, counts.astype("<i8"), control, data))])


def parse_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """there, doc_id, counts, ranks of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    d, n, b = (int(x) for x in np.frombuffer(raw, "<i8", 3, 8))
    at, out = 32, []
    for kind, k in (("u1", d), ("<i8", d), ("<i8", d), ("u1", (n + 3) // 4), ("u1", b)):
        out.append(np.frombuffer(raw, kind, k, at))
        at += out[-1].nbytes
    return out[0].astype(bool), out[1], out[2], unpack(out[3], out[4], n)


# --- files ----------------------------------------------------------------------------------------

def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def _put(uri: str, raw: bytes, mark: str) -> None:
    """Written under another name and renamed, so a repeated task replaces a file whole."""
    store, path = _store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{path}.{mark}.tmp") as out:
        out.write(raw)
    store.move(f"{path}.{mark}.tmp", path)


def id_counts(encoded: DataFrame, width: int) -> DataFrame:
    """(id, n) over all documents: one row per id and task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for raw in b.column(0):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}")
                seen = np.bincount(ids, minlength=len(total))
                seen[:len(total)] += total
                total = seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(encoded: DataFrame, folder: str, width: int = 4) -> DataFrame:
    """Writes files below ``folder`` and returns (shard, part, number, n_docs, n_ids, start).

    ``encoded`` is read twice, so it should be a stored table. The ranks are one number per id of the
    vocabulary, a bound that does not grow with the documents; a file holds at most SHARD_IDS ids or
    one document.
    """
    spark = encoded.sparkSession
    ranked = [r.id for r in id_counts(encoded, width).orderBy(F.desc("n"), "id").collect()]
    _put(f"{folder}/ranks.bin", MAGIC + np.array(ranked, "<u4").tobytes(), "driver")
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, number, docs, held, size = task.partitionId(), 0, [], [], 0

        def flush():
            name = f"part-{part:06d}-{number:05d}.ids"
            counts = np.array([len(x) // width for x in held], np.int64)
            ids = np.frombuffer(b"".join(held), f"<u{width}")
            _put(f"{folder}/{name}", shard_bytes(docs, counts, shared.value[ids]), f"{task.taskAttemptId()}")
            return batch(_SHARDS, [name], [part], [number], [len(docs)], [len(ids)])

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1)):
                raw = raw.as_py()
                if held and size + len(raw) > width * SHARD_IDS:
                    yield flush()
                    number, docs, held, size = number + 1, [], [], 0
                docs.append(doc)
                held.append(raw)
                size += len(raw)
        if held:
            yield flush()

    ordered = encoded.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, SHARDS).write.parquet(f"{folder}/shards")
    # One row per file.
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards")
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, doc_id, before, n_tokens, ids) from the files; ``before`` counts within the file."""
    ranks = spark.read.format("binaryFile").load(f"{folder}/ranks.bin").select("content").first().content
    shared = spark.sparkContext.broadcast(bytes(ranks[len(MAGIC):]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = np.frombuffer(shared.value, "<u4")
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                there, doc_ids, counts, ranks = parse_shard(raw.as_buffer().to_pybytes())
                ids = id_of[ranks].astype("<u4").tobytes()
                stop = np.cumsum(counts)
                at = np.concatenate([[0], stop]) * 4
                values = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(counts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)])
                yield batch(_READ, [path.rpartition("/")[2]] * len(counts), pa.array(doc_ids, mask=~there), stop - counts,
                            counts, values)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)
    return files.select("path", "content").mapInArrow(run, READ)


def store_ids(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Encodes, writes and reads back: (doc_id, start, n_tokens, ids) in the order of the files."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-ids")
    encode_documents(docs, tokenizer).write.option("compression", "zstd").parquet(f"{folder}/encoded")
    shards = write_ids(spark.read.schema(ENCODED).parquet(f"{folder}/encoded"), folder, id_bytes(tokenizer))
    found = read_ids(spark, folder).join(shards.select("shard", "start"), "shard")
    return found.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def digest(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32)."""
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
