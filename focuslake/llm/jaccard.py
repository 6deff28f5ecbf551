"""Similarity join on word shingles by chosen paths.

A document's set holds the hashes of its runs of five words (A-Z lower-cased); a text of one to four
words has one run, a text without words an empty set. Documents with equal sets are one class. The
classes are split recursively: in every run a bucket chooses random coordinates of the members'
min-hash signatures, each with probability 1 / (similarity x coordinates), and members that agree in a
chosen coordinate go on together. A pair of the wanted similarity keeps one common path on average, so
runs are repeated until the wanted recall. Small buckets are compared by signature; buckets that do not
split are kept whole. What is found so hangs together in candidate groups, in which all pairs are
then compared exactly, block against block, by their whole sets.

Nulls are texts without words; all texts without words are one class and have no links. Repeated rows
are copies of each other. A null ``doc_id`` takes part. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructType

from ..session import shared_folder
from .components import components, roots, runs, stored
from .names import plain
from .urls import BROADCAST_BLOCKS, blocks_for, bloom_filter, possible
from .words import batch, bound_batches, mix, repeat_ranges, run_hashes, slices, span_hashes, texts, words

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
COORDINATES = 64
BUCKET = 128     # members up to which a bucket is compared
DEPTH = 4        # splits after which a bucket is kept whole
BLOCK = 256      # members of a block in the exact comparison
FILTER_BLOCKS = 1 << 19   # 34 MB of bits, for 22 million shared buckets; beyond that more paths pass it
_BITS = 44       # of a shingle's hash; the rest of 64 bits counts the rows of a slice

_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.large_binary()), ("sig", pa.large_binary()),
                     ("short", pa.large_binary())])
SIGNED = "doc_id long, n long, key binary, sig binary, short binary"
_MULTIPLIERS = np.random.default_rng(5).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(s, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row on end, and the bounds of the rows."""
    w = words(s)
    h = span_hashes(s, w.start, w.end, fold=True)
    n = np.diff(w.row)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    start = repeat_ranges(w.row[:-1], count)
    owner = np.repeat(np.arange(len(n)), count)
    codes = run_hashes(h, start, start + np.minimum(n, k)[owner])
    keys = np.unique(owner.astype(np.uint64) << np.uint64(_BITS) | codes >> np.uint64(64 - _BITS))
    bounds = np.searchsorted(keys, np.arange(len(n) + 1, dtype=np.uint64) << np.uint64(_BITS))
    return keys & np.uint64((1 << _BITS) - 1), bounds


def set_keys(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits of each set, as rows of two 64-bit values."""
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        if len(full):
            out[full, i] = mix(np.add.reduceat(mix(sets ^ np.uint64(salt)), bounds[:-1][full]))
    return out


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        spread = mix(sets)
        for i, m in enumerate(_MULTIPLIERS):
            out[full, i] = np.minimum.reduceat((spread * m >> np.uint64(32)).astype(np.uint32), bounds[:-1][full])
    return out


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, sig, short) for each row: size, identity and signature of its set, and a byte of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(1)):
                sets, bounds = shingle_sets(s)
                sig = signatures(sets, bounds)
                yield batch(_SIGNED, b.column(0).slice(s.first, s.rows), np.diff(bounds),
                            _binary(set_keys(sets, bounds)), _binary(sig), _binary(sig.astype(np.uint8)))

    return texts(docs).mapInArrow(run, SIGNED)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    at = np.arange(len(rows) + 1, dtype=np.int64) * rows.shape[1] * rows.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows)])


def _matrix(column, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column, n = column.cast(pa.large_binary()), len(column)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]]
    return raw.view(kind).reshape(n, -1) if raw.ctypes.data % 8 == 0 else np.frombuffer(raw.tobytes(), kind).reshape(n, -1)


# --- chosen paths ---------------------------------------------------------------------------------

def _agreements(similarity: float) -> np.ndarray:
    """Probability of each number of coordinates in which the signatures of a pair of the similarity agree."""
    n = np.arange(COORDINATES + 1)
    return np.array([math.comb(COORDINATES, i) for i in n], float) * similarity ** n * (1 - similarity) ** (COORDINATES - n)


def repeats(recall: float = RECALL, depth: int = DEPTH, similarity: float = SIMILARITY) -> int:
    """Runs after which a pair at the limit is found: a branching process with one child on average.

    A pair's signatures are the same in all runs, so the recall is that of each number of agreeing coordinates, averaged.
    """
    agree, likely = np.arange(COORDINATES + 1), _agreements(similarity)
    alive = np.ones(COORDINATES + 1)
    for _ in range(depth):
        alive = 1 - (1 - alive * min(1.0, 1 / (similarity * COORDINATES))) ** agree
    n = 1
    while likely @ (1 - alive) ** n > 1 - recall:
        n += 1
    return n


def chosen(seed: int, similarity: float) -> np.ndarray:
    """The coordinates that a bucket chooses."""
    return np.flatnonzero(np.random.default_rng(seed & (1 << 63) - 1).random(COORDINATES) < 1 / (similarity * COORDINATES))


def _paths(rows: DataFrame, similarity: float, first_runs: int) -> DataFrame:
    """Children (bucket, key) of rows (bucket, key, sig); ``first_runs`` roots if there is no bucket yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("key", pa.binary())])
        picks: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            keys, sig = b.column(1), _matrix(b.column(2), np.uint32)
            nodes = np.arange(first_runs, dtype=np.int64)[None].repeat(b.num_rows, 0) if first_runs else np.asarray(b.column(0))[:, None]
            row, bucket = [], []
            for node in np.unique(nodes):
                if node not in picks:
                    if len(picks) > 10_000:
                        picks.clear()
                    picks[node] = chosen(int(node) * 0x9E3779B1 + 77, similarity)
                at = np.flatnonzero((nodes == node).any(1)) if not first_runs else np.arange(b.num_rows)
                for i in picks[node]:
                    path = mix(np.array([int(node) & (1 << 64) - 1], np.uint64) * np.uint64(3) + np.uint64(i + 1))
                    row.append(at)
                    bucket.append(mix(path ^ (sig[at, i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64))
            if row:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(bucket)), keys.take(pa.array(np.concatenate(row))).cast(pa.binary())], schema=schema)

    return rows.select("bucket", "key", "sig").mapInArrow(run, "bucket long, key binary")


def _alike(rows: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) from each member of a small bucket (bucket, key, short) to the first of those its signature resembles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        for t in runs(batches):
            sig, keys = _matrix(t.column(2), np.uint8), t.column(1).combine_chunks()
            equal = (sig[:, None] == sig[None]).sum(2)
            left, right = np.nonzero(np.triu(equal >= least * COORDINATES, 1))
            if len(left):
                root = roots(len(sig), left, right)
                member = np.flatnonzero(root != np.arange(len(sig)))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(member)), keys.take(pa.array(root[member]))], schema=schema)

    return (rows.select("bucket", "key", "short").repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "a binary, b binary"))


def candidate_edges(classes: DataFrame, folder: str, similarity: float, recall: float) -> DataFrame:
    """Edges (a, b) whose components hold every pair of the similarity, at the recall, together."""
    rows, found, level = classes.select(F.lit(0).cast("long").alias("bucket"), "key", "sig"), None, 0
    # Four standard deviations of a signature's estimate below the limit.
    least = similarity - 4 * math.sqrt(similarity * (1 - similarity) / COORDINATES)
    runs_ = repeats(recall, DEPTH, similarity)
    while True:
        paths = stored(_paths(rows, similarity, runs_ if level == 0 else 0), f"{folder}/paths-{level}")
        sizes = stored(paths.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), f"{folder}/sizes-{level}")
        # Most paths are alone in their bucket: a filter of bounded size keeps them out of the shuffle, the join decides.
        blocks = min(blocks_for(sizes.count()), FILTER_BLOCKS)
        wanted = F.broadcast(bloom_filter(sizes.select(F.col("bucket").alias("canonical")), blocks))
        likely = possible(paths, F.col("bucket"), wanted, blocks).where("__possible").drop("__possible")
        shared = stored(likely.join(sizes, "bucket"), f"{folder}/shared-{level}")
        small = shared.where(F.col("size") <= BUCKET).select("bucket", "key").join(classes.select("key", "short"), "key")
        edges = _alike(small, least)
        level += 1
        large = shared.where(F.col("size") > BUCKET)
        if level == DEPTH:
            whole = large.join(large.groupBy("bucket").agg(F.min("key").alias("first")), "bucket")
            edges = edges.union(whole.select(F.col("key").alias("a"), F.col("first").alias("b")))
        edges = stored(edges.distinct(), f"{folder}/found-{level}")
        found = edges if found is None else found.union(edges)
        if level == DEPTH or large.isEmpty():
            return found
        rows = large.select("bucket", "key").join(classes.select("key", "sig"), "key")


# --- exact comparison -----------------------------------------------------------------------------

def _sets_of(docs: DataFrame) -> DataFrame:
    """(group, blocks, key, sets) from (group, blocks, key, text), for rows whose set has that key."""
    schema = pa.schema([("comp", pa.binary()), ("blocks", pa.int64()), ("key", pa.binary()), ("items", pa.large_binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(3)):
                sets, bounds = shingle_sets(s)
                part = b.slice(s.first, s.rows)
                own = (_matrix(part.column(2), np.uint64) == set_keys(sets, bounds)).all(1)
                items = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), s.rows, [None, pa.py_buffer((bounds * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(sets))])
                yield batch(schema, part.column(0), part.column(1), part.column(2), items).filter(pa.array(own))

    return docs.select("comp", "blocks", "key", "text").mapInArrow(run, "comp binary, blocks long, key binary, items binary")


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the elements that occur twice."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    out = np.zeros((n, n), np.float32)
    values, back, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    twice = counts[back] > 1
    column, owner = number[back[twice]], np.repeat(np.arange(n), sizes)[twice]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [begin, begin + width])
        m = np.zeros((n, min(width, int(column[-1]) + 1 - begin)), np.float32)
        m[owner[lo:hi], column[lo:hi] - begin] = 1
        out += m @ m.T
    return out


def _compare(rows: DataFrame, similarity: float) -> DataFrame:
    """(key, n, root) per member of a task's rows (task, side, key, items) that has links there."""
    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            keys = t.column(2).to_pylist()
            keep = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]   # repeated rows are sorted together
            keys = [keys[i] for i in keep]
            side = np.asarray(t.column(1))[keep]
            sets = [np.frombuffer(t.column(3)[i].as_buffer(), np.uint64) for i in keep]
            sizes = np.array([len(x) for x in sets])
            common = overlaps(sets).astype(np.float64)
            alike = common / np.maximum(sizes[:, None] + sizes[None] - common, 1) >= similarity
            np.fill_diagonal(alike, False)
            if side.any():
                alike &= side[:, None] != side[None]
            links = alike.sum(1)
            member = np.flatnonzero(links)
            if len(member):
                root = roots(len(keys), *np.nonzero(np.triu(alike)))
                yield batch(schema, [keys[i] for i in member], links[member], [keys[root[i]] for i in member])

    return (rows.select("task", "side", "key", "items").repartition("task").sortWithinPartitions("task", "key")
            .mapInArrow(run, "key binary, links long, root binary"))


def exact_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(key, links, root) from all pairs within each candidate group, block against block."""
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = groups.join(sizes, "root").select(F.col("node").alias("key"), F.col("root").alias("comp"), "blocks")
    wanted = members.join(classes.select("key", "class_id"), "key")
    texts = docs.select(F.col("doc_id").cast("long").alias("own"), F.col("text").cast("string").alias("text"))
    # A filter of bounded size keeps most texts that no group wants out of the shuffle; the join decides.
    ids = wanted.select(F.col("class_id").alias("canonical")).distinct()
    blocks = min(blocks_for(ids.count()), BROADCAST_BLOCKS)
    texts = possible(texts, F.col("own"), bloom_filter(ids, blocks), blocks).where("__possible").drop("__possible")
    # One text of each set, whatever its id: ids may be null or repeated.
    one = _keyed(texts, 1).dropDuplicates(["__key"]).select(F.col("__key").alias("key"), "text")
    sets = _sets_of(wanted.join(one, "key"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    spread = sets.withColumn("block", block).withColumn("other", other)
    rows = spread.select(
        F.xxhash64("comp", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "key", "items")
    return _compare(rows, similarity)


def similar(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, folder: str | None = None) -> DataFrame:
    """(doc_id, class_id, group_id, n_links) for every row.

    ``class_id`` is the least ``doc_id`` with the same set, ``n_links`` the number of other classes whose
    similarity reaches the limit, ``group_id`` the least ``doc_id`` of all that links connect.
    """
    return _grouped(docs, similarity, recall, folder).select("doc_id", "class_id", "group_id", "n_links")


def _grouped(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, folder: str | None = None) -> DataFrame:
    """The same with the key of the row's set and the root of its group."""
    folder = folder or shared_folder(docs.sparkSession, "jaccard")
    sign = stored(signed(docs), f"{folder}/signed")
    classes = stored(sign.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.max("n").alias("n"), F.first("sig").alias("sig"), F.first("short").alias("short")),
                     f"{folder}/classes")
    edges = candidate_edges(classes.where("n > 0"), f"{folder}/paths", similarity, recall)
    groups = stored(components(edges, f"{folder}/candidates"), f"{folder}/groups")
    found = stored(exact_links(docs, classes, groups, similarity), f"{folder}/links")
    linked = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")), f"{folder}/linked")
    counts = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    known = (classes.select("key", "class_id").join(counts, "key", "left")
             .join(linked.withColumnRenamed("node", "key"), "key", "left")
             .select("key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "key").alias("root")))
    known = stored(known, f"{folder}/known")
    lowest = known.groupBy("root").agg(F.min("class_id").alias("group_id"))
    result = known.join(lowest, "root").select("key", "root", "class_id", "group_id", "n_links")
    return sign.select("doc_id", "key").join(result, "key")


def _keyed(docs: DataFrame, at: int) -> DataFrame:
    """``docs`` with the key of the set of column ``at`` as the last column, ``__key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(at).cast(pa.string())):
                yield pa.RecordBatch.from_arrays([*b.slice(s.first, s.rows).columns, _binary(set_keys(*shingle_sets(s))).cast(pa.binary())],
                                                 names=[*b.schema.names, "__key"])

    return bound_batches(docs).mapInArrow(run, StructType([*docs.schema.fields]).add("__key", BinaryType()))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The row with the least ``doc_id`` of each group, of those the one with the least key; all columns of ``docs``.

    Only rows of one group remove each other: rows of different texts stay, whether ``doc_id`` is null or repeated.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f")
    kept = _grouped(docs, **options).groupBy("root").agg(first).select(F.col("f.doc_id").alias("kept_id"), F.col("f.key").alias("kept_key"))
    inner = plain(docs.columns)
    rows, doc_id = _keyed(docs.toDF(*inner), docs.columns.index("text")), inner[docs.columns.index("doc_id")]
    same = rows[doc_id].cast("long").eqNullSafe(F.col("kept_id")) & (rows["__key"] == F.col("kept_key"))
    return rows.join(kept, same, "left_semi").dropDuplicates([doc_id, "__key"]).drop("__key").toDF(*docs.columns)
