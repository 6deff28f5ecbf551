"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors are rotated so that signs lose least (principal axes, then rotations fitted in turns to the signs of
a bounded sample), and several such rotations give a code of ROTATIONS bits per dimension. A code is cut
into substrings of 16 bits, and the index holds a row for each substring, its value and the code. A query's
radius is read off the distances to the sample, so that a share of all codes falls within it. The share is
measured on the table: PROBES queries are compared with every vector, and it is the least that covers
COVERED of their true neighbours (and never less than CANDIDATES codes). By the
pigeonhole principle a code within the radius r agrees with the query in some of the m substrings up to
r // m bits, so probing all such buckets finds every code within the radius. Those are ranked by their
distance in double precision on the original vectors. A query that got too few neighbours is asked again
with all codes.

Equal vectors are one entry with their K + 1 least ids, which is all that a result can name of them, so a
vector that fills a third of the table is one row here. Null vectors, those of zeros, those that hold a null
or a number that is not finite, those of another length than most, and rows without an id take no part.
Repeated rows count once. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_folder
from .components import stored

K = 10
ROTATIONS = 4
CANDIDATES = 800       # codes within a radius at least
PROBES = 400           # queries at most whose true neighbours are worked out to set the radii
COVERED = 0.97         # of those neighbours
SAMPLE = 16_000        # vectors at most that fit the rotations and the radii
SAMPLE_NUMBERS = 4_000_000
QUERIES = 20_000       # queries at a time in a task
_BITS = 16


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Distinct (vec_id, v) that take part."""
    v = F.col(vector)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(sound)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0)).distinct()


def entries(rows: DataFrame, k: int = K) -> DataFrame:
    """(entry, v, ids): one row for each distinct vector with its k + 1 least ids."""
    order = Window.partitionBy("v").orderBy("vec_id")
    least = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return least.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.xxhash64("v").alias("entry"), "v", "ids")


class Codes:
    """The learned rotations; ``of`` gives codes as rows of 16-bit substrings."""

    def __init__(self, mean: np.ndarray, rotations: list[np.ndarray]):
        self.mean, self.rotations = mean, rotations

    @classmethod
    def fit(cls, sample: np.ndarray, rotations: int = ROTATIONS, turns: int = 15) -> Codes:
        mean = sample.mean(0)
        centred = sample - mean
        axes = np.linalg.eigh(centred.T @ centred)[1]
        turned, out = centred @ axes, []
        for r in range(rotations):
            q = np.linalg.qr(np.random.default_rng(r).normal(size=axes.shape))[0]
            for _ in range(turns):
                u, _, v = np.linalg.svd(np.where(turned @ q >= 0, 1.0, -1.0).T @ turned)
                q = (u @ v).T
            out.append(axes @ q)
        return cls(mean, out)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        signs = np.concatenate([(vectors - self.mean) @ r >= 0 for r in self.rotations], 1)
        signs = np.pad(signs, ((0, 0), (0, -signs.shape[1] % _BITS)))
        return np.packbits(signs, axis=1).view(np.uint16)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def radii(queries: np.ndarray, sample: np.ndarray, share: float) -> np.ndarray:
    """For each query the distance within which that share of the sample lies."""
    bits = queries.shape[1] * _BITS
    if share >= 1 or not len(sample):
        return np.full(len(queries), bits, np.int32)
    n = min(len(sample) - 1, int(np.ceil(share * len(sample))))
    return np.array([np.partition(hamming(q, sample), n)[n] for q in queries], np.int32)


def questions(asked: DataFrame, codes: Codes, sample: np.ndarray, share: float) -> DataFrame:
    """(query_id, code, radius) for each query, worked out by the tasks."""
    shared = asked.sparkSession.sparkContext.broadcast((codes.mean, codes.rotations, codes.of(sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *model, near = shared.value
        model = Codes(*model)
        for b in batches:
            if b.num_rows:
                code = model.of(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in code], pa.binary()),
                                                  pa.array(radii(code, near, share))], names=["query_id", "code", "radius"])

    return asked.select("query_id", "v").mapInArrow(run, "query_id long, code binary, radius int")


def true_neighbours(found: DataFrame, probes: np.ndarray, codes: Codes, k: int = K) -> DataFrame:
    """(probe, apart): distance of codes from each probe to its k nearest other vectors, found among all rows in blocks."""
    shared = found.sparkSession.sparkContext.broadcast((codes.mean, codes.rotations, probes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *model, probes = shared.value
        model = Codes(*model)
        asked, length = model.of(probes), (probes ** 2).sum(1)[:, None]
        score, apart = np.zeros((len(probes), 0)), np.zeros((len(probes), 0), np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1))
            square = length + (v ** 2).sum(1) - 2 * probes @ v.T
            near = np.argpartition(square, min(k, len(v) - 1), 1)[:, :k + 1]
            score = np.concatenate([score, np.take_along_axis(square, near, 1)], 1)
            apart = np.concatenate([apart, hamming(asked[:, None], model.of(v)[near])], 1)
            best = np.argsort(score, 1, kind="stable")[:, :k + 1]
            score, apart = np.take_along_axis(score, best, 1), np.take_along_axis(apart, best, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(probes)), score.shape[1])), pa.array(score.ravel()),
                                          pa.array(apart.ravel())], names=["probe", "score", "apart"])

    every = found.select("entry", "v").mapInArrow(run, "probe long, score double, apart int")
    # The nearest of the k + 1 is the probe itself: entries are distinct vectors.
    order = Window.partitionBy("probe").orderBy("score", "apart")
    return every.withColumn("n", F.row_number().over(order)).where(F.col("n").between(2, k + 1)).select("probe", "apart")


def covering_share(probes: np.ndarray, probe: np.ndarray, apart: np.ndarray, sample: np.ndarray) -> float:
    """The share of the sample that radii must hold to cover COVERED of the neighbours at these distances from the probes."""
    if not len(apart):
        return 0.0
    below = np.zeros(len(apart), np.int64)
    for i in np.unique(probe):
        mine = probe == i
        below[mine] = np.searchsorted(np.sort(hamming(probes[i], sample)), apart[mine])
    return float(np.quantile(below, COVERED, method="higher")) / len(sample)


def build_index(found: DataFrame, codes: Codes) -> DataFrame:
    """(part, value, entry, code): every entry once for each substring of its code."""
    shared = found.sparkSession.sparkContext.broadcast((codes.mean, codes.rotations))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Codes(*shared.value)
        for b in batches:
            if b.num_rows:
                code = model.of(_matrix(b.column(1)))
                m = code.shape[1]
                raw = pa.array([x.tobytes() for x in code], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.arange(m, dtype=np.int32), len(code))), pa.array(code.astype(np.int32).ravel()),
                    b.column(0).take(pa.array(np.repeat(np.arange(len(code)), m))), raw.take(pa.array(np.repeat(np.arange(len(code)), m)))],
                    names=["part", "value", "entry", "code"])

    rows = found.select("entry", "v").mapInArrow(run, "part int, value int, entry long, code binary")
    # Codes are balanced, so buckets are even; 16 groups for each substring.
    return rows.repartition("part", F.shiftright("value", 12)).sortWithinPartitions("part", "value")


def probe(index: DataFrame, ids: np.ndarray, query: np.ndarray, radius: np.ndarray) -> DataFrame:
    """(query_id, entry) for every code within each query's radius, found once."""
    shared = index.sparkSession.sparkContext.broadcast((ids, query, radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, query, radius = shared.value
        reach = radius // query.shape[1]
        for b in batches:
            if not b.num_rows:
                continue
            part, value = np.asarray(b.column(0)), np.asarray(b.column(1)).astype(np.uint16)
            code = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint16).reshape(b.num_rows, -1)
            new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (part[1:] != part[:-1])]))
            stop = np.append(new[1:], b.num_rows)
            for i in range(len(ids)):
                # Buckets of each substring within reach, then whole codes within the radius.
                near = np.bitwise_count(value[new] ^ query[i, part[new]]) <= reach[i]
                begin, count = new[near], (stop - new)[near]
                rows = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
                apart = np.bitwise_count(code[rows] ^ query[i])
                hit = apart.sum(1, dtype=np.int32) <= radius[i]
                rows, apart = rows[hit], apart[hit]
                first = (apart <= reach[i]).argmax(1) == part[rows]   # other substrings name it too
                rows = rows[first]
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), ids[i])), b.column(2).take(pa.array(rows))], names=["query_id", "entry"])

    return index.mapInArrow(run, "query_id long, entry long")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding",
            folder: str | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest others; ``is_query`` is an expression on ``vec_id``."""
    spark = vectors.sparkSession
    folder = folder or shared_folder(spark, "neighbours")
    rows = stored(usable(vectors, vec_id, vector), f"{folder}/rows")
    found = stored(entries(rows, k), f"{folder}/entries")
    n = found.count()
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    width = len(found.first()["v"])
    size = min(SAMPLE, max(1, SAMPLE_NUMBERS // width))
    sample = _matrix(found.orderBy(F.xxhash64("entry", F.lit(3)), "entry").limit(size).select("v").toArrow().column(0))
    codes = Codes.fit(sample)
    some = asked.orderBy(F.xxhash64("query_id", F.lit(5)), "query_id").limit(min(PROBES, max(1, SAMPLE_NUMBERS // width))).toArrow()
    share = CANDIDATES / n
    if some.num_rows and share < 1:
        probes = _matrix(some.column(1))
        near = true_neighbours(found, probes, codes, k).toArrow()
        share = max(share, covering_share(codes.of(probes), np.asarray(near.column(0)), np.asarray(near.column(1)), codes.of(sample)))
    index = stored(build_index(found, codes), f"{folder}/index")
    coded = stored(questions(asked, codes, sample, share), f"{folder}/asked")
    blocks = max(1, -(-coded.count() // QUERIES))
    results = []
    for block in range(blocks):
        part = coded.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").toArrow()
        ids, radius = np.asarray(part.column(0)), np.asarray(part.column(2))
        query = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(len(ids), -(-width * ROTATIONS // _BITS))
        first = stored(_ranked(probe(index, ids, query, radius), found, asked, k), f"{folder}/ranked-{block}")
        # All candidates if they are fewer than k, so every query has as many as any other can have.
        full = min(k, rows.count() - 1)
        got = {r["query_id"] for r in first.groupBy("query_id").count().where(F.col("count") >= full).select("query_id").collect()}
        again = np.array([i for i, q in enumerate(ids) if int(q) not in got], np.int64)
        if full and len(again):
            wide = np.full(len(again), query.shape[1] * _BITS, np.int32)
            more = stored(_ranked(probe(index, ids[again], query[again], wide), found, asked, k), f"{folder}/again-{block}")
            first = first.join(more.select("query_id").distinct(), "query_id", "left_anti").union(more)
        results.append(first)
    return reduce(DataFrame.union, results)


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten()).reshape(len(values), -1).astype(np.float64)


def _ranked(pairs: DataFrame, found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    near = pairs.join(found, "entry").join(asked.withColumnRenamed("v", "q"), "query_id")
    scored = near.select("query_id", "ids", distance(F.col("v"), F.col("q")).alias("score"))
    # Among the k + 1 nearest entries are k that are not the query itself.
    by_entry = Window.partitionBy("query_id").orderBy("score", F.col("ids")[0])
    best = scored.withColumn("n", F.row_number().over(by_entry)).where(F.col("n") <= k + 1)
    single = best.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
