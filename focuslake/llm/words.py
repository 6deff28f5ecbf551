"""Whole columns of text as numpy arrays: slices of bounded size, words, word hashes.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D). Its hash is a polynomial
modulo 2^64 over random values of its bytes, so all words of a slice are hashed without a loop.
Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1_000
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _RANDOM.copy()
_FOLDED[65:91] = _RANDOM[97:123]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (int(n) + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for b in (_BASE, inverse):
            p = np.empty(size, np.uint64)
            p[0] = 1
            done, step = 1, b
            while done < size:
                p[done:2 * done] = p[:done] * np.uint64(step)
                done, step = 2 * done, step * step % (1 << 64)
            both.append(p)
        _powers[size] = tuple(both)
    return _powers[size]


@dataclass
class Slice:
    """Consecutive rows of a batch: their texts' bytes on end, and where each begins."""

    first: int
    data: np.ndarray      # uint8
    offsets: np.ndarray   # int64, one more than rows

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of about ``limit`` bytes; a longer text is a slice by itself."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Slice(i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j


@dataclass
class Words:
    start: np.ndarray   # byte positions in the slice
    end: np.ndarray
    row: np.ndarray     # words of row i are row[i]:row[i + 1]

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))


def words(s: Slice, separators: np.ndarray = _SPACE) -> Words:
    """Runs of bytes that are no separators; the end of a text also ends a word."""
    if not len(s.data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(s.rows + 1, np.int64))
    space = separators[s.data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    after = np.empty_like(space)
    after[-1], after[:-1] = True, space[1:]
    inner = s.offsets[(s.offsets > 0) & (s.offsets < len(s.data))]
    before[inner], after[inner - 1] = True, True
    letter = ~space
    start, end = np.flatnonzero(letter & before), np.flatnonzero(letter & after) + 1
    return Words(start, end, np.searchsorted(start, s.offsets))


def span_hashes(s: Slice, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans of a slice; ``fold`` takes A-Z for a-z."""
    power, inverse = _power(len(s.data))
    sums = np.empty(len(s.data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_FOLDED if fold else _RANDOM)[s.data] * power[:len(s.data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs start:end of 64-bit values, in order of the values within a run."""
    power, inverse = _power(len(values))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * power[:len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


def repeat_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] values of each, on end."""
    total = int(count.sum())
    begin = np.cumsum(count) - count
    return np.arange(total) + np.repeat(start - begin, count)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) for tasks that read Arrow batches, which get at most BATCH_ROWS rows: texts may be long."""
    bound_batches(docs)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def bound_batches(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        c.cast(t.type) if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
