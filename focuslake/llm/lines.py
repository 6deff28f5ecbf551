"""Removal of repeated runs of lines by winnowing.

A line is its words, so white space within it does not count, and lines without words are left alone.
A run is repeated if the same lines, with MIN_WORDS words or more in all, stand somewhere before it, in
the order of ``doc_id`` (nulls first), then of the text's hash, then of lines; only runs that do not
overlap their first place are removed. Every smallest run that reaches MIN_WORDS, forward from a line
or back from it, is represented by a window minimum: the least hash of the grams inside it, where a gram
is a smallest run of half as many words. The choice depends on the run's content alone, so two copies of
a run always choose the same fingerprint, and only runs whose fingerprint occurs at two places go on.
These are compared whole, which extends a match both ways line by line, and each one after the first
is removed.

Nulls are empty texts. Repeated rows (equal ``doc_id`` and text) are one document and are cleaned alike.
An empty table gives an empty result; all other columns are kept whatever their names, but for a column
named ``removed``. A long text is worked on whole, with about 100 bytes of memory for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..session import shared_folder
from .components import stored
from .names import plain
from .words import Slice, batch, bound_batches, run_hashes, slices, span_hashes, texts, words

MIN_WORDS = 50
_RUNS = pa.schema([("fingerprint", pa.int64()), ("place", pa.bool_()), ("run", pa.int64()), ("doc_id", pa.int64()),
                   ("text_hash", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
RUNS = "fingerprint long, place boolean, run long, doc_id long, text_hash long, first long, last long"


def _lines(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Where each line begins, and its row; every row has a line."""
    begin = np.flatnonzero(s.data == 10) + 1
    row = np.searchsorted(s.offsets, begin - 1, "right") - 1
    begin, row = np.concatenate([s.offsets[:-1], begin]), np.concatenate([np.arange(s.rows), row])
    order = np.lexsort((begin, row))
    return begin[order], row[order]


def minimal_runs(s: Slice, least: int) -> tuple[np.ndarray, ...]:
    """row, first line, last line, run hash, fingerprint and its place for all smallest runs of a slice."""
    begin, row = _lines(s)
    w = words(s)
    h = span_hashes(s, w.start, w.end)
    count = np.bincount(np.searchsorted(begin, w.start, "right") - 1, minlength=len(begin))
    stop = np.cumsum(count)
    full = np.flatnonzero(count)
    line = run_hashes(h, (stop - count)[full], stop[full])
    number = np.arange(len(begin)) - np.searchsorted(row, row)
    row, number, n = row[full], number[full], len(full)
    c = np.concatenate([[0], np.cumsum(count[full])])
    row_end, row_begin = np.searchsorted(row, row, "right"), np.searchsorted(row, row)
    i = np.arange(n)
    j = np.searchsorted(c, c[:-1] + least) - 1
    ok = j < row_end
    back = np.searchsorted(c, c[1:] - least, "right") - 1
    ok_back = back >= row_begin
    pairs = np.unique(np.concatenate([i[ok] * (n + 1) + j[ok], back[ok_back] * (n + 1) + i[ok_back]]))
    i, j = pairs // (n + 1), pairs % (n + 1)
    gram_end = np.searchsorted(c, c[:-1] + (least + 1) // 2) - 1
    inside = gram_end < n
    gram = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    gram[inside] = run_hashes(line, np.flatnonzero(inside), gram_end[inside] + 1)
    width = np.searchsorted(gram_end, j, "right") - i
    best, place = gram[i], i.copy()
    for o in range(1, int(width.max()) if len(width) else 0):
        some = np.flatnonzero(width > o)
        other = gram[i[some] + o]
        better = other <= best[some]
        best[some[better]], place[some[better]] = other[better], i[some[better]] + o
    return row[i], number[i], number[j], run_hashes(line, i, j + 1), best, place


def all_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """One row per smallest run; ``place`` marks the first run of each place of a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(1)):
                row, first, last, code, best, place = minimal_runs(s, least)
                text = span_hashes(s, s.offsets[:-1], s.offsets[1:])
                new = np.zeros(len(row), bool)
                new[np.unique(place, return_index=True)[1]] = True
                yield batch(_RUNS, best.view(np.int64), new, code.view(np.int64), b.column(0).slice(s.first, s.rows).take(pa.array(row)),
                            text[row].view(np.int64), first, last)

    return texts(docs).mapInArrow(run, RUNS)


def repeated_runs(docs: DataFrame, least: int = MIN_WORDS, folder: str | None = None) -> DataFrame:
    """(doc_id, text_hash, spans) with the line spans that repeat earlier ones, for documents that have any."""
    folder = folder or shared_folder(docs.sparkSession, "lines")
    found = stored(all_runs(docs, least), f"{folder}/runs")
    twice = found.where("place").groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    alike = stored(found.join(twice, "fingerprint", "left_semi").select("run", "doc_id", "text_hash", "first", "last"), f"{folder}/alike")
    where = F.struct("doc_id", "text_hash", "first", "last")
    origin = alike.groupBy("run").agg(F.count("*").alias("n"), F.min(where).alias("origin")).where("n > 1").drop("n")
    later = alike.join(origin, "run").where(
        ~(F.col("doc_id").eqNullSafe(F.col("origin.doc_id")) & (F.col("text_hash") == F.col("origin.text_hash"))
          & (F.col("first") <= F.col("origin.last"))))
    return later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS, folder: str | None = None) -> DataFrame:
    """``docs`` with repeated runs cut out of ``text``, and ``removed``: the numbers of the lines cut."""
    spans = repeated_runs(docs, least, folder).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
    docs = docs.drop("removed")
    at, inner = docs.columns.index("text"), plain(docs.columns)
    hashed = _with_text_hash(docs.toDF(*inner), at)
    doc_id = F.col(inner[docs.columns.index("doc_id")])
    joined = hashed.join(spans, F.col("_text_hash").eqNullSafe(F.col("_hash")) & doc_id.eqNullSafe(F.col("_id")), "left")
    rows = joined.select(*inner, "_spans")
    kept = [StructField(f.name, StringType() if f.name == "text" else f.dataType) for f in docs.schema.fields]
    schema = StructType(kept).add("removed", ArrayType(LongType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed = [], []
            for text, spans in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                gone = sorted({n for x in spans or () for n in range(x["first"], x["last"] + 1)})
                if gone:
                    parts = text.split("\n")
                    gone = [n for n in gone if parts[n].strip("\t\n\x0b\x0c\r ")]
                    drop = set(gone)
                    text = "\n".join(p for n, p in enumerate(parts) if n not in drop)
                texts.append(text)
                removed.append(gone)
            columns = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.list_(pa.int64()))], names=schema.names)

    return bound_batches(rows).mapInArrow(cut, schema)


def _with_text_hash(docs: DataFrame, at: int) -> DataFrame:
    """``docs`` with ``_text_hash`` of column ``at``, made as in ``all_runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = [span_hashes(s, s.offsets[:-1], s.offsets[1:]) for s in slices(b.column(at).cast(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(codes).view(np.int64))], names=[*b.schema.names, "_text_hash"])

    return bound_batches(docs).mapInArrow(run, StructType([*docs.schema.fields]).add("_text_hash", "long"))
