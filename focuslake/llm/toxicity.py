"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of those before it.

Features are hashed words (A-Z lower-cased, ASCII signs and digits cut away) and their beginnings of four
and six bytes, present or not. A bounded sample of labelled documents (SAMPLE rows, those with the least
hash of ``doc_id``) fits the models: feature counts are added up over tasks, the FEATURES bins that tell
most about some category are kept, and logistic models are trained in order of the chain. The
probabilities that later models see in training are out of fold: each row's come from a model fitted
without its fold. All documents are then scored in one pass over their whole texts.

Nulls are empty texts and get the models' base rates; repeated rows get equal results; a category
without both labels in the sample gets its base rate; an empty table gives an empty result. All columns
are kept; columns named like a result (``p_<category>``, ``is_<category>``) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..session import shared_folder
from .components import stored
from .words import bound_batches, mix, slices, span_hashes, texts, words

SAMPLE = 40_000      # labelled rows at most that fit the models
FEATURES = 2_048
FOLDS = 5
EPOCHS = 8           # and STEPS steps at least
STEPS = 600
THRESHOLD = 0.5
_BITS = 20
_BLOCK = 1 << 16
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[65:91] = _NO_LETTER[97:123] = _NO_LETTER[128:] = False


def features(s) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of all words and beginnings of a slice, not yet distinct."""
    w = words(s, _NO_LETTER)
    owner, bins = w.owner(), []
    for salt, length in enumerate((1 << 40, 4, 6)):
        end = np.minimum(w.end, w.start + length)
        bins.append(mix(span_hashes(s, w.start, end, fold=True) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - _BITS))
    return np.tile(owner, 3), np.concatenate(bins).astype(np.int64)


@dataclass
class Chain:
    """Models in order: ``weights`` holds, for each category, those of the bins, of earlier categories and the bias."""

    categories: list[str]
    bins: np.ndarray
    weights: list[np.ndarray]

    def probabilities(self, rows: int, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        out = np.zeros((rows, len(self.categories)))
        for c, w in enumerate(self.weights):
            margin = np.bincount(row, weights=w[feature], minlength=rows) + out[:, :c] @ w[len(self.bins):-1] + w[-1]
            out[:, c] = 1 / (1 + np.exp(-margin))
        return out


def _present(s, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of the kept bins."""
    row, code = features(s)
    feature = number[code]
    some = feature >= 0
    pairs = np.unique(row[some] * (len(number) + 1) + feature[some])
    return pairs // (len(number) + 1), pairs % (len(number) + 1)


def _numbers(bins: np.ndarray) -> np.ndarray:
    number = np.full(1 << _BITS, -1, np.int32)
    number[bins] = np.arange(len(bins))
    return number


def sample_of(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = SAMPLE) -> DataFrame:
    """(doc_id, text, labels) of at most ``rows`` labelled documents. The ids sent to all tasks are bounded by it."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.array(*[F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)) for c in categories]).alias("labels"))
    picked = known.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return texts(docs).join(F.broadcast(picked), "doc_id")


def useful_bins(sample: DataFrame, categories: int, keep: int = FEATURES) -> np.ndarray:
    """The bins whose presence differs most, in standard errors, between the labels of some category."""
    blocks = (1 << _BITS) // _BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros((categories + 1, 1 << _BITS), np.int32), np.zeros(categories + 1, np.int64)
        for b in batches:
            y = np.array(b.column(2).to_pylist(), bool).reshape(b.num_rows, categories)
            for s in slices(b.column(1)):
                row, code = features(s)
                pairs = np.unique(row << _BITS | code)
                row, code = pairs >> _BITS, pairs & (1 << _BITS) - 1
                here = y[s.first:s.first + s.rows]
                for c in range(categories + 1):
                    some = here[:, c - 1] if c else np.ones(s.rows, bool)
                    docs[c] += some.sum()
                    seen[c] += np.bincount(code[some[row]], minlength=1 << _BITS).astype(np.int32)
        if docs[0]:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(blocks)), pa.array([seen[:, k * _BLOCK:(k + 1) * _BLOCK].tobytes() for k in range(blocks)], pa.binary()),
                pa.array([docs.tobytes()] * blocks, pa.binary())], names=["block", "seen", "docs"])

    def best(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros((categories + 1, _BLOCK), np.int64), np.zeros(categories + 1, np.int64)
        for t in tables:
            for raw, n in zip(t.column(1), t.column(2)):
                seen += np.frombuffer(raw.as_buffer(), np.int32).reshape(seen.shape)
                docs += np.frombuffer(n.as_buffer(), np.int64)
        score = np.zeros(_BLOCK)
        for c in range(1, categories + 1):
            yes, no = seen[c] + 0.5, seen[0] - seen[c] + 0.5
            ratio = np.log(yes / (docs[c] + 1)) - np.log(no / (docs[0] - docs[c] + 1))
            score = np.maximum(score, np.where(seen[0] > 2, np.abs(ratio) / np.sqrt(1 / yes + 1 / no), 0))
        top = np.argsort(-score, kind="stable")[:keep]
        top = top[score[top] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(key[0].as_py() * _BLOCK + top), pa.array(score[top])], names=["bin", "score"])

    sums = sample.select("doc_id", "text", "labels").mapInArrow(count, "block long, seen binary, docs binary")
    # Each task adds up one block of bins: as many rows as tasks have read.
    found = sums.groupBy("block").applyInArrow(best, "bin long, score double")
    rows = found.orderBy(F.desc("score"), "bin").limit(keep).collect()  # at most ``keep`` numbers
    return np.array(sorted(r["bin"] for r in rows), np.int64)


def _fit(row: np.ndarray, feature: np.ndarray, earlier: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Logistic weights for sparse 0/1 features, dense earlier probabilities and a bias."""
    dense, size = earlier.shape[1], n + earlier.shape[1] + 1
    w, speed = np.zeros(size), np.full(size, 1e-2)
    rate = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    w[-1] = np.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return w
    begin = np.searchsorted(row, np.arange(len(y) + 1))
    random = np.random.default_rng(3)
    for _ in range(max(EPOCHS, STEPS * 128 // len(y))):
        order = random.permutation(len(y))
        for at in range(0, len(order), 128):
            some = order[at:at + 128]
            count = begin[some + 1] - begin[some]
            inner = np.repeat(np.arange(len(some)), count)
            f = feature[np.arange(count.sum()) + np.repeat(begin[some] - (np.cumsum(count) - count), count)]
            margin = np.bincount(inner, weights=w[f], minlength=len(some)) + earlier[some] @ w[n:n + dense] + w[-1]
            error = (1 / (1 + np.exp(-margin)) - y[some]) / len(some)
            gradient = np.zeros(size)
            gradient[:n] = np.bincount(f, weights=error[inner], minlength=n)
            gradient[n:n + dense] = earlier[some].T @ error
            gradient[-1] = error.sum()
            gradient[:-1] += 1e-5 * w[:-1]
            speed += gradient ** 2
            w -= 0.3 * gradient / np.sqrt(speed)
    return w


def train(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = SAMPLE, keep: int = FEATURES,
          folder: str | None = None) -> Chain:
    folder = folder or shared_folder(docs.sparkSession, "toxicity")
    sample = stored(sample_of(docs, labels, categories, rows).dropDuplicates(["doc_id"]), f"{folder}/sample")
    bins = useful_bins(sample, len(categories), keep)
    n = len(bins)
    number = docs.sparkSession.sparkContext.broadcast(_numbers(bins))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(1)):
                row, feature = _present(s, number.value)
                flags = np.zeros((s.rows, max(n, 1)), bool)
                flags[row, feature] = True
                packed = np.packbits(flags, axis=1)
                part = b.slice(s.first, s.rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.tobytes() for x in packed], pa.binary()), part.column(2)], names=["doc_id", "bits", "labels"])

    rows_ = sample.select("doc_id", "text", "labels").mapInArrow(bits, "doc_id long, bits binary, labels array<int>")
    known = stored(rows_.select("*", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).alias("fold"),
                                F.array().cast("array<double>").alias("earlier")), f"{folder}/bits")
    weights = []
    for c in range(len(categories)):
        fits = stored(_fold_models(known, c, n), f"{folder}/fits-{c}")
        # One row for each category.
        weights.append(np.array(fits.where("doc_id is null").first()["weights"]) if not known.isEmpty() else np.zeros(n + c + 1))
        known = stored(known.join(fits.where("doc_id is not null").select("doc_id", "p"), "doc_id").select(
            "doc_id", "bits", "labels", "fold", F.concat("earlier", F.array("p")).alias("earlier")), f"{folder}/known-{c}")
    return Chain(list(categories), bins, weights)


def _fold_models(known: DataFrame, c: int, n: int) -> DataFrame:
    """(doc_id, p, weights): out-of-fold probabilities of category c, and one row with the weights for use."""
    schema = pa.schema([("doc_id", pa.int64()), ("p", pa.float64()), ("weights", pa.list_(pa.float64()))])

    def run(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, model = pa.Table.from_batches(list(tables)).sort_by("doc_id"), key[0].as_py()
        rows = t.num_rows
        flags = np.unpackbits(np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(rows, -1), axis=1)[:, :n]
        y = np.array(t.column("labels").to_pylist())[:, c]
        earlier = np.array(t.column("earlier").to_pylist(), float).reshape(rows, c)
        fold = np.asarray(t.column("fold"))
        train = fold != model
        w = _fit(*np.nonzero(flags[train]), earlier[train], y[train], n)
        if model == FOLDS:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.float64()), pa.array([w.tolist()])], schema=schema)
        else:
            rest = ~train
            row, feature = np.nonzero(flags[rest])
            margin = np.bincount(row, weights=w[feature], minlength=rest.sum()) + earlier[rest] @ w[n:-1] + w[-1]
            yield pa.RecordBatch.from_arrays([
                t.column("doc_id").combine_chunks().filter(pa.array(rest)), pa.array(1 / (1 + np.exp(-margin))),
                pa.nulls(int(rest.sum()), pa.list_(pa.float64()))], schema=schema)

    # The groups are the folds; each holds the bounded sample.
    models = known.select("doc_id", "bits", "labels", "earlier", "fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))).alias("model"))
    return models.groupBy("model").applyInArrow(run, "doc_id long, p double, weights array<double>")


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``p_<category>`` and ``is_<category>`` for each category."""
    added = [f"p_{c}" for c in chain.categories] + [f"is_{c}" for c in chain.categories]
    docs = docs.drop(*added)
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields])
    for name in added:
        schema = schema.add(name, "double" if name.startswith("p_") else "boolean")
    shared = docs.sparkSession.sparkContext.broadcast((chain.categories, chain.bins, chain.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(*shared.value)
        number = _numbers(model.bins)
        for b in batches:
            if not b.num_rows:
                continue
            p = np.concatenate([model.probabilities(s.rows, *_present(s, number)) for s in slices(b.column(at).cast(pa.string()))])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(x) for x in p.T), *(pa.array(x >= threshold) for x in p.T)], names=[*b.schema.names, *added])

    return bound_batches(docs).mapInArrow(run, schema)
