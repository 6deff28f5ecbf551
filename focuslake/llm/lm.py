"""Language-model scores by online logistic mixing of hashed contexts.

A text is its bytes and an end sign. Each is coded by the bits of a Huffman code of the training bytes, so
frequent bytes take few binary decisions. For every decision four contexts (the two, three and four bytes
before, and the word so far) look up bit counts in hashed tables, each giving the logit of its own
estimate. A logistic mixer adds the logits with weights gated by how far the decision is into the code and
how often the longer contexts were met, and an adaptive map per decision refines the sum. The logarithms of all
decisions' probabilities add up to that of the text.

Training is one pass: a task predicts each slice from the counts it has so far, moves the weights by the
error and the refinement by the outcome of all its bits, and only then
adds the slice's bits to its counts. Counts and refinements are added up over tasks, weights averaged by
the bits they saw. The tables have a fixed size; what tasks send is in proportion to their number.

Within a slice equal (contexts, byte) pairs are counted and predicted once. The unigram base counts
lower-cased words over all training texts; the HOT most frequent are sent to the scoring tasks, all others
are joined.

Nulls are empty texts: an end sign alone. A null ``doc_id`` counts as the empty text for the split.
Repeated rows all train and get equal scores. An empty table gives an empty result; without training texts
every word has probability 1 under the base (V = 0). Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import shared_folder
from .components import stored
from .words import _FOLDED, _RANDOM, _power, bound_batches, mix, slices, span_hashes, words

HOT = 1_000_000        # words at most whose counts are sent to all tasks: 16 MB
TABLE_BITS = (18, 20, 21, 23)   # of the four contexts' tables
MERGE = 4              # input partitions to a training task
_CONTEXTS = 4
_BUCKETS = 33          # of the refinement, over logits of -8..8
_SYMBOLS = 257
_END = 256
_BLOCK = 1 << 16
_PRIOR = 0.35
_LEVELS = 4            # of a context's count: never, once or twice, up to 15, more
_DEPTHS = 4
_LETTER = np.zeros(257, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:256] = True
END_WORD = int(mix(np.array([0xE0D], np.uint64)).view(np.int64)[0])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


# --- the code of a byte ---------------------------------------------------------------------------

class Code:
    """Huffman paths: symbol s decides ``bit`` at ``node`` for begin[s]:begin[s + 1]."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, s, None) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        n = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], n, (a, b)))
            n += 1
        paths: list[list[tuple[int, int]]] = [[] for _ in counts]
        todo, number = [(heap[0], [])], 0
        while todo:
            (_, s, pair), path = todo.pop()
            if pair is None:
                paths[s] = path
            else:
                todo += [(pair[0], path + [(number, 0)]), (pair[1], path + [(number, 1)])]
                number += 1
        self.nodes = number
        self.length = np.array([len(p) for p in paths])
        self.begin = np.concatenate([[0], np.cumsum(self.length)])
        self.node = np.array([x for p in paths for x, _ in p], np.int64)
        self.bit = np.array([y for p in paths for _, y in p], np.int8)
        self.depth = np.zeros(number, np.int64)
        for p in paths:
            for i, (x, _) in enumerate(p):
                self.depth[x] = i


# --- contexts -------------------------------------------------------------------------------------

class Distinct:
    """The distinct (contexts, symbol) pairs of a slice, and which of them stands at each position."""

    def __init__(self, s):
        begin = s.offsets + np.arange(s.rows + 1)
        x = np.insert(s.data.astype(np.uint64), s.offsets[1:], np.uint64(_END))
        self.begin, n, start = begin, len(x), begin[:-1]
        one = np.concatenate([[np.uint64(0)], x[:-1]])
        one[start] = 0
        two = one.copy()
        two[1:] |= one[:-1] << np.uint64(9)
        two[start] = 0
        four = two.copy()
        four[2:] |= two[:-2] << np.uint64(18)
        long = start[np.diff(begin) > 1]
        four[start], four[long + 1] = 0, two[long + 1]
        three = four & np.uint64((1 << 27) - 1)
        power, inverse = _power(n)
        folded = np.append(_FOLDED, _RANDOM[:1])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(folded[x] * power[:n])])
        first = np.arange(n)               # where the word so far began
        first[1:][_LETTER[x[:-1]]] = 0
        first[start] = start
        np.maximum.accumulate(first, out=first)
        word = (sums[:-1] - sums[first]) * inverse[first]
        salts = (np.arange(_CONTEXTS) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        contexts = [two, three, four, word]
        # One number orders the pairs and keeps a position: SIMD sorts beat an argsort.
        bits = max(1, int(n - 1).bit_length())
        key = (four * np.uint64(0x9FB21C651E98DF25) ^ word) + x * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        order = np.sort(key >> np.uint64(bits) << np.uint64(bits) | np.arange(n).astype(np.uint64))
        at = (order & np.uint64((1 << bits) - 1)).astype(np.int64)
        order >>= np.uint64(bits)
        new = np.concatenate([[True], order[1:] != order[:-1]])
        chosen = np.flatnonzero(new)
        self.count = np.diff(np.append(chosen, n))
        self.of = np.empty(n, np.int64)
        self.of[at] = np.cumsum(new) - 1
        at = at[chosen]
        self.symbol = x[at].astype(np.int64)
        self.context = [mix(c[at] + salt) for c, salt in zip(contexts, salts)]

    def decisions(self, code: Code, some: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """owner, node, bit of all binary decisions of (some of) the pairs."""
        symbol = self.symbol if some is None else self.symbol[some]
        count = code.length[symbol]
        stop = np.cumsum(count)
        owner = np.repeat(np.arange(len(symbol)) if some is None else some, count)
        at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(code.begin[symbol] - (stop - count), count)
        return owner, code.node[at], code.bit[at]

    def slots(self, owner: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
        salted = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        return [((c[owner] ^ salted) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int32)
                for c, bits in zip(self.context, TABLE_BITS)]


def level(n: np.ndarray) -> np.ndarray:
    return (n > 0).astype(np.int16) + (n > 2) + (n > 15)


def gates(depth: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    return ((np.minimum(depth, _DEPTHS - 1) * _LEVELS + levels[1]) * _LEVELS + levels[2]) * _LEVELS + levels[3]


_GATES = _DEPTHS * _LEVELS ** 3


def _bucket(logit: np.ndarray) -> np.ndarray:
    return (np.clip(logit, -7.99, 7.99) * 2 + 16.5).astype(np.int64)


def _entry(no: np.ndarray, yes: np.ndarray) -> np.ndarray:
    """A table's 16 bits: the logit in sixteenths, and the level of the count in the last two."""
    logit = np.clip(np.rint(np.log((yes + _PRIOR) / (no + _PRIOR)) * 16), -127, 127).astype(np.int16)
    return logit * 4 + level(no + yes)


# --- training -------------------------------------------------------------------------------------

class Learner:
    """One task's counts, weights and refinement."""

    def __init__(self, code: Code):
        self.code = code
        self.counts = [np.zeros(2 << bits, np.uint32) for bits in TABLE_BITS]   # 2 x slot + bit
        self.weights = np.full((_GATES, _CONTEXTS), 0.3)
        self.curve = np.full_like(self.weights, 50.0)
        self.refined = np.zeros((code.nodes, _BUCKETS, 2))
        self.bits = 0

    def learn(self, s) -> None:
        d = Distinct(s)
        owner, node, bit = d.decisions(self.code)
        weight, slots = d.count[owner].astype(np.uint32), d.slots(owner, node)
        self._mix(node, bit, weight, slots)
        self.bits += int(weight.sum())
        for k, slot in enumerate(slots):
            np.add.at(self.counts[k], 2 * slot + bit, weight)

    def _mix(self, node: np.ndarray, bit: np.ndarray, weight: np.ndarray, slots: list[np.ndarray], piece: int = 1 << 17) -> None:
        """One step by all decisions of a slice, worked out piece by piece."""
        weights, (slope, bend) = self.weights.astype(np.float32), np.zeros((2, _GATES, _CONTEXTS))
        for at in range(0, len(node), piece):
            some = slice(at, at + piece)
            logits, levels = [], []
            for k, slot in enumerate(slots):
                pair = self.counts[k].reshape(-1, 2)[slot[some]]
                log = np.log(pair.astype(np.float32) + np.float32(_PRIOR))
                logits.append(np.clip(log[:, 1] - log[:, 0], -7.9, 7.9))
                levels.append(level(pair[:, 0] + pair[:, 1]))
            gate = gates(self.code.depth[node[some]], levels)
            mixed = np.clip(sum(weights[gate, k] * x for k, x in enumerate(logits)), -12, 12)
            n, p = weight[some].astype(np.float32), 1 / (1 + np.exp(-mixed))
            cell = (node[some] * _BUCKETS + _bucket(mixed)) * 2 + bit[some]
            self.refined += np.bincount(cell, weights=n, minlength=self.refined.size).reshape(self.refined.shape)
            error, bent = (bit[some] - p) * n, p * (1 - p) * n
            for k, x in enumerate(logits):
                slope[:, k] += np.bincount(gate, weights=error * x, minlength=_GATES)
                bend[:, k] += np.bincount(gate, weights=bent * x * x, minlength=_GATES)
        # A step towards the minimum along each weight, by the curvature of what was seen lately.
        self.curve = 0.98 * self.curve + bend
        self.weights += 0.5 * slope / self.curve


def train(training: DataFrame, code: Code, folder: str) -> Model:
    """Tables, weights and refinement from all training texts (doc_id, text)."""
    shared = training.sparkSession.sparkContext.broadcast(code.__dict__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code.__new__(Code)
        code.__dict__.update(shared.value)
        learner = Learner(code)
        for b in batches:
            for s in slices(b.column(1)):
                learner.learn(s)
        if not learner.bits:
            return
        for k in range(_CONTEXTS):
            pairs, blocks = learner.counts[k].reshape(-1, 2), (1 << TABLE_BITS[k]) // _BLOCK
            high = pairs.max(1)
            scale = np.maximum(1, high / 60000.0)    # large counts keep their ratio
            small = np.ceil(pairs / scale[:, None]).astype(np.uint16) if (high > 60000).any() else pairs.astype(np.uint16)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(blocks, k)), pa.array(np.arange(blocks)),
                pa.array([small[i * _BLOCK:(i + 1) * _BLOCK].tobytes() for i in range(blocks)], pa.binary())], names=["k", "block", "raw"])
        state = np.concatenate([[learner.bits], (learner.weights * learner.bits).ravel(), learner.refined.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0]), pa.array([state.tobytes()], pa.binary())], names=["k", "block", "raw"])

    def merge(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for t in tables:
            for raw in t.column(2):
                x = np.frombuffer(raw.as_buffer(), np.uint16 if key[0].as_py() >= 0 else np.float64).astype(np.float64)
                total = x if total is None else total + x
        if key[0].as_py() >= 0:
            no, yes = total.reshape(-1, 2).T
            total = _entry(no, yes)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), pa.array([total.tobytes()], pa.binary())],
                                         names=["k", "block", "raw"])

    schema = "k long, block long, raw binary"
    tasks = max(1, -(-training.rdd.getNumPartitions() // MERGE))
    parts = bound_batches(training).coalesce(tasks).mapInArrow(run, schema)
    merged = stored(parts.groupBy("k", "block").applyInArrow(merge, schema), f"{folder}/model")
    # The model's size is fixed: 23 MB of tables, and the weights.
    tables = [np.zeros(1 << bits, np.int16) for bits in TABLE_BITS]
    weights, refined = np.full((_GATES, _CONTEXTS), 0.3), np.zeros((code.nodes, _BUCKETS, 2))
    for r in merged.toLocalIterator():
        if r["k"] >= 0:
            tables[r["k"]][r["block"] * _BLOCK:(r["block"] + 1) * _BLOCK] = np.frombuffer(r["raw"], np.int16)
        else:
            state = np.frombuffer(r["raw"])
            weights = (state[1:1 + weights.size] / state[0]).reshape(weights.shape)
            refined = state[1 + weights.size:].reshape(refined.shape)
    return Model(code, tables, weights, refined)


class Model:
    """What scoring needs; ``score`` gives log10 of each text's probability."""

    def __init__(self, code: Code, tables: list[np.ndarray], weights: np.ndarray, refined: np.ndarray):
        self.code, self.tables = code, tables
        self.weights = np.ascontiguousarray((weights / 16).T, np.float32)
        centre = (np.arange(_BUCKETS) - 16) / 2
        prior = 40 / (1 + np.exp(-np.stack([centre, -centre], 1)))   # an outcome is as likely as the mixer says
        told = refined + prior[None, :, ::-1]
        self.refined = np.log(told[..., 1] / told[..., 0]).ravel().astype(np.float32)

    def score(self, s) -> np.ndarray:
        d = Distinct(s)
        owner, node, bit = d.decisions(self.code)
        looked = [t[slot] for t, slot in zip(self.tables, d.slots(owner, node))]
        gate = gates(self.code.depth[node], [x & 3 for x in looked])
        mixed = np.zeros(len(owner), np.float32)
        for k, x in enumerate(looked):
            mixed += self.weights[k][gate] * (x >> 2)
        mixed = np.clip(mixed, -12, 12)
        logit = (mixed + self.refined[node * _BUCKETS + _bucket(mixed)]) * (np.float32(0.5) - bit)
        cost = np.bincount(owner, weights=np.log1p(np.exp(logit)), minlength=len(d.symbol))
        return -np.add.reduceat(cost[d.of], d.begin[:-1]) / np.log(10)


# --- words ----------------------------------------------------------------------------------------

def word_counts(training: DataFrame, folder: str) -> tuple[DataFrame, np.ndarray]:
    """(token, n) over all training texts, and the counts of their bytes and ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, signs = [], 0, np.zeros(_SYMBOLS, np.int64)

        def flush():
            values, back = np.unique(np.concatenate([x for x, _ in kept]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([y for _, y in kept])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n), pa.nulls(len(n), pa.int32())], names=["token", "n", "sign"])

        for b in batches:
            for s in slices(b.column(1)):
                w = words(s)
                kept.append(np.unique(span_hashes(s, w.start, w.end, fold=True), return_counts=True))
                signs[:256] += np.bincount(s.data, minlength=256)
                signs[_END] += s.rows
                held += len(kept[-1][0])
                if held > 3_000_000:
                    yield flush()
                    kept, held = [], 0
        if kept:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([END_WORD]), pa.array([signs[_END]]), pa.nulls(1, pa.int32())], names=["token", "n", "sign"])
        yield pa.RecordBatch.from_arrays([pa.nulls(_SYMBOLS, pa.int64()), pa.array(signs), pa.array(np.arange(_SYMBOLS, dtype=np.int32))], names=["token", "n", "sign"])

    found = bound_batches(training).mapInArrow(run, "token long, n long, sign int")
    counts = stored(found.groupBy("token", "sign").agg(F.sum("n").alias("n")).where("n > 0"), f"{folder}/counts")
    signs = np.zeros(_SYMBOLS, np.int64)
    for r in counts.where("sign is not null").collect():   # one row for each byte
        signs[r["sign"]] = r["n"]
    return counts.where("token is not null").select("token", "n"), signs


def hot_words(counts: DataFrame, limit: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, at most ``limit``, by hash: hashes and counts."""
    by_count = counts.groupBy("n").count().orderBy(F.desc("n"))   # few: the counts that occur
    least, have = None, 0
    for r in by_count.toLocalIterator():
        have += r["count"]
        if have > limit:
            break
        least = r["n"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot = counts.where(F.col("n") >= least).toArrow()
    token, n = np.asarray(hot.column(0).combine_chunks()), np.asarray(hot.column(1).combine_chunks())
    order = np.argsort(token)
    return token[order], n[order]


def scores(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for every row."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "lm")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out"))
    training = rows.where(~F.col("held_out")).select("doc_id", "text")
    counts, signs = word_counts(training, folder)
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, floor = sums["n"], sums["n"] + 0.5 * (sums["v"] + 1)
    model = train(training, Code(signs), folder)
    shared = spark.sparkContext.broadcast((model.__dict__ | {"code": model.code.__dict__}, hot_words(counts), floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, (hot, hot_n), floor = shared.value
        model = Model.__new__(Model)
        model.__dict__.update(state)
        model.code = Code.__new__(Code)
        model.code.__dict__.update(state["code"])
        for b in batches:
            for s in slices(b.column(1)):
                w = words(s)
                token = np.insert(span_hashes(s, w.start, w.end, fold=True).view(np.int64), w.row[1:], END_WORD)
                row = w.row + np.arange(s.rows + 1)
                at = np.minimum(np.searchsorted(hot, token), max(len(hot) - 1, 0))
                known = hot[at] == token if len(hot) else np.zeros(len(token), bool)
                base = np.zeros(len(token))
                base[known] = np.log10((hot_n[at[known]] + 0.5) / floor)
                rest_row = np.cumsum(~known)
                stop = rest_row[row[1:] - 1]
                rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(token[~known]))
                part = b.slice(s.first, s.rows)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array(span_hashes(s, s.offsets[:-1], s.offsets[1:]).view(np.int64)),
                    pa.array(np.diff(row)), pa.array(np.add.reduceat(known.astype(np.int64), row[:-1])),
                    pa.array(np.add.reduceat(base, row[:-1])), pa.array(model.score(s)), pa.array(np.diff(s.offsets).astype(np.int64)), rest],
                    names=["doc_id", "held_out", "text_hash", "n_tokens", "known", "base", "score", "n_bytes", "rest"])

    scored = stored(bound_batches(rows).mapInArrow(
        run, "doc_id long, held_out boolean, text_hash long, n_tokens long, known long, base double, score double, n_bytes long, rest array<long>"),
        f"{folder}/scored")
    # Words that are not sent: repeated rows name the same ones, which count once.
    rest = scored.select("doc_id", "text_hash", F.explode("rest").alias("token")).repartition("token")
    once = scored.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    looked = rest.join(counts, "token", "left").groupBy("doc_id", "text_hash").agg(
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(floor))).alias("rest_base"), F.count("n").alias("rest_known"))
    looked = looked.join(once, looked["doc_id"].eqNullSafe(once["doc_id"]) & (looked["text_hash"] == once["text_hash"])).select(
        looked["doc_id"].alias("_id"), looked["text_hash"].alias("_hash"), (F.col("rest_base") / F.col("copies")).alias("rest_base"),
        (F.col("rest_known") / F.col("copies")).cast("long").alias("rest_known"))
    found = scored.drop("rest").join(looked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest_base", F.lit(0.0))).alias("base_score"), "score",
        "n_bytes", (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
