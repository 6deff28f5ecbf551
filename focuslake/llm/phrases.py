"""Collocations: phrases whose words occur together far more often than their parts do.

Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces, and those at blanks and tabs into words. Every
word leads one window: itself and the words behind it up to the longest phrase, padded where the piece ends. Only these
longest windows are counted. A phrase's count is then the sum over all windows it begins, which one ROLLUP
over the windows' columns gives for every length, so no shorter phrase is ever written out.

Three steps keep the windows few, and none changes a count that is used:

* A phrase found ``least`` times has only words found as often, so other words are padding and lead no window. Words are
  numbers here, the LISTED most frequent by rank; the list is all that tasks are sent. Where more words are frequent, the
  rest go by their hash (64 bits).
* Tasks count HELD windows at a time before they are dealt out by their first two words. Pairs of words that may be
  hot, each of them a share of 1 / HOT of all words, are dealt out by the third word too.
* So each task knows the counts of its pairs, and windows below ``least`` become padding from there on, before the ROLLUP.

``l * r`` and ``a * a`` are decimals of 38 digits, exact up to 10^15 words. Languages are apart; null is ``und``.
Null and empty texts, and pieces without words, have no windows. Repeated rows count each time, so a null ``doc_id`` is
no matter. Ties go to the larger count, then the phrase in the order of its bytes. An empty table gives an empty result. Only ``lang`` and
``text`` are read, so other columns of any name do no harm. Long texts are read in blocks of BLOCK bytes that end behind a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_folder
from .components import stored
from .words import LOWER, Slice, bound_batches, mix, repeat_ranges, slices, span_hashes, words

BLOCK = 1 << 21
LISTED = 1 << 20
HELD = 1 << 20
HOT = 1_000
SALTS = 64
NO_LANG = "und"
_BITS = 21                 # of a listed word's number, when windows are packed for counting
_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
_EDGES = _BREAKS.copy()
_EDGES[[9, 32]] = True


def spoken(docs: DataFrame) -> DataFrame:
    return bound_batches(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[Slice, bool]]:
    """Slices, and whether the text goes on in the next one: a long text is cut behind a blank or a break."""
    for s in slices(column, limit):
        at, n = 0, len(s.data)
        while s.rows == 1 and n - at > limit:
            edge = np.flatnonzero(_EDGES[s.data[at:at + limit]])
            if len(edge):
                stop = at + int(edge[-1]) + 1
            else:
                stop = next((k + int(e[0]) + 1 for k in range(at + limit, n, limit) if len(e := np.flatnonzero(_EDGES[s.data[k:k + limit]]))), n)
            if stop == n:
                break
            yield Slice(s.first, s.data[at:stop], np.array([0, stop - at])), True
            at = stop
        yield Slice(s.first, s.data[at:], s.offsets if not at else np.array([0, n - at])), False


def lang_keys(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """The number of each row's language in a list, and the list."""
    coded = pc.dictionary_encode(column)
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def word_keys(s: Slice, w, lang: np.ndarray, names: list[str]) -> np.ndarray:
    """64-bit keys of (language, word)."""
    raw = pa.array(names + [""], pa.string())
    seeds = [span_hashes(t, t.offsets[:-1], t.offsets[1:]) for t in slices(raw)]
    # Mixed again: languages' names are words too, and "en" in "es" is not "es" in "en".
    return mix(span_hashes(s, w.start, w.end, fold=True) ^ mix(~np.concatenate(seeds))[lang])


def strings(s: Slice, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    raw = LOWER[s.data[repeat_ranges(start, size)]].tobytes()
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(raw)).cast(pa.string())


def vocabulary(docs: DataFrame) -> DataFrame:
    """(lang, word, key, n): occurrences of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, names = lang_keys(b.column(0))
            for s, _ in blocks(b.column(1)):
                w = words(s, _EDGES)
                owner = lang[s.first + w.owner()]
                keys, first, n = np.unique(word_keys(s, w, owner, names), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()).take(pa.array(owner[first])), strings(s, w.start[first], w.end[first]),
                     pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "word", "key", "n"])

    found = spoken(docs).mapInArrow(run, "lang string, word string, key long, n long")
    return found.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


class Numbers:
    """Numbers of words: 1, 2 .. by falling frequency, 0 for words that are rare, negative for those beyond the list."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, complete: bool, hot: int):
        order = np.lexsort((keys, -counts))
        ranked = keys[order].view(np.uint64)
        self.order = np.argsort(ranked)
        self.keys, self.complete = ranked[self.order], complete
        self.hot = int((counts >= hot).sum())      # numbers up to this one are of hot words

    @classmethod
    def of(cls, vocab: DataFrame, least: int, total: int, listed: int = LISTED) -> Numbers:
        """The list holds whole classes of words of like frequency, at most ``listed`` words."""
        likeness = F.floor(F.log2("n") * 16)
        known = vocab.where(F.col("n") >= least)
        sizes = sorted(((r.c, r.words) for r in known.groupBy(likeness.alias("c")).agg(F.count("*").alias("words")).collect()), reverse=True)
        upto = np.cumsum([w for _, w in sizes])
        kept = [c for (c, _), u in zip(sizes, upto) if u <= listed]
        chosen = known.where(likeness >= min(kept)) if kept else known.where(F.lit(False))
        rows = chosen.select("key", "n").toArrow()
        return cls(*(rows.column(c).to_numpy() for c in ("key", "n")), len(kept) == len(sizes), max(1, total // HOT))

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64) if self.complete else self._hashed(keys)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.order[at] + 1, 0 if self.complete else self._hashed(keys))

    @staticmethod
    def _hashed(keys: np.ndarray) -> np.ndarray:
        return (keys | np.uint64(1 << 63)).view(np.int64)


def lead(ids: np.ndarray, piece: np.ndarray, order: int) -> np.ndarray:
    """One row for each column of the windows: the word itself, the next one, .. ; 0 beyond the piece or a rare word."""
    out = np.zeros((order, len(ids)), np.int64)
    out[0] = ids
    for k in range(1, order):
        same = (piece[k:] == piece[:-k]) & (out[k - 1, :-k] != 0) if len(ids) > k else np.zeros(0, bool)
        out[k, :len(same)] = np.where(same, ids[k:], 0)
    return out


def counted(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows (columns) and how often each occurs."""
    if not windows.shape[1]:
        return windows, np.zeros(0, np.int64)
    if len(windows) * _BITS <= 63 and windows.min() >= 0 and windows.max() < 1 << _BITS:
        packed = reduce(lambda acc, w: acc << np.int64(_BITS) | w, windows)
        unique, n = np.unique(packed, return_counts=True)
        return np.array([unique >> np.int64(_BITS * k) & np.int64((1 << _BITS) - 1) for k in reversed(range(len(windows)))]), n
    windows = windows[:, np.lexsort(windows[::-1])]
    first = np.flatnonzero(np.concatenate([[True], (windows[:, 1:] != windows[:, :-1]).any(0)]))
    return windows[:, first], np.diff(first, append=windows.shape[1])


def windows(docs: DataFrame, numbers: Numbers, order: int, block: int = BLOCK) -> DataFrame:
    """(w1 .. w<order>, salt, n): counts of longest windows, before they meet."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)
    names = [f"w{k + 1}" for k in range(order)]

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = counted(np.concatenate(held, 1))
        hot, third = shared.value.hot, found[min(2, order - 1)]
        salt = np.where(((found[:2] > 0) & (found[:2] <= hot)).all(0), 1 + third % SALTS, 0) if order > 2 else np.zeros(len(n), np.int64)
        return pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(salt), pa.array(n, pa.int64())], names=[*names, "salt", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            lang, langs = lang_keys(b.column(0))
            ids, new, broken = np.zeros(0, np.int64), np.zeros(0, bool), True   # of words whose windows are still open
            for s, more in blocks(b.column(1), block):
                w = words(s, _EDGES)
                breaks = np.concatenate([[0], np.cumsum(_BREAKS[s.data])])
                fresh = np.zeros(len(w.start), bool)
                fresh[1:] = breaks[w.start[1:]] != breaks[w.start[:-1]]
                fresh[w.row[:-1][w.row[:-1] < len(fresh)]] |= s.rows > 1
                if len(fresh):
                    fresh[0] = broken or breaks[w.start[0]] > 0
                    broken = breaks[-1] > breaks[w.end[-1]]
                else:
                    broken = broken or breaks[-1] > 0
                ids = np.concatenate([ids, shared.value.look_up(word_keys(s, w, lang[s.first + w.owner()], langs))])
                new = np.concatenate([new, fresh])
                found = lead(ids, np.cumsum(new), order)
                done = max(0, len(ids) - order + 1) if more else len(ids)
                found, ids, new = found[:, :done], ids[done:], new[done:]
                broken = broken or not more
                held.append(found[:, found[0] != 0])
                size += held[-1].shape[1]
                if size >= HELD:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)

    return spoken(docs).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "salt", "n"]))


def phrase_counts(counts: DataFrame, order: int, least: int) -> DataFrame:
    """(ids, f) of all phrases of up to ``order`` words found ``least`` times or more, from counts of longest windows."""
    names = [f"w{k + 1}" for k in range(order)]
    deal = names[:2] + ["salt"]
    top = counts.repartition(*deal).groupBy(*deal, *names[2:]).agg(F.sum("n").alias("n"))
    # What a prefix comes to in this task, where all of its windows are; those of a hot pair are in several tasks.
    for k in range(2, order):
        top = top.withColumn(f"n{k}", F.sum("n").over(Window.partitionBy(*deal, *names[2:k])))
    enough = [F.lit(True)] + [(F.col(f"n{k}" if k < order else "n") >= least) | ((F.col("salt") > 0) if k == 2 < order else F.lit(False))
                              for k in range(2, order + 1)]
    kept = top.select(*[F.when(e, F.col(c)).otherwise(0).alias(c) for c, e in zip(names, enough)], "n")
    rolled = kept.rollup(*names).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    ids = F.filter(F.array(*names), lambda x: x.isNotNull())
    return rolled.select(ids.alias("ids"), "f").where((F.size("ids") > 0) & ~F.array_contains("ids", 0))


def slices_of(ids: Column, least: int, most: Column) -> Column:
    """All runs of ``least`` .. ``most`` items of an array."""
    return F.flatten(F.transform(F.sequence(F.lit(least), most), lambda n: F.transform(
        F.sequence(F.lit(1), F.size(ids) - n + 1), lambda i: F.slice(ids, i, n))))


def scored(grams: DataFrame, share: int) -> DataFrame:
    """(ids, a, l, r, score) of candidates at their worst cut, without those that mostly occur in a longer one."""
    several = grams.where(F.size("ids") > 1).withColumnRenamed("f", "a")
    cuts = several.select("ids", "a", F.inline(F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda k: F.struct(
        k.alias("k"), F.slice("ids", F.lit(1), k).alias("first"), F.slice("ids", k + 1, F.size("ids") - k).alias("rest")))))
    parts = cuts.join(grams.toDF("first", "l"), "first").join(grams.toDF("rest", "r"), "rest")

    def exact(c: str) -> Column:
        return F.col(c).cast("decimal(15,0)")

    parts = parts.withColumn("up", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("down", exact("l") * exact("r"))
    worst = parts.groupBy("ids", "a").agg(F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("cut"))
    within = several.where(F.size("ids") > 2).select(F.explode(slices_of(F.col("ids"), 2, F.size("ids") - 1)).alias("ids"), F.col("a").alias("f"))
    most = within.groupBy("ids").agg(F.max("f").alias("longer"))
    left = worst.join(most, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    return left.select("ids", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, order: int = 3, least: int = 10, share: int = 50, top: int = 2_000, listed: int = LISTED,
                 folder: str | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language, of two to ``order`` words.

    A candidate goes if some longer one that holds it has ``share`` per cent of its occurrences. Counts are stored in ``folder``.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "phrases")
    vocab = stored(vocabulary(docs), f"{folder}/vocabulary")
    totals = vocab.groupBy("lang").agg(F.sum("n").alias("n"))
    numbers = Numbers.of(vocab, least, vocab.agg(F.sum("n")).first()[0] or 0, listed)
    grams = stored(phrase_counts(windows(docs, numbers, order), order, least), f"{folder}/phrases")
    shared = spark.sparkContext.broadcast(numbers)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = shared.value.look_up(b.column(2).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(ids), b.column(0), b.column(1)], names=["id", "lang", "word"])

    named = vocab.where(F.col("n") >= least).select("lang", "word", "key").mapInArrow(number, "id long, lang string, word string")
    spoken_in = scored(grams, share).join(named.select(F.col("id").alias("lead"), "lang"), F.col("ids")[0] == F.col("lead")).drop("lead")
    # All that tie with the last one stay until their words are known, so values are ranked here and not phrases.
    value, order_by = ["lang", "score", "a"], [F.desc("score"), F.desc("a")]
    by_value = Window.partitionBy("lang").orderBy(*order_by)
    values = spoken_in.groupBy(*value).agg(F.count("*").alias("phrases"))
    values = values.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    before = F.sum("phrases").over(by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("phrases")
    best = spoken_in.join(values.withColumn("before", before).where(F.col("before") < top).select(*value), value, "left_semi")
    each = best.select("*", F.posexplode("ids").alias("at", "id")).join(named.select("id", "word"), "id")
    spelled = each.groupBy("ids", "lang", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelled"))
    spelled = spelled.withColumn("phrase", F.array_join(F.transform("spelled", lambda x: x["word"]), " "))
    ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order_by, "phrase"))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
