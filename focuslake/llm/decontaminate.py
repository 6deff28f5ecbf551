"""Benchmark passages in documents: random-walk embedding of windows, bit sampling, exact edit distance.

Texts are sequences of words (A-Z lower-cased). The embedding walks along a sequence with one random bit
per step and word: at step t it writes the word under the pointer and moves on if the bit is 1. Two
sequences at a small edit distance fall into step again after each edit, so their embeddings differ in
few places: edit distance becomes Hamming distance. A sample is the words that the embedding wrote at a
few steps from a drawn step on; items and windows that agree in a sample are candidates. An item is walked
to its end, about twice its words, and so is a window at every word of a document. Windows that have met
at a step write the same from there on, and are carried as one: t steps leave about one window in the root
of t, so a walk costs about 2 sqrt(t) steps a word and not t.

Walks are repeated with new bits until the wanted recall. How many an item takes is worked out from the rate at
which a walk misses, measured on drawn items of its size with all allowed edits at the front, in the
middle, at the end or spread (``walks``). A second source of candidates makes the worst places sure: an
item that takes at most e edits keeps one of its e + 1 parts as it was, so it also has a sample from each
part (``by_parts``).

Candidates are verified by the edit distance in words between the item and the best part of the
document's text around the window: a document holds an item if it takes at most ``share`` of the item's
words as edits. Before that, a candidate must hold one of the item's e + 1 words that are rarest in the
slice, which e edits cannot all remove: a preamble shared by many items costs no distances. Candidates are
taken in pieces of about PIECE, whatever a passage repeats.

Nulls are empty texts: as documents they hold nothing, as items they are passed over, and so are null item
ids. Repeated documents are judged alike, repeated items are reported by each id once, with the fewest
edits; of places with equally few the first is named. Empty tables give empty results. A long text is worked
on whole, with about 100 bytes of memory for each of its words. Columns besides doc_id and text are not read;
``mark_leaks`` keeps them and replaces a column of the name it writes. Items are sent to the tasks in blocks
of about BLOCK items, one pass over the documents for each, so what a task holds is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .words import bound_batches, mix, repeat_ranges, slices, span_hashes, texts, words

SHARE = 0.15   # edits allowed, as a share of the item's words
RECALL = 0.999  # of items with the most edits that are allowed, in the worst places
LAST = 16      # steps at most that a walk takes within a part: more add nothing, keys may be shorter than parts
GAP = 2        # steps between the words of a sample
DRAWN = 300    # drawn items for each place of the edits that the rate of misses is measured on
BLOCK = 5_000
PIECE = 1_000_000
_NONE = np.iinfo(np.int64).max


def word_codes(s) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows on end with a 0 behind each row, and where each row begins."""
    w = words(s)
    codes = span_hashes(s, w.start, w.end, fold=True) | np.uint64(1)
    begin = w.row + np.arange(len(w.row))
    out = np.zeros(len(codes) + s.rows, np.uint64)
    out[np.arange(len(codes)) + w.owner()] = codes
    return out, begin


def bits(codes: np.ndarray, walk: int, step: int) -> np.ndarray:
    """0 or 1 for each word at a step; 0 at the end of a text, where a walk stays."""
    odd = int(mix(np.array([walk * 4096 + step + 1], np.uint64))[0]) | 1
    return ((codes * np.uint64(odd)) >> np.uint64(63)).astype(np.int32)


def parts(n: int, edits: int, recall: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of an item's parts, one more than its edits, and which of them are taken for the recall."""
    count = min(edits + 1, n)
    taken = min(count, max(1, int(np.ceil(recall * count - 1e-9))))
    chosen = np.arange(count) if taken == count else np.sort(np.random.default_rng(seed).choice(count, taken, replace=False))
    return n * np.arange(count + 1) // count, chosen


def depth(n):
    """Words of a sample, by the size of the item."""
    return np.where(np.asarray(n) < 14, 3, 4)


def sample_steps(walk: int, last: int) -> list[int]:
    """Steps at which a walk's samples begin: 0, then drawn about a quarter of the way apart, four at least."""
    draw, t, out = np.random.default_rng(walk), 0, []
    while t <= last:
        out.append(t)
        t += int(draw.integers(1, 2 * max(4, t // 4)))
    return out


def walkers(codes: np.ndarray, place: np.ndarray, walk: int, steps: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(step, places): where the walkers that set out from ``place`` are, those that met as one, without those at an end."""
    at = 0
    for t in steps:
        for u in range(at, t):
            place = place + bits(codes[place], walk, u)
        at, alive = t, codes[place] != 0
        alive[1:] &= place[1:] != place[:-1]
        place = place[alive]
        yield t, place


class Samples:
    """What the embeddings of items wrote at the sampled steps of one walk."""

    def __init__(self, line: np.ndarray, begin: np.ndarray, size: np.ndarray, member: np.ndarray, walk: int):
        self.walk, self.tables, words_of = walk, {}, depth(size)
        steps = sample_steps(walk, 3 * int(size.max()))
        for t, place in walkers(line, begin, walk, steps):
            if not len(place):
                break
            owner = np.searchsorted(begin, place, "right") - 1
            p, key, levels = place, np.zeros(len(place), np.uint64), {}
            open_ = np.ones(len(place), bool)
            for k in range(4):
                word = line[p]
                key, before = _key([word], key), key
                last = word == 0      # the item ends: its first sample is as long as it may be, others are left out
                for done, keys, d in ((open_ & last & (t == 0), before, k - 1), (open_ & ~last & (words_of[owner] == k + 1), key, k)):
                    if done.any():
                        levels.setdefault(d, []).append((keys[done], owner[done], (place - begin[owner])[done]))
                    open_ &= ~done
                open_ &= ~last
                seen = np.zeros(1 << 16, bool)
                seen[_short(word if k == 0 else key)] = True
                self.tables.setdefault(t, []).append([seen, None])
                for u in range(t + k * GAP, t + (k + 1) * GAP):
                    p = p + bits(line[p], walk, u)
            for d, found in levels.items():
                keys, owner_, offset = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(keys, kind="stable")
                self.tables[t][d][1] = keys[order], member[owner_[order]], offset[order]

    def hits(self, codes: np.ndarray) -> Iterator[tuple]:
        """(places, members, offsets, first, count): samples that windows share with items."""
        short = _short(codes)
        for t, place in walkers(codes, np.flatnonzero(codes).astype(np.int32), self.walk, list(self.tables)):
            some = self.tables[t][0][0][short[place]]
            p = place = place[some]
            key = np.zeros(len(place), np.uint64)
            for k, (seen, table) in enumerate(self.tables[t]):
                key = _key([codes[p]], key)
                if k:
                    some = seen[_short(key)]
                    place, p, key = place[some], p[some], key[some]
                if table is not None:
                    keys, members, offsets = table
                    lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                    hit = np.flatnonzero(hi > lo)
                    yield place[hit], members, offsets, lo[hit], (hi - lo)[hit]
                for u in range(t + k * GAP, t + (k + 1) * GAP):
                    p = p + bits(codes[p], self.walk, u)


def _line(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences on end with a 0 behind each, and where each begins."""
    sizes = np.array([len(c) for c in codes], np.int64)
    line = np.concatenate([x for c in codes for x in (c, np.zeros(1, np.uint64))])
    return line, np.cumsum(sizes + 1) - sizes - 1


@lru_cache(maxsize=None)
def misses(n: int, edits: int) -> float:
    """Share of items of n words that one walk misses, all their edits in the worst of four places."""
    draw, worst = np.random.default_rng(n), 0
    new = lambda k: draw.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)
    for begin in (0, (n - edits) // 2, n - edits, None):
        items, texts_ = [new(n) for _ in range(DRAWN)], []
        for item in items:
            text = item.copy()
            if begin is None:
                for _ in range(edits):
                    kind, at = draw.integers(3), draw.integers(len(text))
                    text = (np.delete(text, at) if kind == 0 else np.insert(text, at, new(1)) if kind == 1
                            else np.concatenate([text[:at], new(1), text[at + 1:]]))
            else:
                text[begin:begin + edits] = new(edits)
            texts_.append(np.concatenate([new(n), text, new(n)]))
        line, at = _line(items)
        samples = Samples(line, at, np.full(DRAWN, n), np.arange(DRAWN), 0)
        codes, first = _line(texts_)
        found = np.zeros(DRAWN, bool)
        for place, members, _, lo, count in samples.hits(codes):
            row = np.repeat(np.searchsorted(first, place, "right") - 1, count)
            held = members[repeat_ranges(lo, count)]
            found[held[held == row]] = True
        worst = max(worst, int((~found).sum()))
    return (worst + 1) / (DRAWN + 1)


def walks(edits: int, share: float, recall: float = RECALL) -> int:
    """Walks that an item with so many edits takes for the recall, by the rate of the shortest such item.

    Allowances go together by their first three bits, and those beyond 32 by the rate at 32: longer items are missed less.
    """
    if not edits:
        return 1    # verbatim, its window walks as it does
    shift = max(0, min(edits, 32).bit_length() - 3)
    measured = min(edits, 32) >> shift << shift
    rate = min(misses(max(measured + 1, int(np.ceil(measured / share - 1e-9))), measured), 0.99)
    return max(1, int(np.ceil(np.log(max(1 - recall, 1e-12)) / np.log(rate))))


class Items:
    """Items of one block: their words, the samples of their embeddings and of their parts."""

    def __init__(self, ids: list[int], codes: list[np.ndarray], share: float, recall: float = RECALL, repeats: list[int] | None = None,
                 by_parts: bool = True):
        self.ids, self.codes = np.array(ids, np.int64), codes
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.distinct = [np.unique(c) for c in codes]
        self.edits = np.floor(self.sizes * share + 1e-9).astype(np.int64)
        marks = [mix(c ^ mix(np.array([i + 1], np.uint64))) for i, c in enumerate(codes)]
        self.vocabulary = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
        self.embedded: list[Samples] = []
        self.samples: list[tuple] = []
        if not len(codes):
            return
        repeats = np.array(repeats if repeats is not None else repeats_of(codes, share, recall))
        for walk in range(int(repeats.max())):
            mine = np.flatnonzero(repeats > walk)
            line, begin = _line([codes[i] for i in mine])
            self.embedded.append(Samples(line, begin, self.sizes[mine], mine, walk))
        if by_parts:
            self._parts(recall)

    def _parts(self, recall: float) -> None:
        codes = self.codes
        member, begin, end, offset, at = [], [], [], [], 0
        for i, n in enumerate(self.sizes.tolist()):
            bounds, taken = parts(n, int(self.edits[i]), recall, i)
            member.append(np.full(len(taken), i))
            begin.append(at + bounds[taken])
            end.append(at + bounds[taken + 1])
            offset.append(bounds[taken])
            at += n
        member, place, end, offset = (np.concatenate(x) for x in (member, begin, end, offset))
        line, written = np.append(np.concatenate(codes), np.uint64(0)), []
        for t in range(LAST + 1):
            written.append(np.where(place < end, line[place], np.uint64(0)))
            place = place + bits(written[-1], 0, t)
        written = np.stack(written, 1)
        last = (written != 0).sum(1) - 1
        for t in np.unique(last):
            mine = np.flatnonzero(last == t)
            at = np.unique([0, (int(t) + 1) // 2, int(t)])
            keys = _key(written[mine][:, at].T)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros((len(at), 1 << 16), bool)
            for k, u in enumerate(at):
                seen[k, _short(written[mine, u])] = True
            self.samples.append((at, seen, keys[order], member[mine][order], offset[mine][order]))

    def candidates(self, codes: np.ndarray, ranked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, item, offset) in pieces: at that place is what the item's embedding or part has at that offset."""
        possible, found, size = None, [], 0
        for place, members, offsets, lo, count in self._hits(codes):
            if count.sum() > len(members):    # a passage of many items: those whose other words are not in the slice go first
                possible = self._possible(ranked) if possible is None else possible
                ok = possible[members]
                before = np.append(0, np.cumsum(ok))
                lo, count, members, offsets = before[lo], before[lo + count] - before[lo], members[ok], offsets[ok]
            total = np.cumsum(count)
            for a, z in _pieces(total):
                mine = repeat_ranges(lo[a:z], count[a:z])
                found.append((np.repeat(place[a:z], count[a:z]).astype(np.int64), members[mine], offsets[mine]))
                size += len(mine)
                if size >= PIECE:
                    yield tuple(np.concatenate(x) for x in zip(*found))
                    found, size = [], 0
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found))

    def _hits(self, codes: np.ndarray) -> Iterator[tuple]:
        for samples in self.embedded:
            yield from samples.hits(codes)
        place, levels, short = np.arange(len(codes), dtype=np.int32), [], []
        for t in range(max((int(at[-1]) for at, *_ in self.samples), default=-1) + 1):
            levels.append(codes[place])
            short.append(_short(levels[-1]))
            place = place + bits(levels[-1], 0, t)
        for at, seen, keys, members, offsets in self.samples:
            some = np.flatnonzero(seen[-1][short[at[-1]]])
            for k, t in enumerate(at[:-1]):    # windows go on while their words are words of some part there
                some = some[seen[k][short[t][some]]]
            found = _key([levels[t][some] for t in at])
            lo, hi = np.searchsorted(keys, found), np.searchsorted(keys, found, "right")
            hit = np.flatnonzero(hi > lo)
            yield some[hit], members, offsets, lo[hit], (hi - lo)[hit]

    def find(self, s) -> tuple[np.ndarray, ...]:
        """row, item, edits, first word of the items that the rows of a slice hold."""
        codes, begin = word_codes(s)
        none = np.zeros(0, np.int64)
        if not len(self.ids) or not len(codes):
            return none, none, none, none
        order = np.argsort(codes, kind="stable")
        ranked = codes[order]
        spans = []
        for start, item, offset in self.candidates(codes, ranked):
            row = np.searchsorted(begin, start, "right") - 1
            # What was found may stand some edits before or behind its place in the item.
            low = np.maximum(start - offset - self.edits[item], begin[row])
            high = np.minimum(start - offset + self.sizes[item] + self.edits[item], begin[row + 1] - 1)
            ok = high - low >= self.sizes[item] - self.edits[item]
            ok[ok] = self._rare(order, ranked, item[ok], low[ok], high[ok])
            spans.append(_distinct(row[ok], item[ok], low[ok], high[ok]))
        if not spans:
            return none, none, none, none
        row, item, low, high = _distinct(*np.concatenate(spans, 1))
        ok = self._enough(codes, item, low, high)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for r, i, a, z in zip(row[ok].tolist(), item[ok].tolist(), low[ok].tolist(), high[ok].tolist()):
            edits, first = self._distance(codes[a:z], i, best.get((r, i), (_NONE, 0))[0])
            if edits <= self.edits[i] and (edits, a + first - int(begin[r])) < best.get((r, i), (_NONE, 0)):
                best[r, i] = edits, a + first - int(begin[r])
        keys = sorted(best)
        return (np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64),
                np.array([best[k][0] for k in keys], np.int64), np.array([best[k][1] for k in keys], np.int64))

    def _possible(self, ranked: np.ndarray) -> np.ndarray:
        """Items whose distinct words, but for their edits, are in the slice."""
        line, sizes = np.concatenate(self.distinct), np.array([len(d) for d in self.distinct])
        there = ranked[np.minimum(np.searchsorted(ranked, line), len(ranked) - 1)] == line
        return np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=there, minlength=len(sizes)) >= sizes - self.edits

    def _rare(self, order, ranked, item, low, high) -> np.ndarray:
        """Candidates that hold one of the e + 1 words of the item that are rarest in the slice."""
        out, by_item = np.zeros(len(item), bool), np.argsort(item, kind="stable")
        bounds = np.flatnonzero(np.diff(item[by_item], prepend=-1, append=-1))
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            mine = by_item[a:z]
            i = int(item[mine[0]])
            lo, hi = np.searchsorted(ranked, self.distinct[i]), np.searchsorted(ranked, self.distinct[i], "right")
            rarest = np.argsort(hi - lo, kind="stable")[:int(self.edits[i]) + 1]
            places = np.sort(order[repeat_ranges(lo[rarest], (hi - lo)[rarest])])
            out[mine] = np.searchsorted(places, low[mine]) < np.searchsorted(places, high[mine])
        return out

    def _enough(self, codes, item, low, high, piece: int = 20_000) -> np.ndarray:
        """Candidates with enough of the item's words: each word that is missing costs an edit."""
        out = np.zeros(len(item), bool)
        for at in range(0, len(item), piece):
            i, a, n = item[at:at + piece], low[at:at + piece], (high - low)[at:at + piece]
            owner = np.repeat(np.arange(len(i)), n)
            salts = mix((i + 1).astype(np.uint64))
            marks = mix(codes[repeat_ranges(a, n)] ^ salts[owner])
            pos = np.minimum(np.searchsorted(self.vocabulary, marks), len(self.vocabulary) - 1)
            held = np.bincount(owner, weights=self.vocabulary[pos] == marks, minlength=len(i))
            out[at:at + piece] = held >= self.sizes[i] - self.edits[i]
        return out

    def _distance(self, text: np.ndarray, i: int, known: int) -> tuple[int, int]:
        """Least edits between the item and a part of ``text``, and the first word of that part."""
        item = self.codes[i]
        n = len(item)
        if known == 0:
            return _NONE, 0
        if len(text) >= n:
            views = np.lib.stride_tricks.sliding_window_view(text, n)
            same = np.flatnonzero((views == item).all(1))
            if len(same):
                return 0, int(same[0])
        if np.isin(self.distinct[i], text).sum() < len(self.distinct[i]) - self.edits[i]:
            return _NONE, 0
        # Cost and beginning travel together: cost in the high part of one number.
        width, scale = len(text) + 1, np.int64(1 << 20)
        at = np.arange(width)
        row = at.astype(np.int64)  # no word of the item read yet: cost 0, begins here
        for w in item:
            step = row + scale
            step[1:] = np.minimum(step[1:], row[:-1] + scale * (text != w))
            row = np.minimum.accumulate(step - at * scale) + at * scale
        best = int(row.min())
        return best // int(scale), best % int(scale)


def _short(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(48)).astype(np.int32)


def _distinct(row, item, low, high) -> np.ndarray:
    return np.unique(np.stack([row, item, low, high], 1), axis=0).T if len(row) else np.zeros((4, 0), np.int64)


def _pieces(total: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of hits that stand for about PIECE candidates; ``total`` is their running sum."""
    a = 0
    while a < len(total):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PIECE, "right")))
        yield a, z
        a = z


def _key(parts, start: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64) if start is None else start
    for p in parts:
        out = mix(out * np.uint64(3) + p)
    return out


def item_blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[list]:
    """(item_id, text) rows in blocks of about ``block`` items."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null").distinct()
    n = max(1, -(-rows.count() // block))
    for k in range(n):
        yield rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()


def _items(rows: list, share: float) -> tuple[list, list]:
    ids, codes = [], []
    for s in slices(pa.array([r["text"] for r in rows], pa.string())):
        flat, begin = word_codes(s)
        for i in range(s.rows):
            line = flat[begin[i]:begin[i + 1] - 1]
            if len(line):
                ids.append(rows[s.first + i]["item_id"])
                codes.append(line.copy())
    return ids, codes


def _prepared(rows: list, share: float, recall: float) -> tuple:
    """Arguments of Items; how often walks miss is measured once, here."""
    ids, codes = _items(rows, share)
    return ids, codes, share, recall, repeats_of(codes, share, recall)


def repeats_of(codes: list[np.ndarray], share: float, recall: float) -> list[int]:
    """Walks of each item."""
    return [walks(int(len(c) * share + 1e-9), share, recall) for c in codes]


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block: int = BLOCK,
               recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, edits, first_word, item_words): a row for each item that a document holds."""
    def per_block(rows: list) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(_prepared(rows, share, recall))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for b in batches:
                for s in slices(b.column(1)):
                    row, item, edits, first = items.find(s)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([
                            b.column(0).slice(s.first, s.rows).take(pa.array(row)), pa.array(items.ids[item]), pa.array(edits),
                            pa.array(first), pa.array(items.sizes[item])], names=["doc_id", "item_id", "edits", "first_word", "item_words"])

        return texts(docs).mapInArrow(run, "doc_id long, item_id long, edits long, first_word long, item_words long")

    found = reduce(DataFrame.union, [per_block(rows) for rows in item_blocks(benchmark, block)])
    best = F.min(F.struct("edits", "first_word", "item_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def mark_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "leaks", share: float = SHARE, block: int = BLOCK,
               recall: float = RECALL) -> DataFrame:
    """``docs`` with an array of the ids of the items that each row's text holds; no shuffle."""
    schema = StructType([f for f in docs.schema.fields if f.name != column]).add(column, ArrayType(LongType()))
    docs = docs.drop(column).withColumn(column, F.array().cast("array<long>"))
    at = docs.columns.index("text")
    for rows in item_blocks(benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast(_prepared(rows, share, recall))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for b in batches:
                held = b.column(b.num_columns - 1).to_pylist()
                for s in slices(b.column(at).cast(pa.string())):
                    row, item, *_ = items.find(s)
                    for r, i in zip(row.tolist(), items.ids[item].tolist()):
                        held[s.first + r].append(i)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.array([sorted(set(x)) for x in held], pa.list_(pa.int64()))], names=b.schema.names)

        docs = bound_batches(docs).mapInArrow(run, schema)
    return docs
