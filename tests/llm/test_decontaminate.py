import random

import numpy as np
import pyarrow as pa
import pytest

from focuslake.llm import decontaminate
from focuslake.llm.decontaminate import Items, _items, bits, find_leaks, mark_leaks, misses, parts, walkers, walks
from focuslake.llm.words import slices


def edits_in(text, item):
    """Least edits between the item and any part of the text, word by word."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            new[j] = min(row[j - 1] + (t != w), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def edited(words, n, r):
    words = list(words)
    for _ in range(n):
        kind, at = r.randrange(3), r.randrange(len(words))
        if kind == 0:
            words[at] = f"zz{r.randrange(10 ** 6)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"zz{r.randrange(10 ** 6)}")
    return words


@pytest.fixture
def bench(spark, prose):
    rows = [(k, prose(n, 900 + k)) for k, n in enumerate((6, 9, 14, 20, 31, 40, 59, 90))]
    return rows, spark.createDataFrame([*rows, (50, None), (51, ""), (None, "some words"), (52, rows[2][1])], "item_id long, text string")


def test_found_leaks_are_exact_and_nearly_complete(spark, documents, prose, bench):
    r, rows = random.Random(1), []
    for k in range(160):
        item = bench[0][k % 8][1].split()
        words = edited(item, r.randrange(0, int(len(item) * 0.25) + 1), r)
        rows.append((k, f"{prose(r.randrange(90), k)} {' '.join(words)} {prose(r.randrange(90), 7 * k)}".upper()))
    got = {(x.doc_id, x.item_id): x.edits for x in find_leaks(documents(rows), bench[1]).collect()}
    want = {}
    for i, t in rows:
        for j, item in bench[0]:
            e = edits_in(t.lower().split(), item.split())
            if e <= int(len(item.split()) * decontaminate.SHARE + 1e-9):
                want[i, j] = e
                if j == 2:
                    want[i, 52] = e
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) / len(want) > 0.95 and all(k in got for k, e in want.items() if e == 0)


def test_odd_rows_and_marks(spark, documents, odd, bench):
    rows = odd + [(70, bench[0][3][1]), (70, bench[0][3][1])]
    assert [(x.doc_id, x.item_id, x.edits, x.first_word) for x in find_leaks(documents(rows), bench[1]).collect()] == [(70, 3, 0, 0)]
    marked = mark_leaks(documents(rows, extra=True), bench[1])
    assert marked.columns.count("leaks") == 1 and "odd name" in marked.columns
    got = marked.collect()
    assert len(got) == len(rows) and [x.leaks for x in got if x.doc_id == 70] == [[3], [3]] and sum(len(x.leaks) for x in got) == 2


def test_blocks_of_items(spark, documents, bench):
    rows = [(k, t) for k, t in bench[0]]
    found = {(x.doc_id, x.item_id) for x in find_leaks(documents(rows), bench[1], block=2).collect()}
    assert {(k, k) for k, _ in rows} <= found
    got = {x.doc_id: set(x.leaks) for x in mark_leaks(documents(rows), bench[1], block=2).collect()}
    assert {(d, i) for d, s in got.items() for i in s} == found


def test_empty_tables(spark, documents, bench):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(documents([]), bench[1]).collect() == []
    assert find_leaks(documents([(1, "a b c")]), none).collect() == []
    assert [x.leaks for x in mark_leaks(documents([(1, "a b c")]), none).collect()] == [[]]


def test_bits_are_fair_and_stay_at_the_end():
    codes = np.random.default_rng(1).integers(1, 1 << 63, 4000, dtype=np.uint64) | np.uint64(1)
    assert all(0.45 < bits(codes, 1, t).mean() < 0.55 for t in range(20)) and bits(np.zeros(3, np.uint64), 0, 0).sum() == 0


def index_of(items, **options):
    rows = [{"item_id": i, "text": t if isinstance(t, str) else " ".join(t)} for i, t in enumerate(items)]
    return Items(*_items(rows, decontaminate.SHARE), decontaminate.SHARE, **options)


def held_by(index, rows):
    held = set()
    for s in slices(pa.array(rows)):
        row, item, edits, _ = index.find(s)
        assert (edits <= index.edits[item]).all()
        held |= set(zip((row + s.first).tolist(), item.tolist()))
    return held


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 13, 14, 20, 27, 40, 48, 59, 63, 127, 300])
@pytest.mark.parametrize("by_parts", [True, False])
def test_edits_in_one_part_lose_no_item(n, by_parts):
    """Edits at the front, in the middle, at the end or anywhere; very short items verbatim; walks alone find all but a few."""
    r, size = random.Random(n), 60
    new = lambda: f"w{r.randrange(5000)}"
    items = [[new() for _ in range(n)] for _ in range(size)]
    e = int(n * decontaminate.SHARE + 1e-9)
    index = index_of(items, by_parts=by_parts)
    for begin in (0, (n - e) // 2, n - e, None):
        rows = []
        for t in items:
            t = edited(t, e, r) if begin is None else [*t[:begin], *(f"zz{r.randrange(10 ** 6)}" for _ in range(e)), *t[begin + e:]]
            rows.append(" ".join([new() for _ in range(r.randrange(90))] + t + [new() for _ in range(r.randrange(90))]))
        held = held_by(index, rows)
        found = sum((i, i) in held for i in range(size))
        assert found == size if by_parts or not e else found >= 0.95 * size


def test_walks_follow_the_recall():
    assert misses(40, 6) < 0.1 and walks(0, 0.15) == 1
    assert walks(6, 0.15, 0.5) <= walks(6, 0.15, 0.99) <= walks(6, 0.15, 0.999999)
    assert walks(6, 0.15, 0.999999) >= 2 and walks(10 ** 6, 0.15) == walks(32, 0.15)


def test_windows_that_met_go_on_as_one():
    codes = np.random.default_rng(1).integers(1, 1 << 63, 20_000, dtype=np.uint64) | np.uint64(1)
    codes[[9_999, 19_999]] = 0
    alone = np.flatnonzero(codes)
    for t in range(40):
        alone = alone + bits(codes[alone], 3, t)
    together = dict(walkers(codes, np.flatnonzero(codes), 3, [0, 1, 7, 20, 40]))
    assert together[40].tolist() == [p for p in np.unique(alone).tolist() if codes[p]]
    assert len(together[0]) == 19_998 and len(together[40]) < 0.3 * len(codes)


def test_a_preamble_shared_by_many_items():
    """Items with one preamble on a page of 1 MB of it: only items whose own words are there are held."""
    r = random.Random(5)
    preamble = " ".join(f"p{k}" for k in range(13))
    items = [f"{preamble} " + " ".join(f"w{r.randrange(20_000)}" for _ in range(27)) for _ in range(1_000)]
    page = " ".join(f"{preamble} " + " ".join(f"v{r.randrange(20_000)}" for _ in range(20)) for _ in range(6_000))
    assert held_by(index_of(items), [page, f"{page} {items[7]}"]) == {(1, 7)}


def test_parts_follow_the_recall():
    assert [len(parts(59, 8, r, 1)[1]) for r in (0.5, 0.9, 0.999, 1)] == [5, 9, 9, 9] and len(parts(2, 0, 0.5, 1)[1]) == 1
