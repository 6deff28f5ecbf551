import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from focuslake.llm import phrases
from focuslake.llm.words import words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, order=3, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, order + 1):
                f.update((lang, tuple(ws[i:i + k])) for i in range(len(ws) - k + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        if any(l2 == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q)))
               for (l2, q), b in found.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    result = []
    for lang in {r[0] for r in out}:
        ranked = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        result += [(lang, i, *r[1:]) for i, r in enumerate(ranked, 1)]
    return sorted(result)


def table(spark, rows):
    full = [(i if i % 3 else None, lang, t) for i, (lang, t) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id long, lang string, text string")
    return df.selectExpr("*", "1 as n", "2 as w1", "'k' as key", "3 as salt", "4 as word", "5 as ids", "6 as a", "7 as rank")


def answer(spark, rows, tmp_path, **options):
    found = phrases.collocations(table(spark, rows).repartition(3), folder=str(tmp_path / "p"), **options)
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect())


@pytest.fixture
def rows():
    """Few words, so that many phrases repeat; a hot pair in a third of all places, odd signs, ties and repeated rows."""
    r = random.Random(4)
    some = ["The", "cat", "sat", "on", "Ünï", "文字", "a'b", "x\x1fy", "\xa0", "dog", "É", "end"]
    out = []
    for i in range(150):
        ws = []
        for _ in range(r.randint(0, 60)):
            ws += r.choice([["of", "the"], ["of", "the", r.choice(some)], [r.choice(some)], [f"rare{r.randint(0, 400)}"]])
            ws.append(r.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]))
        out.append((r.choice(["en", "de", None, "und"]), " ".join(ws)))
    return out + out[:20] + [("en", None), ("fr", ""), ("en", "de " * 30), ("de", "en " * 20), ("fr", " \t.,;\n"), ("xx", "one"), (None, None)]


def test_equals_brute_force(spark, rows, tmp_path):
    want = brute(rows)
    assert len(want) > 50
    assert answer(spark, rows, tmp_path) == want


@pytest.mark.parametrize("options", [{"listed": 5}, {"listed": 0}, {"order": 2}, {"order": 4, "least": 5}, {"top": 7}, {"share": 101}])
def test_options(spark, rows, tmp_path, options):
    want = {k: v for k, v in options.items() if k != "listed"}
    assert answer(spark, rows, tmp_path, **options) == brute(rows, **want)


def test_long_texts_are_read_in_blocks(rows, monkeypatch):
    text = " ".join(t for _, t in rows if t)
    for limit in (1, 7, 300):
        found = [(bytes(s.data), more) for s, more in phrases.blocks(pa.array([text, "", "a b", text]), limit)]
        assert b"".join(x for x, _ in found).decode() == text + "a b" + text
        for (x, more), (y, _) in zip(found, found[1:]):
            assert not more or phrases._EDGES[x[-1]]
    numbers = phrases.Numbers(np.zeros(0, np.int64), np.zeros(0, np.int64), False, 1)
    rows = pa.record_batch([pa.array(["en"] * 4), pa.array([text, text + ".", None, "x"])], names=["lang", "text"])
    monkeypatch.setattr(phrases, "spoken", lambda docs: docs)

    def windows_of(limit):
        out = Counter()
        for b in phrases.windows(FakeFrame(rows), numbers, 3, limit):
            for *w, _, n in zip(*(c.to_pylist() for c in b.columns)):
                out[tuple(w)] += n
        return out

    assert windows_of(1 << 20) == windows_of(40) == windows_of(3)


class FakeFrame:
    """Just enough of a DataFrame to run the function of a task here."""

    def __init__(self, rows):
        self.rows, self.sparkSession, self.sparkContext = rows, self, self

    def broadcast(self, value):
        self.value = value
        return self

    def mapInArrow(self, run, schema):
        return list(run(iter([self.rows])))


def test_empty_table(spark, tmp_path):
    assert answer(spark, [], tmp_path) == []
    assert answer(spark, [("en", "too few words")], tmp_path / "b") == []


def test_one_exchange_of_windows(spark, rows):
    """Windows are dealt out once; what follows up to the ROLLUP stays in place."""
    counts = spark.createDataFrame([(1, 2, 3, 0, 5)], "w1 long, w2 long, w3 long, salt long, n long")
    plan = phrases.phrase_counts(counts, 3, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("Expand") == 1


def test_counts_beyond_64_bits(spark):
    big = 4 * 10 ** 14
    grams = spark.createDataFrame([([1, 2], big), ([1], big + 7), ([2], 2 * big)], "ids array<long>, f long")
    assert phrases.scored(grams, 50).first().score == 10 ** 6 * big * big // ((big + 7) * 2 * big)


def test_a_slice_without_words():
    s, _ = next(iter(phrases.blocks(pa.array([" .", None]))))
    assert not len(words(s, phrases._EDGES).start)
