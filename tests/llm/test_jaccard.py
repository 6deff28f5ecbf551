import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from focuslake.llm import jaccard
from focuslake.llm.components import components, roots
from focuslake.llm.jaccard import keep_first, overlaps, repeats, similar


def shingles(text):
    w = [x for x in (text or "").lower().split() if x]
    return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())


def brute(rows, limit=0.8):
    """doc_id -> (class, group, links), by comparing all texts."""
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(shingles(t)), []).append(i)
    keys = list(sets)
    least = [min((i for i in sets[k] if i is not None), default=None) for k in keys]
    near = [[j for j in range(len(keys)) if j != i and keys[i] and len(keys[i] & keys[j]) / len(keys[i] | keys[j]) >= limit] for i in range(len(keys))]
    out = []
    for i, k in enumerate(keys):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        group = min((least[j] for j in seen if least[j] is not None), default=None)
        out += [(d, least[i], group, len(near[i])) for d in sets[k]]
    return sorted(out, key=repr)


def ask(df, tmp_path):
    return sorted(((r.doc_id, r.class_id, r.group_id, r.n_links) for r in similar(df, folder=str(tmp_path / "j")).collect()), key=repr)


@pytest.fixture
def family(prose):
    """Near copies of a few texts, at many similarities."""
    r, rows = random.Random(4), []
    for k in range(12):
        base = prose(r.choice([6, 40, 120, 400]), 50 + k).split()
        for c in range(14):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                text[r.randrange(len(text))] = f"new{r.randrange(10 ** 6)}"
            rows.append((k * 100 + c, " ".join(text)))
    return rows


def test_equals_brute_force(spark, documents, family, odd, tmp_path):
    rows = family + [(5000 + (i or 0) if i is not None else None, t) for i, t in odd]
    assert ask(documents(rows, extra=True), tmp_path) == brute(rows)


def test_blocks_and_deep_buckets(spark, documents, family, tmp_path, monkeypatch):
    """One group that no split parts, compared block against block."""
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    base = [f"w{i}" for i in range(300)]
    rows = family + [(9000 + i, " ".join(base[:i] + [f"x{i}"] + base[i + 1:])) for i in range(60)]
    assert ask(documents(rows), tmp_path) == brute(rows)


def test_one_of_each_group_stays(spark, documents, tmp_path):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (7, "other words stand in here"), (None, None), (8, "")]
    kept = keep_first(documents(rows, extra=True), folder=str(tmp_path / "k"))
    assert "odd name" in kept.columns and sorted(r.doc_id for r in kept.collect()) == [1, 7, 8]


def test_empty_table(spark, documents, tmp_path):
    assert ask(documents([]), tmp_path) == []


def test_overlaps_and_runs():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, n)).astype(np.uint64) for n in (0, 1, 50, 200, 200)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    others = ~np.eye(len(sets), dtype=bool)
    assert (overlaps(sets, width=7) == want)[others].all()
    assert repeats(0.999) > repeats(0.9) > 1
    assert roots(5, np.array([3, 1]), np.array([4, 3])).tolist() == [0, 1, 2, 1, 1]


def test_components_of_a_long_chain(spark, tmp_path):
    ids = spark.range(200).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"), "id")
    edges = ids.where("id <> 99").select("a", "b").union(spark.createDataFrame([(None, 5), (7, 7)], "a long, b long"))
    found = components(edges, str(tmp_path / "c")).collect()
    sizes = {}
    for x in found:
        sizes[x.root] = sizes.get(x.root, 0) + 1
    assert sorted(sizes.values()) == [1, 100, 101] and len({x.node for x in found}) == len(found)


def test_only_rows_of_one_group_remove_each_other(spark, documents, prose, tmp_path):
    """Different texts without an id, or with the same id, all stay; copies and near copies of them go."""
    a, b, c, d = (prose(60, 800 + k) for k in range(4))
    near = lambda text: text + " tail"
    rows = [(None, a), (None, near(a)), (None, b), (None, b), (5, c), (5, d), (6, near(c)), (7, near(d)), (None, near(d)), (9, near(b))]
    kept = keep_first(documents(rows, extra=True), folder=str(tmp_path / "k")).collect()
    got = [(r.doc_id, r.text) for r in kept]
    assert sorted(x for x in got if x[0] is not None) == sorted([(5, c), (5, d), (9, near(b))])
    assert len(got) == 4 and [t for i, t in got if i is None][0] in (a, near(a))


def test_runs_reach_the_recall_through_all_splits():
    """Pairs at the limit with the spread of real signatures, in buckets that split until DEPTH; 15 runs lose too many."""
    r = np.random.default_rng(4)
    agree, runs_ = r.binomial(jaccard.COORDINATES, 0.8, 200_000), repeats()

    def lost(n):
        some = np.repeat(agree, n)
        paths = np.ones(len(some), np.int64)
        for _ in range(jaccard.DEPTH):
            paths = r.binomial(paths * some, 1 / (0.8 * jaccard.COORDINATES))
        return 1 - paths.reshape(-1, n).any(1).mean()

    assert lost(15) > 0.003 and lost(runs_) < 0.0013


def test_null_and_repeated_ids_stay_linear(spark, documents, prose, tmp_path, monkeypatch):
    """Rows without an id, and different texts under one id: every set is read once, however many there are."""
    seen = {}
    sets_of = jaccard._sets_of

    def counting(rows):
        stored_rows = rows.cache()
        seen["n"] = stored_rows.count()
        return sets_of(stored_rows)

    monkeypatch.setattr(jaccard, "_sets_of", counting)
    for n in (60, 120):
        rows = []
        for i in range(n):
            text = prose(80, 1000 + i)
            rows += [(None, text), (None, text + " one more"), (7, "x " + text)]
        found = jaccard.similar(documents(rows), folder=str(tmp_path / str(n))).collect()
        assert len(found) == 3 * n and {r.n_links for r in found} == {2}
        assert seen["n"] == 3 * n
