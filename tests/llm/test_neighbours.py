import numpy as np
import pytest
from pyspark.sql import functions as F

from focuslake.llm import neighbours
from focuslake.llm.neighbours import Codes, hamming, nearest, radii


def brute(rows, queries, k=10):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v
            and np.isfinite(np.array(v, float)).all() and any(v)}
    ids = sorted(good)
    m, out = np.array([good[i] for i in ids]), {}
    for q in queries:
        if q in good:
            d = np.sqrt(((m - good[q]) ** 2).sum(1))
            out[q] = [(ids[j], d[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").withColumn("entry", F.lit(9))


@pytest.fixture
def rows():
    r = np.random.default_rng(3)
    v = r.normal(size=(700, 16)).astype(np.float32)
    out = [(i, v[i].tolist()) for i in range(700)]
    out += [(1000 + i, v[5].tolist()) for i in range(60)] + [(3, v[3].tolist())]
    return out + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0]), (None, v[1].tolist()),
                  (2005, [float("inf")] + [1.0] * 15)]


def compare(spark, rows, tmp_path):
    got = {}
    for r in nearest(table(spark, rows), F.col("vec_id") % 5 == 0, folder=str(tmp_path / "n")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute(rows, range(0, 3000, 5))
    assert set(got) == {q for q, w in want.items() if w}
    hit = sum(len({x for x, _ in got[q].values()} & {x for x, _ in w}) for q, w in want.items())
    assert all(sorted(got[q]) == list(range(1, len(w) + 1)) for q, w in want.items() if w)
    return got, want, hit / max(1, sum(map(len, want.values())))


def test_all_codes_are_exact(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATES", 10_000)
    got, want, recall = compare(spark, rows, tmp_path)
    assert recall == 1
    for q, w in want.items():
        assert [got[q][k + 1][0] for k in range(len(w))] == [i for i, _ in w]
        assert np.allclose([got[q][k + 1][1] for k in range(len(w))], [d for _, d in w], rtol=1e-12, atol=1e-12)


def test_recall_of_small_radii(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATES", 150)
    monkeypatch.setattr(neighbours, "QUERIES", 70)
    assert compare(spark, rows, tmp_path)[2] >= 0.9


def test_few_rows(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATES", 1)
    few = rows[:4] + [(10, rows[0][1]), (15, rows[0][1])]
    assert compare(spark, few, tmp_path)[2] == 1
    assert nearest(table(spark, []), F.lit(True), folder=str(tmp_path / "e")).collect() == []
    assert nearest(table(spark, rows[:1]), F.lit(True), folder=str(tmp_path / "o")).collect() == []


def test_probing_finds_every_code_within_the_radius(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(300, 16))
    codes = Codes.fit(v)
    code = codes.of(v)
    assert code.shape == (300, 4)
    df = spark.createDataFrame([(i, x.tolist(), [i]) for i, x in enumerate(v)], "entry long, v array<double>, ids array<long>")
    query, radius = code[:20], np.arange(10, 30).astype(np.int32)
    got = sorted((x.query_id, x.entry) for x in neighbours.probe(neighbours.build_index(df, codes), np.arange(20), query, radius).collect())
    assert got == [(i, j) for i in range(20) for j in range(300) if hamming(query[i], code[j]) <= radius[i]]
    assert radii(query, code, 1.0).tolist() == [64] * 20 and (radii(query, code, 0.1) < 40).all()


def test_radii_cover_the_true_neighbours(spark, tmp_path, monkeypatch):
    """A radius of a fixed number of codes loses them; the measured one does not."""
    monkeypatch.setattr(neighbours, "CANDIDATES", 12)
    v = np.random.default_rng(7).normal(size=(3000, 16)).astype(np.float32)
    assert compare(spark, [(i, x.tolist()) for i, x in enumerate(v)], tmp_path)[2] >= 0.95


def test_codes_and_radii_of_queries_are_worked_out_by_tasks(spark, rows, tmp_path, monkeypatch):
    """The driver encodes nothing but the probes, and computes no radius."""
    v = np.random.default_rng(2).normal(size=(400, 16))
    codes = Codes.fit(v)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:50])], "query_id long, v array<double>")
    got = sorted(neighbours.questions(asked, codes, v, 0.1).collect())
    assert [bytes(r.code) for r in got] == [x.tobytes() for x in codes.of(v[:50])]
    assert [r.radius for r in got] == radii(codes.of(v[:50]), codes.of(v), 0.1).tolist()
    inner = neighbours.nearest.__code__
    assert "radii" not in inner.co_names and "questions" in inner.co_names
