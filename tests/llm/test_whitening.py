from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from focuslake.llm import whitening


def table(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.selectExpr("*", "1 as x", "2 as component", "3 as n", "'v' as v", "4 as identity_error")


def brute(rows, k=16):
    """Everything from exact integers and a symmetric eigenvalue routine."""
    kept = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows]
    x = np.array(sorted({tuple(v) for _, v in kept}), object)
    n, s = len(x), x.sum(0)
    z = np.array([[float(Fraction(int(c), n)) for c in row] for row in n * x - s])
    covariance = z.T @ z / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    answers = []
    for i, v in kept:
        lifted = n * np.array(v, object) - s
        answers.append((i, n, int((lifted ** 2).sum()), (lifted / n).astype(float) @ vectors / np.sqrt(values)))
    return answers, values / np.trace(covariance)


def compare(spark, rows, odd, tmp_path, kind="float"):
    got = whitening.whiten(table(spark, rows + odd, kind), folder=str(tmp_path / "w")).collect()
    want, explained = brute(rows)
    k = len(explained)
    assert len(got) == k * len(rows) and {r.component for r in got} == set(range(1, k + 1))
    mine = {}
    for r in got:
        mine.setdefault((r.vec_id, r.n, r.deviation), []).append(r)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-8
    signs = None
    for i, n, deviation, whitened in want:
        found = sorted(mine[(i, n, deviation)], key=lambda r: r.component)[::1]
        values = np.array([r.whitened for r in found]).reshape(k, -1)[:, 0]
        if signs is None:
            signs = np.sign(values) * np.sign(whitened)
        assert np.allclose(values, signs * whitened, rtol=1e-8, atol=1e-8)


@pytest.fixture
def rows():
    r = np.random.default_rng(5)
    v = (r.normal(size=(600, 24)) * np.linspace(0.1, 2, 24)).astype(np.float32)
    out = [(i, v[i].tolist()) for i in range(600)]
    return out + [(7, v[7].tolist()), (900, v[8].tolist())] + [(1000 + i, v[5].tolist()) for i in range(300)] + [(None, v[9].tolist())]


ODD = [(2000, None), (2001, []), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, [1.0]), (2005, [float("inf")] + [1.0] * 23),
       (2006, [None] + [0.5] * 23)]


def test_equals_exact_arithmetic(spark, rows, tmp_path):
    compare(spark, rows, ODD, tmp_path)


def test_large_numbers(spark, tmp_path):
    r = np.random.default_rng(6)
    rows = [(i, (1e4 + r.normal(size=20) * np.arange(1, 21)).tolist()) for i in range(200)]
    compare(spark, rows, [(500, [1e30] * 20), (501, [-1e30] * 20)], tmp_path, "double")
    far = [(i, [7e16 * (-1) ** i * k, 3.0 * i * i, float(k)]) for i in range(5) for k in range(1, 2)]
    found = whitening.whiten(table(spark, far, "double"), folder=str(tmp_path / "far"))
    assert found.select("vec_id").distinct().count() == 5 and found.where("deviation is not null").count() == 0


def test_deviations_past_63_bits():
    model = whitening.Whitening(3, [3 << 40, 0], np.zeros(0), np.zeros((2, 0)), np.zeros(0))
    assert model.deviations(np.array([[1 << 40, 5], [1 << 50, 0]])) == [225, None]


def test_without_variance(spark, tmp_path):
    assert whitening.whiten(table(spark, []), folder=str(tmp_path / "a")).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), folder=str(tmp_path / "b")).collect() == []
    # Three vectors on a line: one component.
    flat = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(3)]), folder=str(tmp_path / "c")).collect()
    assert len(flat) == 3 and all(r.component == 1 and r.explained == pytest.approx(1.0) for r in flat)
    assert sorted(r.whitened for r in flat) == pytest.approx([-1.5 ** 0.5, 0, 1.5 ** 0.5])


def test_small_eigenvalues_keep_their_digits():
    r = np.random.default_rng(7)
    q = np.linalg.qr(r.normal(size=(12, 12)))[0]
    scale = 10.0 ** -np.arange(12)
    a = (scale[:, None] * (q @ np.diag(np.linspace(1, 2, 12)) @ q.T)) * scale
    values, vectors = whitening.principal((a + a.T) / 2)
    assert len(values) >= 8 and np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-9)
    assert np.allclose(a @ vectors, vectors * values, rtol=0, atol=1e-14 * values[0])


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_every_two_columns_meet_once(n):
    pairs = [(int(a), int(b)) for p, q in whitening.rounds(n) for a, b in zip(p, q)]
    assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_partitioning_does_not_matter(spark, rows, tmp_path):
    df = table(spark, rows)
    one, many = (whitening.whiten(df.repartition(p), folder=str(tmp_path / str(p))) for p in (1, 9))
    joined = one.alias("a").join(many.alias("b"), ["vec_id", "component"]).where("vec_id < 600 and vec_id <> 7")
    assert joined.agg(F.max(F.abs(F.col("a.whitened") - F.col("b.whitened")))).first()[0] < 1e-9
