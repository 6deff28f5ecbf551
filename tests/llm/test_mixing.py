import numpy as np
import pytest
from pyspark.sql import functions as F

from focuslake.llm import mixing
from focuslake.llm.mixing import draw, mixed, probabilities, rake, tempered, tokens


def cells(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, tokens long")


def fit(n, a, b):
    """The same fit over a small matrix."""
    w = np.array(n, float)
    w /= w.sum()
    for _ in range(500):
        w *= (a / w.sum(1))[:, None]
        w *= b / w.sum(0)
    return w


@pytest.mark.parametrize("limit", [mixing.BROADCAST_CELLS, 0])
def test_margins_meet_their_targets(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", limit)
    monkeypatch.setattr(mixing, "SWEEPS", 60 if limit else 8)
    n = [[90, 10, 5], [40, 30, 7], [3, 2, 50]]
    df = cells(spark, [(f"s{i}", f"l{j}", n[i][j]) for i in range(3) for j in range(3)])
    goals = {"source": spark.createDataFrame([("s0", 2.0), ("s1", 1.0), ("s2", 1.0), ("absent", 9.0)], "value string, share double"),
             "lang": spark.createDataFrame([("l0", 0.2), ("l1", 0.3), ("l2", 0.5)], "value string, share double")}
    got = {(r.source, r.lang): r.weight for r in rake(df, goals, str(tmp_path)).collect()}
    want = fit(n, np.array([0.5, 0.25, 0.25]), np.array([0.2, 0.3, 0.5]))
    assert all(abs(got[f"s{i}", f"l{j}"] - want[i, j]) < (1e-8 if limit else 1e-3) for i in range(3) for j in range(3))


def test_probabilities_are_calibrated(spark, tmp_path):
    df = cells(spark, [("a", "x", 1000), ("b", "x", 10), ("c", "x", 500), ("d", "x", 0)]).withColumn(
        "weight", F.element_at(F.create_map(*[F.lit(x) for p in (("a", 0.3), ("b", 0.3), ("c", 0.4), ("d", 0.0)) for x in p]), F.col("source")))
    got = {r.source: r for r in probabilities(df, 0.5, str(tmp_path)).collect()}
    assert got["b"].probability == 1 and got["d"].probability == 1
    assert abs(sum(r.probability * r.tokens for r in got.values()) - 755) < 1e-6
    assert abs(got["a"].probability * 1000 / (got["c"].probability * 500) - 0.75) < 1e-9


def test_documents_are_drawn_by_their_cells(spark, documents, odd, prose, tmp_path):
    rows = odd + [(1000 + i, prose(20, i)) for i in range(900)]
    docs = documents(rows, extra=True).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("source")))
    dims = {"source": F.col("source"), "form": F.when(F.col("text").contains("ba"), "b")}
    out = mixed(docs, dims, lambda c: {d: tempered(c, d, 0.5) for d in dims}, 0.4, folder=str(tmp_path / "m"))
    assert out.columns.count("probability") == 1 and "odd name" in out.columns and out.columns.count("mixing_source") == 1
    assert {(r["_0"], r["__0"], r["in_1"]) for r in out.collect()} == {(7, 7, 7)}
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Arrow"))
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 and r.selected is not None for r in got)
    assert len({r.selected for r in got if r.doc_id == 2}) == 1
    for group in {(r.mixing_source, r.mixing_form) for r in got}:
        part = [r for r in got if (r.mixing_source, r.mixing_form) == group and (r.doc_id or 0) >= 1000]
        if len(part) > 60:
            assert abs(np.mean([r.selected for r in part]) - part[0].probability) < 0.2


def test_values_without_target_are_left_out(spark, documents, tmp_path):
    docs = documents([(i, "a b c") for i in range(30)])
    target = spark.createDataFrame([("s1", 1.0), ("s2", 0.0)], "value string, share double")
    got = mixed(docs, {"source": F.col("source")}, lambda c: {"source": target}, 0.2, folder=str(tmp_path / "m")).collect()
    assert all((r.probability > 0) == (r.source == "s1") for r in got)


def test_empty_table_and_words(spark, documents, tmp_path):
    assert mixed(documents([]), {"lang": F.col("lang")}, lambda c: {"lang": tempered(c, "lang", 1.0)}, folder=str(tmp_path / "m")).collect() == []
    row = spark.createDataFrame([(" a\tb\nc d ", None)], "t string, n string").select(tokens(F.col("t")).alias("a"), tokens(F.col("n")).alias("b")).first()
    assert (row.a, row.b) == (3, 0)
    u = [r.u for r in spark.range(2000).select(draw(F.col("id"), "s").alias("u")).collect()]
    assert 0.47 < np.mean(u) < 0.53 and min(u) >= 0 and max(u) < 1
