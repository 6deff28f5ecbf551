import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from focuslake.llm.toxicity import Chain, _fit, sample_of, score, train


@pytest.fixture
def labelled(spark, documents, prose):
    r, rows, labels = random.Random(2), [], []
    for i in range(600):
        words, bad, junk = prose(r.randrange(20, 200), i).split(), i % 4 == 0, i % 7 == 0
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["Swine!", "moronic,", "moronish"]))
        if junk:
            words += ["#### ####"] * 3 + ["spamword"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), int(junk)))
    return rows, documents(rows, extra=True), spark.createDataFrame(labels, "doc_id long, toxic int, junk int")


def test_held_out_accuracy(spark, labelled, tmp_path):
    rows, docs, labels = labelled
    chain = train(docs, labels.where("doc_id < 400"), ["junk", "toxic"], folder=str(tmp_path / "t"))
    assert [len(w) for w in chain.weights] == [len(chain.bins) + 1, len(chain.bins) + 2]
    scored = score(docs, chain)
    assert scored.columns.count("p_toxic") == 1 and "odd name" in scored.columns
    got = {r.doc_id: r for r in scored.collect()}
    rest = range(400, 600)
    assert np.mean([got[i].is_toxic == (i % 4 == 0) for i in rest]) > 0.97 and np.mean([got[i].is_junk == (i % 7 == 0) for i in rest]) > 0.97


def test_odd_rows(spark, documents, labelled, odd, tmp_path):
    _, docs, labels = labelled
    known = labels.union(spark.createDataFrame([(None, 1, 1), (1, None, None), (5, 1, 0)], "doc_id long, toxic int, junk int"))
    chain = train(docs.union(docs), known, ["toxic"], rows=300, folder=str(tmp_path / "t"))
    got = score(documents(odd), chain).collect()
    assert len(got) == len(odd) and all(0 < r.p_toxic < 1 for r in got)
    assert len({r.p_toxic for r in got if not (r.text or "").strip()}) == 1
    assert sample_of(docs, known, ["toxic"], 300).select("doc_id").distinct().count() == 300


def test_no_labels_and_no_documents(spark, documents, labelled, tmp_path):
    _, docs, labels = labelled
    chain = train(docs, labels.where("false"), ["toxic"], folder=str(tmp_path / "a"))
    assert {r.is_toxic for r in score(docs, chain).collect()} == {False} or len(chain.bins) == 0
    chain = train(documents([]), labels, ["junk", "toxic"], folder=str(tmp_path / "b"))
    assert score(documents([]), chain).collect() == []
    one = train(docs, labels.withColumn("toxic", F.lit(1)), ["toxic"], folder=str(tmp_path / "c"))
    assert {r.is_toxic for r in score(docs, one).collect()} == {True}


def test_later_models_use_earlier_probabilities():
    r = np.random.default_rng(1)
    earlier = r.random((500, 1))
    y = (earlier[:, 0] > 0.5).astype(int)
    w = _fit(np.zeros(0, int), np.zeros(0, int), earlier, y, 0)
    assert w[0] > 1
    chain = Chain(["a", "b"], np.array([3]), [np.array([9.0, -4.0]), np.array([0.0, 8.0, -4.0])])
    p = chain.probabilities(2, np.array([0]), np.array([0]))
    assert p[0, 0] > 0.9 and p[0, 1] > 0.9 and p[1, 0] < 0.1 and p[1, 1] < 0.1
