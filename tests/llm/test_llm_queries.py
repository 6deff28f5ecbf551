"""Registered queries against their SQL, and the pipeline stage by stage."""

import os
import sys

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from focuslake.llm.queries import ORACLES, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    outcome = compare(spark, connect(FOLDER), FOLDER, name)
    assert outcome.startswith("ok"), outcome


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids and ids <= before
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        before = ids
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_toxic_documents_go(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, FOLDER).select("doc_id").collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    toxic = {r.doc_id for r in labels if r.toxic}
    clean = {r.doc_id for r in labels if not r.toxic}
    assert len(toxic & left) <= 0.3 * len(toxic) and len(clean & left) >= 0.98 * len(clean)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, documents, odd, stage):
    assert stage(spark, documents(odd), FOLDER).count() <= len(odd)
    assert stage(spark, documents([]), FOLDER).count() == 0
