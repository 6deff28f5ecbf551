"""Every registered query against its SQL in DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare, connect  # noqa: E402
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from focuslake.plans.queries import QUERIES, catalog  # noqa: E402

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


# The queries of the optional subpackage have tests of their own.
NAMES = list(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    outcome = compare(spark, con, FOLDER, name)
    assert outcome.startswith("ok"), outcome


def test_every_query_has_sql():
    assert set(NAMES) <= set(queries()) and set(NAMES) <= set(oracle_sql())


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r.status for r in rows} == {"Sharp", "Slightly Blurry", "Blurry"}


def test_no_listing_goes_through_one_task(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://a/{i}", "x" * (i + 1)) for i in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/in/pages.parquet")
    monkeypatch.setattr(catalog, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {(r.path, r.size): r.times for r in queries()["changed_files"](spark, f"{tmp_path}/in").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len([f for f in os.listdir(f"{tmp_path}/listings/checkpoint/commits") if f.isdigit()]) == 3
    assert len([f for f in os.listdir(f"{tmp_path}/listings/listings") if f.endswith(".parquet")]) >= 12
    assert got[("/card/1", 2)] == 1 and got[("/card/0", 1)] == 2 and got[("/card/0", 2)] == 1 and got[("/card/5x", 6)] == 1
    assert sum(got.values()) == 40 + 14 + 7 + 8
