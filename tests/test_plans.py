"""What the plans look like, so that they stay fit for large tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from focuslake.operators import pixels as P
from focuslake.plans.queries import QUERIES
from focuslake.plans.queries.regions import picked

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def large(spark):
    """Plans as for large tables: nothing is broadcast by size, no change at run time."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


IN_PYTHON = {
    "focus_from_grids", "analyze_focus", "review_note", "laplacian_udf", "detect_with", "read_images", "analyze_images", "analyze_card",
    "scan_catalog", "scan_many_roots", "read_bytes", "write_sidecars", "catalog_walk", "catalog_content", "stream_catalog", "changed_files", "detect_in_batches", "save_sidecars", "score_regions", "progress"}


@needs_tables
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in IN_PYTHON | {"analyze_stream"}])
def test_no_python_and_no_pairs(large, name):
    plan = plan_of(queries()[name](large, FOLDER))
    assert not re.search(r"Python|InPandas|InArrow", plan)
    assert "CartesianProduct" not in plan
    # Literal rows of a query's own (frames, zooms) are the only nested loop allowed.
    assert "BroadcastNestedLoopJoin" not in plan


@needs_tables
@pytest.mark.parametrize("name", [
    "focus_from_grids", "laplacian_array", "pose_decode", "af_decode", "extract_af_tags", "flatten_metadata", "build_xmp",
    "carve_between", "confidence_gate", "af_layout", "gray", "fit_rect"])
def test_row_work_does_not_shuffle(large, name):
    plan = plan_of(queries()[name](large, FOLDER))
    # The containers of the tag query are themselves built from two payloads per order.
    assert plan.count("Exchange") == (1 if name == "extract_af_tags" else 0), plan


@needs_tables
@pytest.mark.parametrize("name, exchanges", [
    ("second_difference", 1), ("directional_laplacian", 2), ("downscale", 1), ("best_detection", 1), ("top_detections", 1),
    ("preferred_union", 1), ("af_counts", 1), ("rect_union", 1), ("tag_priority", 1), ("pose_regions", 1), ("status_summary", 3)])
def test_number_of_shuffles(large, name, exchanges):
    plan = plan_of(queries()[name](large, FOLDER))
    assert len(re.findall(r"(?<!Reused)Exchange ", plan)) == exchanges, plan


@needs_tables
def test_crop_join_and_windows_share_a_shuffle(large):
    plan = plan_of(queries()["cropped_laplacian"](large, FOLDER))
    assert len(re.findall(r"Exchange hashpartitioning\(vec_id#\d+L, ty", plan)) == 2  # pixels and windows, once each
    assert "REPARTITION" not in plan


@needs_tables
def test_top_rows_are_cut_before_the_shuffle(large):
    plan = plan_of(queries()["top_detections"](large, FOLDER))
    assert re.search(r"WindowGroupLimit .*Final", plan) and re.search(r"WindowGroupLimit .*Partial", plan)
    assert plan.index("Partial") > plan.index("Exchange")


@needs_tables
@pytest.mark.parametrize("name, columns", [
    ("best_detection", {"event_id", "user_id", "event_type", "value"}),
    ("preferred_union", {"l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"}),
    ("richest_pose", {"l_orderkey", "l_returnflag"}), ("first_success", {"l_orderkey", "l_linenumber", "l_quantity", "o_orderkey"}),
    ("second_difference", {"vec_id", "embedding"})])
def test_scans_read_only_what_they_need(large, name, columns):
    plan = plan_of(queries()[name](large, FOLDER))
    read = set(re.findall(r"(\w+)#", " ".join(re.findall(r"FileScan parquet \[(.*?)\]", plan))))
    assert read == columns


@needs_tables
def test_filters_reach_the_scan(large):
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan_of(queries()["face_eye_box"](large, FOLDER)))
    assert any("LessThanOrEqual(l_linenumber,2)" in p for p in pushed)


def test_tiles_do_not_depend_on_image_size(spark):
    big = spark.range(100 * 300).selectExpr("1 as image_id", "int(id div 300) as y", "int(id % 300) as x", "1 as g")
    most = P.with_tiles(big, 32).groupBy("ty", "tx").count().agg(F.max("count")).first()[0]
    assert most <= 34 * 34


@needs_tables
def test_rows_of_other_images_go_before_the_grouping(spark):
    lines = picked(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(re.match(r"[ :+-]*", line).group()) for line in lines]
    for k, line in enumerate(lines):
        if "l_orderkey" in line and "Relation" in line:   # what stands above each scan of focus points, from the nearest
            above, least = [], depth[k]
            for i in range(k - 1, -1, -1):
                if depth[i] < least:
                    above, least = [*above, lines[i]], depth[i]
            kinds = [kind for a in above for kind in ("LeftSemi", "Aggregate") if kind in a]
            assert kinds[0] == "LeftSemi" and "Aggregate" in kinds
