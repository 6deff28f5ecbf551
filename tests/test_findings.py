"""Cases outside the tidy fixtures: NaN, ragged arrays, unreadable metadata, results of poses and faces."""

import pytest
from pyspark.sql import functions as F

from focuslake.operators.afpoints import af_rects, header_af_rects, prefer_tier
from focuslake.operators.detections import POINT, POINTS, best_detection, class_argmax, confidence_gate, pose_decode
from focuslake.operators.metadata import flatten_metadata, unreadable_metadata
from focuslake.operators.regions import animal_result, human_result
from focuslake.operators.udf import full_window, grid_moments_udf
from focuslake.functions.geometry import RECT
from focuslake.plans.focus import plan_regions
from focuslake.sources.headers import extract_af_tags
from test_focus_points import LEGACY, OLD, PAD, PRECISE, STUB, box, tiff

NAN = float("nan")


def test_nan_passes_no_gate(spark):
    rows = spark.createDataFrame([(1, 0, NAN, "cat"), (1, 1, 0.9, "dog"), (1, 2, 0.1, "cat")], "image_id long, ord int, confidence float, label string")
    assert [r.ord for r in best_detection(confidence_gate(rows)).collect()] == [1]
    scores = spark.createDataFrame([([NAN, 0.2, 0.7],), ([NAN],), ([],)], "s array<float>").select(class_argmax(F.col("s")).alias("b"))
    assert [(r.b["class"], round(r.b["score"], 3)) for r in scores.collect()] == [(2, 0.7), (0, 0.0), (0, 0.0)]


def test_nan_in_pose_vectors(spark):
    def vector(objectness, score, visible):
        return [0.5, 0.5, 0.2, 0.2, objectness, score] + [0.4, 0.4, visible] * 17

    rows = [(1, 0, vector(NAN, 0.9, 1.0)), (1, 1, vector(0.9, NAN, 1.0)), (1, 2, vector(0.9, 0.9, NAN)), (1, 3, vector(0.9, 0.9, 1.0))]
    got = {r.ord: r for r in pose_decode(spark.createDataFrame(rows, "image_id long, anchor int, features array<float>")).collect()}
    assert set(got) == {2, 3} and got[2].nose is None and got[2].eye_kps == [] and got[3].nose is not None


def test_ragged_arrays_have_no_moments(spark):
    rows = spark.createDataFrame([(0, [1] * 9 + [2] * 3, 3), (1, [1] * 11, 3), (2, [1] * 11 + [None], 3), (3, None, 3)], "i int, g array<int>, w int")
    got = rows.select("i", grid_moments_udf(F.col("g"), F.col("w"), full_window(F.col("w"), F.lit(4))).alias("m")).collect()
    assert {r.i: r.m is not None and r.m.n is not None for r in got} == {0: True, 1: False, 2: False, 3: False}


def test_unreadable_metadata_is_reported(spark):
    docs = spark.createDataFrame([("a", '{"x": {"y": 1}}'), ("b", "{oops"), ("c", '{"k": 1, "k": 2}'), ("d", "[1]"), ("e", None), ("f", "{}")], "path string, doc string")
    assert {r.path for r in flatten_metadata(docs).collect()} == {"a"}
    assert {r.path: r.error for r in unreadable_metadata(docs).collect()} == {
        "b": "not JSON, or a key is repeated", "c": "not JSON, or a key is repeated", "d": "not an object"}


def test_deep_metadata(spark):
    deep = '{"k": ' * 40 + "1" + "}" * 40
    row = flatten_metadata(spark.createDataFrame([("a", deep)], "path string, doc string")).first()
    assert row.key == " > ".join(["k"] * 40) and row.value == "1"


def test_header_focus_points_need_no_shuffle(spark):
    contents = [PAD + box(tiff([(LEGACY, OLD), (PRECISE, STUB)])) + b"tail" * 10, b"nothing", None]
    headers = spark.createDataFrame([(str(i), c) for i, c in enumerate(contents)], "path string, content binary")
    rows = header_af_rects(headers)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want = {r.path: r.af_rect for r in af_rects(extract_af_tags(headers)).collect()}
    assert {r.path: r.af_rect for r in rows.collect()} == want and set(want) == {"0"}


def test_tier_of_a_crowded_image(spark):
    points = spark.range(3000).selectExpr("if(id % 3 = 0, -1L, id) as image_id", "id % 2 = 0 as in_focus", "true as selected", "id")
    got = prefer_tier(points)
    assert got.filter("image_id = -1").count() == 500 and got.count() == 2500


def rows_of(df, *columns):
    return {r.image_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_animal_result(spark):
    """1: a pose with a body; 2: a pose without one, two boxes; 3: no pose; 4: only a label."""
    joints = spark.createDataFrame(
        [(1, 0, "left_eye", 0.3, 0.6, 0.9), (1, 0, "tail", 0.7, 0.2, 0.9), (2, 0, "left_eye", 0.5, 0.5, 0.01), (2, 0, "tail", 0.5, 0.5, NAN)],
        "image_id long, pose int, joint string, x double, y double, confidence double")
    boxes = spark.createDataFrame(
        [(1, 0, (0.0, 0.0, 1.0, 1.0)), (2, 0, (0.1, 0.1, 0.2, 0.2)), (2, 1, (0.2, 0.2, 0.6, 0.5)), (3, 0, (0.5, 0.0, 0.5, 0.5))], f"image_id long, ord int, box {RECT}")
    labels = spark.createDataFrame([(1, 0, "dog", 0.9), (2, 0, "cat", 0.99), (2, 1, "bird", 0.4), (2, 1, "owl", 0.5), (4, 0, "fox", 1.0)],
                                   "image_id long, ord int, label string, confidence double")
    got = rows_of(animal_result(joints, boxes, labels), "eye", "head", "body", "label")
    assert set(got) == {1, 2, 3} and got[1][3] == "dog" and got[1][0] is not None and got[1][2].w < 0.6
    assert got[2][0] is None and got[2][3] == "owl" and [round(v, 9) for v in got[2][2]] == [0.2, 0.3, 0.6, 0.5]
    assert round(got[2][1].h, 9) == 0.15 and got[2][1].y == got[2][2].y
    assert got[3][3] is None and [round(v, 9) for v in got[3][2]] == [0.5, 0.5, 0.5, 0.5]


def test_human_result(spark):
    """1: the larger of two faces, whose landmarks count; 2: a face without landmarks; 3: landmarks without a face."""
    faces = spark.createDataFrame([(1, 0, (0.0, 0.0, 0.1, 0.1)), (1, 1, (0.2, 0.2, 0.4, 0.4)), (2, 0, (0.1, 0.6, 0.3, 0.3))], f"image_id long, ord int, box {RECT}")
    marks = spark.createDataFrame([(1, 0, 0.9, 0.9), (1, 1, 0.25, 0.5), (1, 1, 0.5, 0.5), (3, 0, 0.5, 0.5)], "image_id long, ord int, x double, y double")
    got = rows_of(human_result(faces, marks), "eye", "face")
    assert set(got) == {1, 2} and got[2][0] is None and [round(v, 9) for v in got[2][1]] == [0.1, 0.1, 0.3, 0.3]
    assert [round(v, 9) for v in got[1][1]] == [0.2, 0.4, 0.4, 0.4] and 0.25 < got[1][0].x < 0.3 and got[1][0].w < 0.2


@pytest.mark.parametrize("k, label", [(2, None), (None, "Cat")])
def test_any_rank_may_be_chosen(spark, k, label):
    images = spark.createDataFrame([(1, 100, 100)], "image_id long, width int, height int")
    found = spark.createDataFrame(
        [(1, i, "chair", 0.9, (0.1, 0.1, 0.5, 0.5), [], None) for i in range(2)] + [(1, 2, "cat", 0.5, (0.1, 0.1, 0.5, 0.5), [], None)],
        f"image_id long, ord int, label string, confidence float, box {RECT}, eye_kps {POINTS}, nose {POINT}")
    animals = spark.createDataFrame([], f"image_id long, eye {RECT}, head {RECT}, body {RECT}, label string")
    humans = spark.createDataFrame([], f"image_id long, eye {RECT}, face {RECT}")
    af = spark.createDataFrame([], f"image_id long, af_rect {RECT}")
    row = plan_regions(images, found, animals, humans, af, k=k).first()
    assert row.label == label if label else row.label != "Cat"


def test_a_header_is_searched_once(spark):
    headers = spark.createDataFrame([("a", bytearray(b"x" * 40))], "path string, content binary")
    plan = header_af_rects(headers)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CMT3") == 1 and header_af_rects(headers).count() == 0
