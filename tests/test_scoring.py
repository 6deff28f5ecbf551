"""Thresholds, their exact bounds, and sizes."""

import pytest
from pyspark.sql import functions as F

from focuslake.functions import constants as C, scoring as S
from focuslake.functions.cascade import eye_usable, overlap_usable
from focuslake.functions.files import format_size, review_note
from focuslake.functions.geometry import rect
from focuslake.plans.focus import score_columns


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("region", list(C.REGION_BOUNDS))
def test_bounds_are_inclusive(spark, region):
    divisor, sharp, acceptable = C.REGION_BOUNDS[region]
    rows = [(sharp,), (sharp - 1e-9,), (acceptable,), (acceptable - 1e-9,)]
    scored = spark.createDataFrame(rows, "s double").select(
        S.focus_status(F.col("s"), F.lit(sharp), F.lit(acceptable)).alias("status"),
        S.blur_type(F.col("s"), F.lit(sharp), F.lit(acceptable), F.lit(100.0), F.lit(100.0)).alias("blur"),
    ).collect()
    assert [r.status for r in scored] == [C.SHARP, C.SLIGHTLY_BLURRY, C.SLIGHTLY_BLURRY, C.BLURRY]
    assert [r.blur for r in scored] == [C.BLUR_NONE, C.MIXED, C.MIXED, C.OUT_OF_FOCUS]
    assert one(spark, S.region_thresholds(F.lit(region)).alias("b")).b.divisor == divisor


def test_unknown_region_uses_full_image_bounds(spark):
    assert tuple(one(spark, S.region_thresholds(F.lit("else")).alias("b")).b) == C.FULL_BOUNDS


@pytest.mark.parametrize("low, high, blur", [
    (40.0, 100.0, C.MIXED), (39.9, 100.0, C.MOTION_BLUR), (0.1, 1.0, C.MIXED), (0.1, 1.1, C.MOTION_BLUR)])
def test_motion_ratio(spark, low, high, blur):
    got = one(spark, S.blur_type(F.lit(0.4), F.lit(0.6), F.lit(0.3), F.lit(low), F.lit(high)).alias("b"))
    assert got.b == blur


@pytest.mark.parametrize("area, expected", [
    (None, 0.7), (0.01, 1.0), (0.5, 1.0), (0.002, 0.3), (0.0019, 0.3), (0.006, 0.65)])
def test_size_confidence(spark, area, expected):
    r = rect(F.lit(0.0), F.lit(0.0), F.lit(area).cast("double"), F.lit(1.0))
    assert one(spark, S.subject_size_confidence(r).alias("c")).c == pytest.approx(expected)


def test_size_confidence_scales_after_the_cap(spark):
    """A tiny subject is capped at 0.3, however sharp it is: head reaches its lower bound exactly."""
    rows = [(r, 0.3, 1e6, 1e6, 1e6) for r in ("Animal Eyes", "Animal Head", "Animal Body")]
    scored = score_columns(spark.createDataFrame(rows, "region string, size_conf double, var_h double, var_v double, combined double"))
    got = {r.region: (r.score, r.status) for r in scored.collect()}
    assert got == {
        "Animal Eyes": (0.3, C.SLIGHTLY_BLURRY), "Animal Head": (0.3, C.SLIGHTLY_BLURRY), "Animal Body": (0.3, C.BLURRY)}


def test_missing_variance_is_not_a_score(spark):
    r = one(spark, S.focus_score(F.lit(None).cast("double"), F.lit(200.0), F.lit(1.0)).alias("s"))
    assert r.s is None


def test_gray_truncates(spark):
    assert one(spark, S.gray(F.lit(255), F.lit(255), F.lit(254)).alias("g")).g == 254
    assert one(spark, S.gray(F.lit(1), F.lit(1), F.lit(0)).alias("g")).g == 0


@pytest.mark.parametrize("w, eye, overlap", [(0.0004, False, False), (0.00041, True, False), (0.001, True, False), (0.0011, True, True)])
def test_area_gates_are_strict(spark, w, eye, overlap):
    r = rect(F.lit(0.0), F.lit(0.0), F.lit(w), F.lit(1.0))
    assert tuple(one(spark, eye_usable(r), overlap_usable(r))) == (eye, overlap)


@pytest.mark.parametrize("size, text", [
    (0, "Zero KB"), (999, "999 bytes"), (1000, "1 KB"), (1499, "1 KB"), (1500, "2 KB"),
    (25_450_000, "25.5 MB"), (25_449_999, "25.4 MB"), (1_234_000_000, "1.23 GB"), (2_005_000_000, "2.01 GB")])
def test_format_size(spark, size, text):
    assert one(spark, format_size(F.lit(size)).alias("t")).t == text


@pytest.mark.parametrize("status, label, conf, blur, size_conf, expected", [
    (C.NOT_ANALYZED, "Cat", 0.5, C.MIXED, 0.3, (None, None, None)),
    (C.SHARP, "Cat", 0.359, C.BLUR_NONE, 0.3, ("YOLO 35%", None, None)),
    (C.BLURRY, "Cat", None, C.MOTION_BLUR, 0.69, ("Vision", C.MOTION_BLUR, "Small subject")),
    (C.BLURRY, None, None, C.UNKNOWN_BLUR, 0.7, (None, None, None)),
])
def test_review_note(spark, status, label, conf, blur, size_conf, expected):
    note = review_note(
        F.lit(status), F.lit(label).cast("string"), F.lit(conf).cast("float"), F.lit(blur), F.lit(size_conf))
    assert tuple(one(spark, note.alias("n")).n) == expected
