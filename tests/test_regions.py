"""The region cascade against a plain one, over all combinations of present and missing rectangles."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from focuslake.functions import constants as C
from focuslake.functions.cascade import detector_region, fallback_region
from focuslake.functions.geometry import RECT, eye_box, head_box
from focuslake.operators.regions import animal_regions, crop_failure, pick_path

NAMES = ["animal_eye", "animal_head", "animal_body", "human_eye", "human_face", "af"]
RECTS = {
    "animal_eye": [None, (0.2, 0.2, 0.1, 0.1), (0.2, 0.2, 0.02, 0.02)],  # the last one is exactly too small
    "animal_head": [None, (0.1, 0.1, 0.4, 0.3)],
    "animal_body": [None, (0.1, 0.1, 0.5, 0.8)],
    "human_eye": [None, (0.6, 0.6, 0.1, 0.1), (0.6, 0.6, 0.01, 0.04)],
    "human_face": [None, (0.5, 0.5, 0.3, 0.3)],
    "af": [None, (0.15, 0.15, 0.1, 0.1), (0.2, 0.5, 0.1, 0.1), (0.9, 0.9, 0.1, 0.1)],
}


def area(r):
    return r[2] * r[3]


def meet(a, b):
    if a is None or b is None:
        return None
    x, y = max(a[0], b[0]), max(a[1], b[1])
    w, h = min(a[0] + a[2], b[0] + b[2]) - x, min(a[1] + a[3], b[1] + b[3]) - y
    return (x, y, w, h) if w >= 0 and h >= 0 and w * h > 0.001 else None


def grown(r):
    x, y, w, h = r[0] - r[2] * 0.5, r[1] - r[3] * 0.5, r[2] * 2, r[3] * 2
    cx, cy = max(0.0, min(x, 1.0)), max(0.0, min(y, 1.0))
    return (cx, cy, max(min(x + w, 1.0) - cx, 0.0), max(min(y + h, 1.0) - cy, 0.0))


def plain_fallback(animal_eye, animal_head, animal_body, human_eye, human_face, af):
    if animal_eye and area(animal_eye) > 0.0004:
        return animal_eye, C.ANIMAL_EYES
    if animal_head:
        shared = meet(animal_head, af)
        return (shared, C.AF_AND_SUBJECT) if shared else (animal_head, C.ANIMAL_HEAD)
    if human_eye and area(human_eye) > 0.0004:
        return human_eye, C.HUMAN_EYES
    if human_face:
        return human_face, C.HUMAN_FACE
    if meet(af, animal_body):
        return meet(af, animal_body), C.AF_AND_SUBJECT
    if af:
        return grown(af), C.AF_POINT
    if animal_body:
        return animal_body, C.ANIMAL_BODY
    return None, C.FULL_IMAGE


def plain_detector(eye, head, af):
    if eye and area(eye) > 0.0004:
        return eye, C.DETECTOR_EYES
    shared = meet(head, af)
    return (shared, C.AF_AND_SUBJECT) if shared else (head, C.DETECTOR_HEAD)


def check(df, want):
    for row in df.collect():
        rect, region = want[row.id]
        assert row.c.region == region, row
        assert (rect is None) == (row.c.rect is None), row
        if rect is not None:
            assert tuple(row.c.rect) == pytest.approx(rect), row


def test_fallback_cascade(spark):
    cases = list(product(*[RECTS[n] for n in NAMES]))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, " + ", ".join(f"{n} {RECT}" for n in NAMES))
    check(df.select("id", fallback_region(*map(F.col, NAMES)).alias("c")), {i: plain_fallback(*c) for i, c in enumerate(cases)})


def test_detector_cascade(spark):
    cases = list(product(RECTS["animal_eye"], [RECTS["animal_head"][1]], RECTS["af"]))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"id int, eye {RECT}, head {RECT}, af {RECT}")
    check(df.select("id", detector_region(F.col("eye"), F.col("head"), F.col("af")).alias("c")),
          {i: plain_detector(*c) for i, c in enumerate(cases)})


POINT = "struct<x:double,y:double>"


@pytest.mark.parametrize("eyes, nose, head, eye", [
    ([], None, (0.1, 0.2, 0.4, 0.15), None),
    ([(0.5, 0.5)], None, (0.1, 0.2, 0.4, 0.15), None),
    ([(0.5, 0.5)], (0.6, 0.6), (0.46, 0.46, 0.18, 0.18), None),
    ([(0.01, 0.5), (0.2, 0.52)], None, (0.0, 0.46, 0.27, 0.10), (0.0, 0.45, 0.29, 0.12)),
    ([(0.5, 0.97), (0.99, 0.99)], (0.7, 0.99), (0.46, 0.93, 0.57, 0.10), (0.45, 0.92, 0.59, 0.12)),
])
def test_boxes_around_keypoints(spark, eyes, nose, head, eye):
    """The detector's boxes may reach over the image edge: only their size is capped, at 1."""
    df = spark.createDataFrame([(eyes, nose, (0.1, 0.2, 0.4, 0.5))], f"eyes array<{POINT}>, nose {POINT}, body {RECT}")
    row = df.select(head_box(F.col("eyes"), F.col("nose"), F.col("body")).alias("head"), eye_box(F.col("eyes")).alias("eye")).first()
    assert tuple(row.head) == pytest.approx(head)
    assert (row.eye is None) == (eye is None)
    if eye:
        assert tuple(row.eye) == pytest.approx(eye)


PICKED = f"path string, path_taken string, region string, rect {RECT}, box {RECT}, width int, height int"


def test_crop_outside_the_image(spark):
    far, box = (1.5, 0.2, 0.1, 0.1), (0.1, 0.1, 0.2, 0.2)
    rows = [
        ("d", "detector", C.DETECTOR_HEAD, far, box, 100, 50),
        ("f", "fallback", C.AF_POINT, far, None, 100, 50),
        ("n", "fallback", C.FULL_IMAGE, None, None, 100, 50),
        ("i", "fallback", C.AF_POINT, (0.105, 0.5, 0.2, 0.2), None, 100, 50),
    ]
    got = {r.path: r for r in crop_failure(spark.createDataFrame(rows, PICKED)).collect()}
    whole = (0, 0, 100, 50)
    assert (got["d"].region, got["d"].size_conf, tuple(got["d"].rect), tuple(got["d"].window)) == (C.DETECTOR_BODY, 0.7, box, whole)
    assert (got["f"].region, got["f"].size_conf, tuple(got["f"].rect), tuple(got["f"].window)) == (C.AF_POINT, 1.0, far, whole)
    assert (got["n"].region, got["n"].size_conf, got["n"].rect, tuple(got["n"].window)) == (C.FULL_IMAGE, 0.7, None, whole)
    assert tuple(got["i"].window) == (10, 25, 31, 35)


def test_labels_of_both_paths(spark):
    """Detector labels are capitalised, fallback labels stay; a person can be the subject."""
    parts = ", ".join(f"{n} {RECT}" for n in ("animal_eye", "animal_head", "animal_body", "human_eye", "human_face", "af_rect"))
    files = spark.createDataFrame(
        [("a", *[None] * 6, "tabby cat"), ("b", *[None] * 6, "tabby cat")], f"path string, {parts}, animal_label string")
    best = spark.createDataFrame(
        [("a", "teddy bear", 0.5, (0.1, 0.1, 0.5, 0.5), [], None)],
        f"path string, label string, confidence float, box {RECT}, eye_kps array<{POINT}>, nose {POINT}")
    got = {r.path: (r.path_taken, r.region, r.label) for r in pick_path(files, best, "path").collect()}
    assert got == {"a": ("detector", C.DETECTOR_HEAD, "Teddy Bear"), "b": ("fallback", C.FULL_IMAGE, "tabby cat")}


def test_unsure_joints_count_but_span_nothing(spark):
    rows = [(1, 0, "Left_Eye", 0.5, 0.5, 0.2), (1, 0, "Nose", 0.5, 0.4, 0.1), (1, 1, "Tail", 0.3, 0.3, 0.9)]
    joints = spark.createDataFrame(rows, "image_id int, pose int, joint string, x double, y double, confidence double")
    row = animal_regions(joints).first()
    assert (row.eye, row.head, row.body) == (None, None, None)
