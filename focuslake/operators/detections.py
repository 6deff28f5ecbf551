"""Object detections: gates, ranking, decoding of model output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as C
from ..functions.geometry import clamp_rect, rect, rect_area, unit_rect
from ..functions.labels import class_label, is_animal

POINT = "struct<x:double,y:double>"
POINTS = f"array<{POINT}>"


def float_lit(v: float) -> Column:
    """A gate in 32-bit precision, as confidences are."""
    return F.lit(v).cast("float")


def passes(confidence: Column, gate: float = C.DETECTION_GATE) -> Column:
    """NaN passes no gate, though Spark orders it above all numbers."""
    return (confidence.cast("float") >= float_lit(gate)) & ~F.isnan(confidence.cast("float"))


def confidence_gate(detections: DataFrame, gate: float = C.DETECTION_GATE) -> DataFrame:
    return detections.filter(passes(F.col("confidence"), gate))


def top_detections(
    detections: DataFrame, k: int = C.MAX_DETECTIONS, image: str = "image_id", order: str = "ord"
) -> DataFrame:
    """The ``k`` most confident detections of each image, earlier ones first among equals.

    Spark keeps at most ``k`` rows per image in each task before the shuffle, so a hot image is
    cut down where it is read.
    """
    by_rank = Window.partitionBy(image).orderBy(F.desc("confidence"), F.asc(order))
    return detections.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)


def best_detection(detections: DataFrame, image: str = "image_id", order: str = "ord") -> DataFrame:
    """One row per image: the most confident animal, or the most confident object without one."""
    priority = F.struct(is_animal(F.col("label")), F.col("confidence"), -F.col(order))
    return _best(detections, image, priority)


def largest_box(boxes: DataFrame, image: str = "image_id", order: str = "ord", box: str = "box") -> DataFrame:
    """One row per image: the box with the largest area, the first among equals."""
    return _best(boxes, image, F.struct(rect_area(F.col(box)), -F.col(order)))


def _best(rows: DataFrame, image: str, priority: Column) -> DataFrame:
    """Aggregates with a map-side step, so each task sends one row per image."""
    rest = [c for c in rows.columns if c != image]
    best = F.max_by(F.struct(*rest), priority).alias("_best")
    return rows.groupBy(image).agg(best).select(image, "_best.*")


def richest_pose(joints: DataFrame, image: str = "image_id", pose: str = "pose") -> DataFrame:
    """``(image_id, pose, joints)``: the pose with the most joints, the first among equals."""
    counted = joints.groupBy(image, pose).agg(F.count(F.lit(1)).alias("joints"))
    return _best(counted, image, F.struct(F.col("joints"), -F.col(pose)))


def top_label(labels: DataFrame, keys: Sequence[str] = ("image_id",), order: str = "ord") -> DataFrame:
    """``(keys.., label)``: the label with the highest confidence."""
    best = F.max_by("label", F.struct(F.col("confidence"), -F.col(order)))
    return labels.groupBy(*keys).agg(best.alias("label"))


def first_label(labels: Column) -> Column:
    """The detector lists its labels best first and takes the first one."""
    return F.get(labels, F.lit(0))


def class_argmax(scores: Column) -> Column:
    """``struct<class, score>``: first highest score above 0; class 0 with score 0 if there is none. NaN is no score."""
    top = F.array_max(F.filter(scores, lambda s: ~F.isnan(s)))
    none = F.coalesce(top <= 0, F.lit(True))
    return F.struct(
        F.when(none, 0).otherwise(F.array_position(scores, top).cast("int") - 1).alias("class"),
        F.when(none, F.lit(0).cast("float")).otherwise(top.cast("float")).alias("score"),
    )


def pose_decode(anchors: DataFrame, image: str = "image_id", gate: float = C.DETECTION_GATE) -> DataFrame:
    """Model output ``(image_id, anchor, features)`` to detections.

    A feature vector holds centre x, centre y, width, height, objectness, the class scores and 17
    keypoints of (x, y, visibility); vertical positions count from the bottom.
    """
    f = F.col("features")
    n_classes = F.greatest(F.lit(1), F.size(f) - (4 + 1 + 17 * 3))
    objectness = F.get(f, F.lit(4)).cast("float")
    gated = (
        anchors.select(image, F.col("anchor").alias("ord"), F.col("features").cast("array<float>").alias("features"))
        .filter(passes(objectness, gate))
        .withColumn("_n", n_classes)
        .withColumn("_best", class_argmax(F.slice(f, F.lit(6), F.col("_n"))))
        .withColumn("confidence", (F.col("_best.score") * objectness).cast("float"))
        .filter(passes(F.col("confidence"), gate))
    )
    cx, cy, w, h = [F.get(f, F.lit(i)).cast("double") for i in range(4)]
    box = rect(cx - w / 2, 1 - (cy + h / 2), w, h)

    def keypoint(k: int) -> Column:
        at = F.lit(5) + F.col("_n") + 3 * k
        x, y = F.get(f, at).cast("double"), 1 - F.get(f, at + 1).cast("double")
        visible = F.get(f, at + 2)
        seen = (visible > float_lit(C.KEYPOINT_GATE)) & ~F.isnan(visible)
        return F.when(seen, F.struct(x.alias("x"), y.alias("y")))

    return (
        gated.withColumn("_box", box)
        .select(
            image,
            "ord",
            class_label(F.col("_best.class")).alias("label"),
            "confidence",
            clamp_rect(F.col("_box")).alias("box"),
            F.filter(F.array(keypoint(1), keypoint(2)), lambda p: p.isNotNull()).alias("eye_kps"),
            keypoint(0).alias("nose"),
        )
    )


def classifier_boxes(
    classes: DataFrame, image: str = "image_id", gate: float = C.DETECTION_GATE, k: int = C.MAX_DETECTIONS
) -> DataFrame:
    """Output of a classification model: the whole image as box, no keypoints."""
    kept = top_detections(confidence_gate(classes, gate), k, image)
    return kept.select(
        image,
        "ord",
        "label",
        F.col("confidence").cast("float").alias("confidence"),
        unit_rect().alias("box"),
        F.array().cast(POINTS).alias("eye_kps"),
        F.lit(None).cast(POINT).alias("nose"),
    )
