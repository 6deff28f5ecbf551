"""Subject regions from poses and faces, and the choice of the region to score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions.cascade import detector_region, fallback_region
from ..functions.geometry import RECT, crop_window, eye_box, flip_rect, head_box, head_from_body, padded_extent, rect_intersect
from ..functions.labels import normalise_label
from ..functions.scoring import subject_size_confidence
from .detections import largest_box


def _padded(wanted: Column, x: Column, y: Column, pad: float) -> Column:
    """Aggregate: padded bounding box of the wanted points of a group."""
    px, py = F.when(wanted, x), F.when(wanted, y)
    return padded_extent(F.min(px), F.max(px), F.min(py), F.max(py), pad)


def pose_regions(joints: DataFrame, *keys: str, gate: float = C.JOINT_GATE) -> DataFrame:
    """``(keys.., joints, eye, head, body)`` from joints ``(keys.., joint, x, y, confidence)``.

    Positions count from the bottom. All joints are counted, only confident ones span regions. One
    aggregation with a map-side step, whatever the number of joints per pose.
    """
    keys = keys or ("image_id",)
    name = F.lower(F.col("joint"))
    sure = (F.col("confidence") > gate) & ~F.isnan("confidence")
    eye = sure & name.contains("eye")
    head = eye | (sure & (name.contains("ear") | name.contains("nose") | name.contains("head")))
    x, y = F.col("x"), 1.0 - F.col("y")
    return joints.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("joints"),
        _padded(eye, x, y, 0.06).alias("eye"),
        _padded(head, x, y, 0.04).alias("head"),
        _padded(sure, x, y, 0.02).alias("body"),
    )


def animal_regions(joints: DataFrame, image: str = "image_id", pose: str = "pose", wanted: DataFrame | None = None) -> DataFrame:
    """Regions of the pose with the most joints of each image; extents first, so no join back."""
    per_pose = of_images(pose_regions(joints, image, pose), wanted, image)
    priority = F.struct(F.col("joints"), -F.col(pose))
    best = F.max_by(F.struct("eye", "head", "body"), priority).alias("_best")
    return per_pose.groupBy(image).agg(best).select(image, "_best.*")


def face_eye_box(faces: DataFrame, landmarks: DataFrame, image: str = "image_id") -> DataFrame:
    """``(image_id, eye)`` from one face box per image (bottom-left origin) and its eye landmarks.

    Landmark positions are relative to the face. Within one image the mapping is increasing in x and
    decreasing in y, so the extents of the landmarks are reduced first and only one row per image
    meets the face.
    """
    extent = landmarks.groupBy(image).agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1")
    )
    box = F.col("box")

    def at_x(c: str) -> Column:
        return box["x"] + F.col(c) * box["w"]

    def at_y(c: str) -> Column:
        return 1.0 - (box["y"] + F.col(c) * box["h"])

    eye = padded_extent(at_x("_x0"), at_x("_x1"), at_y("_y1"), at_y("_y0"), 0.04)
    return faces.join(extent, image).select(image, eye.alias("eye"))


def of_images(rows: DataFrame, wanted: DataFrame | None, image: str = "image_id") -> DataFrame:
    """Rows of wanted images, all for None.

    Taken after a grouping by image: Spark moves the join before the grouping, and the shuffle, where ``wanted`` is
    small enough for a broadcast, and leaves it behind otherwise.
    """
    return rows if wanted is None else rows.join(wanted.select(image), image, "left_semi")


def animal_result(
    joints: DataFrame, boxes: DataFrame, labels: DataFrame, image: str = "image_id", pose: str = "pose", wanted: DataFrame | None = None
) -> DataFrame:
    """``(image_id, eye, head, body, label)`` for ``assemble_regions``: the pose if it has a body, else the largest box.

    ``boxes`` are animals ``(image_id, ord, box)`` counted from the bottom, the head is the top of the box;
    ``labels`` are ``(image_id, ord, label, confidence)`` of those boxes. A pose takes the best label of the
    image, a box its own. ``wanted`` names the images that are needed, if not all.
    """
    poses = animal_regions(joints, image, pose, wanted).filter(F.col("body").isNotNull())
    # The best label of an image is the best of those of its boxes, so labels are gone through once.
    surest = F.struct("confidence", -F.col("ord"), "label")
    per_box = of_images(labels.groupBy(image, "ord").agg(F.max(surest).alias("_label")), wanted, image)
    best = per_box.groupBy(image).agg(F.max("_label")["label"].alias("_any"))
    own = per_box.select(image, "ord", F.col("_label.label").alias("_own"))
    largest = of_images(largest_box(boxes.select(image, "ord", flip_rect(F.col("box")).alias("_box")), image, box="_box"), wanted, image)
    named = largest.join(own, [image, "ord"], "left").drop("ord")
    joined = poses.join(named, image, "full").join(best, image, "left")
    posed = F.col("body").isNotNull()
    return joined.select(
        image, "eye", F.when(posed, F.col("head")).otherwise(head_from_body(F.col("_box"))).alias("head"),
        F.coalesce("body", "_box").alias("body"), F.when(posed, F.col("_any")).otherwise(F.col("_own")).alias("label"))


def human_result(faces: DataFrame, landmarks: DataFrame, image: str = "image_id", wanted: DataFrame | None = None) -> DataFrame:
    """``(image_id, eye, face)`` for ``assemble_regions``: the largest face, with an eye box if it has landmarks.

    ``faces`` is ``(image_id, ord, box)`` and ``landmarks`` ``(image_id, ord, x, y)``, both from the bottom.
    ``wanted`` names the images that are needed, if not all.
    """
    largest = of_images(largest_box(faces.select(image, "ord", "box"), image), wanted, image)
    here = landmarks.join(largest.select(image, "ord"), [image, "ord"], "left_semi")
    eyes = face_eye_box(largest, here, image)
    return largest.join(eyes, image, "left").select(image, "eye", flip_rect(F.col("box")).alias("face"))


def af_subject_overlap(subjects: DataFrame, af: DataFrame, image: str = "image_id", box: str = "box") -> DataFrame:
    """Adds ``af_rect`` and its intersection ``overlap`` with the subject's box; one row per image on both sides."""
    return subjects.join(af.select(image, "af_rect"), image, "left").withColumn(
        "overlap", rect_intersect(F.col(box), F.col("af_rect"))
    )


def assemble_regions(images: DataFrame, animal: DataFrame, human: DataFrame, af: DataFrame, image: str = "image_id") -> DataFrame:
    """Brings ``animal`` (eye, head, body, label), ``human`` (eye, face) and ``af`` (af_rect) together.

    Each part has at most one row per image and may be missing.
    """
    animals = animal.select(
        image, F.col("eye").alias("animal_eye"), F.col("head").alias("animal_head"),
        F.col("body").alias("animal_body"), F.col("label").alias("animal_label"),
    )
    humans = human.select(image, F.col("eye").alias("human_eye"), F.col("face").alias("human_face"))
    return (
        images.join(animals, image, "left").join(humans, image, "left")
        .join(af.select(image, "af_rect"), image, "left")
    )


def pick_path(assembled: DataFrame, best: DataFrame, image: str = "image_id") -> DataFrame:
    """Chooses rectangle and region: the detector path where a detection exists, else the fallback.

    ``best`` holds one detection per image: ``(image_id, label, confidence, box, eye_kps, nose)``.
    Adds ``path_taken, rect, region, label, det_conf, box``.
    """
    picked = best.select(
        image, "label", F.col("confidence").alias("det_conf"), "box",
        eye_box(F.col("eye_kps")).alias("_eye"),
        head_box(F.col("eye_kps"), F.col("nose"), F.col("box")).alias("_head"),
    )
    joined = assembled.join(picked, image, "left")
    found = F.col("box").isNotNull()
    af = F.col("af_rect")
    chosen = F.when(found, detector_region(F.col("_eye"), F.col("_head"), af)).otherwise(
        fallback_region(
            F.col("animal_eye"), F.col("animal_head"), F.col("animal_body"),
            F.col("human_eye"), F.col("human_face"), af,
        )
    )
    label = F.when(found, normalise_label(F.col("label"))).otherwise(F.col("animal_label"))
    path_taken = F.when(found, "detector").otherwise("fallback")
    picked_rows = joined.withColumns({"_chosen": chosen, "path_taken": path_taken, "label": label})
    return picked_rows.withColumns({"rect": F.col("_chosen.rect"), "region": F.col("_chosen.region")}).drop(
        "_chosen", "_eye", "_head")


def crop_failure(picked: DataFrame) -> DataFrame:
    """Adds ``window`` and ``size_conf``, and falls back where the rectangle misses the image.

    Needs ``width`` and ``height``. A failed detector crop becomes the whole image scored as body
    with a fixed size confidence and the detection's box; a failed fallback crop keeps its values.
    ``window`` is the whole image in both cases.
    """
    window = crop_window(F.col("rect"), F.col("width"), F.col("height"))
    whole = F.struct(
        F.lit(0).alias("x0"), F.lit(0).alias("y0"),
        F.col("width").cast("int").alias("x1"), F.col("height").cast("int").alias("y1"),
    )
    missed = F.col("_window").isNull() & (F.col("path_taken") == "detector")
    size_conf = F.when(missed, C.NO_RECT_CONFIDENCE).otherwise(subject_size_confidence(F.col("rect")))
    return picked.withColumn("_window", window).withColumns({
        "size_conf": size_conf,
        "region": F.when(missed, C.DETECTOR_BODY).otherwise(F.col("region")),
        "rect": F.when(missed, F.col("box")).otherwise(F.col("rect")).cast(RECT),
        "window": F.coalesce(F.col("_window"), whole),
    }).drop("_window")
