"""Choosing the region of an image that is scored.

Every rectangle may be missing (null). A choice is ``struct<rect, region>``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as C
from .geometry import expand_rect, null_rect, rect_area, rect_intersect


def eye_usable(r: Column) -> Column:
    return F.coalesce(rect_area(r) > C.MIN_EYE_AREA, F.lit(False))


def overlap_usable(r: Column) -> Column:
    return F.coalesce(rect_area(r) > C.MIN_OVERLAP_AREA, F.lit(False))


def choice(r: Column, region: str) -> Column:
    return F.struct(r.alias("rect"), F.lit(region).alias("region"))


def detector_region(eye: Column, head: Column, af: Column) -> Column:
    """Detector path: eyes, else the part of the head the camera focused on, else the head."""
    shared = rect_intersect(head, af)
    return (
        F.when(eye_usable(eye), choice(eye, C.DETECTOR_EYES))
        .when(overlap_usable(shared), choice(shared, C.AF_AND_SUBJECT))
        .otherwise(choice(head, C.DETECTOR_HEAD))
    )


def fallback_region(
    animal_eye: Column, animal_head: Column, animal_body: Column, human_eye: Column, human_face: Column, af: Column
) -> Column:
    """Fallback path, most telling region first; a null rectangle stands for the full image."""
    head_af, body_af = rect_intersect(animal_head, af), rect_intersect(af, animal_body)
    return (
        F.when(eye_usable(animal_eye), choice(animal_eye, C.ANIMAL_EYES))
        .when(overlap_usable(head_af), choice(head_af, C.AF_AND_SUBJECT))
        .when(animal_head.isNotNull(), choice(animal_head, C.ANIMAL_HEAD))
        .when(eye_usable(human_eye), choice(human_eye, C.HUMAN_EYES))
        .when(human_face.isNotNull(), choice(human_face, C.HUMAN_FACE))
        .when(overlap_usable(body_af), choice(body_af, C.AF_AND_SUBJECT))
        .when(af.isNotNull(), choice(expand_rect(af), C.AF_POINT))
        .when(animal_body.isNotNull(), choice(animal_body, C.ANIMAL_BODY))
        .otherwise(choice(null_rect(), C.FULL_IMAGE))
    )
