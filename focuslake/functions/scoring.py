"""Sharpness score and classification on Columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from . import constants as C
from .geometry import rect_area


def gray(r: Column, g: Column, b: Column) -> Column:
    """Integer luma, truncated."""
    return F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def subject_size_confidence(r: Column) -> Column:
    """How far a subject of this size can be trusted: 0.3 when tiny, 1 when large, 0.7 if unknown."""
    area = rect_area(r)
    ramp = 0.3 + 0.7 * (area - C.MIN_SUBJECT_AREA) / (C.MIN_SUBJECT_AREA * 4)
    return (
        F.when(area.isNull(), C.NO_RECT_CONFIDENCE)
        .when(area >= C.FULL_SUBJECT_AREA, 1.0)
        .when(area < C.MIN_SUBJECT_AREA, 0.3)
        .otherwise(ramp)
    )


def region_thresholds(region: Column) -> Column:
    """``struct<divisor, sharp, acceptable>`` for an analysis region."""
    full = _bounds(C.FULL_BOUNDS)
    table = F.create_map(*chain.from_iterable((F.lit(k), _bounds(v)) for k, v in C.REGION_BOUNDS.items()))
    return F.coalesce(table[region], full)


def _bounds(values: tuple[float, float, float]) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in zip(("divisor", "sharp", "acceptable"), values)])


def population_variance(n: Column, total: Column, squares: Column) -> Column:
    """Variance from integer moments, so the result does not depend on row or partition order."""
    mean = total.cast("double") / n
    return squares.cast("double") / n - mean * mean


def combined_variance(var_h: Column, var_v: Column) -> Column:
    zero = F.lit(0.0)
    both = var_h.isNotNull() & var_v.isNotNull()
    return F.when(both, F.sqrt(F.greatest(var_h, zero) * F.greatest(var_v, zero)))


def focus_score(combined: Column, divisor: Column, size_conf: Column) -> Column:
    """Capped at 1 first, scaled by the size confidence after that; null without a variance."""
    # least() skips nulls and would turn a missing variance into a full score.
    return F.when(combined.isNotNull(), F.least(combined / divisor, F.lit(1.0)) * size_conf)


def focus_status(score: Column, sharp: Column, acceptable: Column) -> Column:
    return (
        F.when(score.isNull(), C.NOT_ANALYZED)
        .when(score >= sharp, C.SHARP)
        .when(score >= acceptable, C.SLIGHTLY_BLURRY)
        .otherwise(C.BLURRY)
    )


def blur_type(score: Column, sharp: Column, acceptable: Column, var_h: Column, var_v: Column) -> Column:
    """One direction much weaker than the other means motion; both weak means defocus."""
    high, low = F.greatest(var_h, var_v), F.least(var_h, var_v)
    return (
        F.when(score.isNull(), C.UNKNOWN_BLUR)
        .when(score >= sharp, C.BLUR_NONE)
        .when((high > 1.0) & (low / high < C.MOTION_RATIO), C.MOTION_BLUR)
        .when(score < acceptable, C.OUT_OF_FOCUS)
        .otherwise(C.MIXED)
    )


def is_rejected(status: Column) -> Column:
    return status.isin(C.BLURRY, C.SLIGHTLY_BLURRY)
