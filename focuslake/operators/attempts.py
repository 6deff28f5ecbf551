"""Decode cascades: the first attempt that worked wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import constants as C

# Stages of loading an image for display.
FULL_DECODE, LARGE_THUMBNAIL, SUB_IMAGES, EMBEDDED_JPEG = 1, 2, 3, 4

# Default size of a card thumbnail.
THUMBNAIL_SIDE = 400


def first_success(catalog: DataFrame, attempts: DataFrame, key: str = "path") -> DataFrame:
    """``(path, stage, used_fallback, error)`` for every file of the catalog.

    Files with an attempt but no success get the decoding message; files never attempted could not
    be opened.
    """
    tried = attempts.groupBy(key).agg(F.min(F.when(F.col("ok"), F.col("stage"))).alias("stage"), F.lit(True).alias("_open"))
    stage = F.col("stage")
    return catalog.select(key).join(tried, key, "left").select(
        key,
        "stage",
        F.coalesce(stage >= SUB_IMAGES, F.lit(False)).alias("used_fallback"),
        F.when(F.col("_open").isNull(), C.OPEN_ERROR).when(stage.isNull(), C.DECODE_ERROR).alias("error"),
    )


def thumbnail_plan(
    catalog: DataFrame, attempts: DataFrame, key: str = "path", max_side: int = THUMBNAIL_SIDE
) -> DataFrame:
    """``(path, source, sub, width, height)``: where each card thumbnail comes from.

    Attempts are ``(path, sub, kind, ok)`` with kind ``thumb``, ``full`` or ``jpeg``. Order: the
    thumbnail of the first image; for every further image its thumbnail, then the image; last the
    embedded JPEG, which alone is drawn to a fixed 4:3 size. Nothing that worked: all null.
    """
    sub, kind = F.col("sub").cast("int"), F.col("kind")
    usable = F.col("ok") & ((kind == "jpeg") | (kind == "thumb") | ((kind == "full") & (sub > 0)))
    # Embedded data comes after all sub-images, thumbnails before full images of the same one.
    order = F.struct(
        (kind == "jpeg").cast("int").alias("late"),
        F.when(kind == "jpeg", 0).otherwise(sub).alias("sub"),
        (kind == "full").cast("int").alias("full"),
    )
    first = attempts.filter(usable).groupBy(key).agg(F.min(order).alias("f"))
    source = (
        F.when(F.col("f.late") == 1, "jpeg").when(F.col("f.full") == 1, "full")
        .when(F.col("f").isNotNull(), "thumb")
    )
    fixed = F.col("f.late") == 1
    return catalog.select(key).join(first, key, "left").select(
        key,
        source.alias("source"),
        F.when(~fixed, F.col("f.sub")).alias("sub"),
        F.when(fixed, max_side).alias("width"),
        F.when(fixed, max_side * 3 // 4).alias("height"),
    )
