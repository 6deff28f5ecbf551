"""Decoded images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Names of files that can be decoded, in any case.
DECODABLE = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}"


def read_images(spark: SparkSession, *roots: str) -> DataFrame:
    """``(path, image)`` for JPEG and PNG files; ``image`` is null where decoding failed.

    Other files, raw files above all, are left out by name and never read.
    Pixel data is row-major with the channels in the order blue, green, red (and alpha).
    """
    reader = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", DECODABLE)
    loaded = reader.load(list(roots))
    return loaded.select(F.col("image.origin").alias("path"), decoded(F.col("image")).alias("image"))


def decoded(image: Column) -> Column:
    fields = F.struct(
        image["width"].alias("width"), image["height"].alias("height"),
        image["nChannels"].alias("channels"), image["data"].alias("data"),
    )
    return F.when(image["height"] > 0, fields)
