"""Pixel operators in three forms with identical integer results.

* relational: one row per pixel, ``(image_id, y, x, g)``;
* array: one row per image with a row-major ``array<int>``, no shuffle at all;
* buffer (``udf.py``): one row per image with the encoded pixel bytes, numpy inside Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.binding import bind
from ..functions.scoring import combined_variance, population_variance

TILE = 64
MOMENTS = ("n", "sum_h", "ss_h", "sum_v", "ss_v")


def pixels_from_arrays(images: DataFrame, image: str = "image_id", grid: str = "grid", width: str = "width") -> DataFrame:
    """Row-major arrays to one row per pixel."""
    spread = images.select(image, F.col(width).alias("_w"), F.posexplode_outer(grid).alias("_i", "g"))
    return spread.filter(F.col("_i").isNotNull()).select(
        image,
        F.floor(F.col("_i") / F.col("_w")).cast("int").alias("y"),
        (F.col("_i") % F.col("_w")).cast("int").alias("x"),
        "g",
    )


def with_tiles(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Adds ``ty, tx, own``: each pixel once in its own tile, and again in neighbouring tiles if it
    lies on their border. Tiles have a bounded size however large the image is, so neither a huge
    image nor a hot image key lands in one task.
    """

    def reach(c: str) -> Column:
        v = F.col(c)
        home = F.floor(v / tile)
        return F.array_distinct(F.array(F.floor((v - 1) / tile), home, F.floor((v + 1) / tile)))

    home = (F.col("ty") == F.floor(F.col("y") / tile)) & (F.col("tx") == F.floor(F.col("x") / tile))
    # Diagonal copies are not needed: the stencil only looks along rows and columns.
    straight = (F.col("ty") == F.floor(F.col("y") / tile)) | (F.col("tx") == F.floor(F.col("x") / tile))
    return (
        pixels.withColumn("ty", F.explode(reach("y")))
        .withColumn("tx", F.explode(reach("x")))
        .filter(straight & (F.col("ty") >= 0) & (F.col("tx") >= 0))
        .withColumn("own", home)
    )


def crop_pixels(pixels: DataFrame, windows: DataFrame, image: str = "image_id", tile: int = TILE) -> DataFrame:
    """Pixels inside their image's window ``(image_id, x0, y0, x1, y1)``, in image coordinates.

    The windows are spread over the tiles they touch, so the join is on (image, tile): the pixels of
    one large image go to many tasks.
    """
    tiled = pixels.withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))
    return _inside(tiled, windows, image, tile).drop("ty", "tx", "x0", "y0", "x1", "y1")


def _inside(tiled: DataFrame, windows: DataFrame, image: str, tile: int, halo: int = 0) -> DataFrame:
    """``halo`` = 1 also reaches the tiles that hold the window's pixels only as border copies."""

    def spread(lo: str, hi: str) -> Column:
        first = F.floor((F.col(lo) - halo) / tile)
        return F.explode(F.sequence(first, F.floor((F.col(hi) - 1 + halo) / tile)))

    spots = (
        windows.select(image, "x0", "y0", "x1", "y1")
        .withColumn("ty", spread("y0", "y1"))
        .withColumn("tx", spread("x0", "x1"))
    )
    x, y = F.col("x"), F.col("y")
    hit = (x >= F.col("x0")) & (x < F.col("x1")) & (y >= F.col("y0")) & (y < F.col("y1"))
    return tiled.join(spots, [image, "ty", "tx"]).filter(hit)


def second_difference(
    pixels: DataFrame, image: str = "image_id", windows: DataFrame | None = None, tile: int = TILE
) -> DataFrame:
    """``(image_id, y, x, lh, lv)`` for every pixel with all four neighbours.

    ``lh`` is twice the pixel less its left and right neighbours, ``lv`` the same along the column.
    With ``windows`` only the pixels inside the image's crop window count. One shuffle on
    (image, tile) serves the optional join and both windows.
    """
    tiled = with_tiles(pixels, tile)
    if windows is not None:
        tiled = _inside(tiled, windows, image, tile, halo=1)
    place = [image, "ty", "tx"]
    # Naming the place up front lets both windows share one exchange.
    placed = tiled.select(*place, "own", "y", "x", "g").repartition(*place)
    row = Window.partitionBy(*place, "y").orderBy("x")
    column = Window.partitionBy(*place, "x").orderBy("y")

    def along(axis: Window, pos: str) -> Column:
        g = F.col("g")
        beside = (F.lag(pos).over(axis) == F.col(pos) - 1) & (F.lead(pos).over(axis) == F.col(pos) + 1)
        return F.when(beside, 2 * g - F.lag(g).over(axis) - F.lead(g).over(axis))

    return (
        placed.withColumn("lh", along(row, "x"))
        .withColumn("lv", along(column, "y"))
        .filter(F.col("own") & F.col("lh").isNotNull() & F.col("lv").isNotNull())
        .select(image, "y", "x", "lh", "lv")
    )


def laplacian_moments(diffs: DataFrame, image: str = "image_id") -> DataFrame:
    """Integer moments per image, summed on the map side first."""
    lh, lv = F.col("lh").cast("bigint"), F.col("lv").cast("bigint")
    return diffs.groupBy(image).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(lh).alias("sum_h"),
        F.sum(lh * lh).alias("ss_h"),
        F.sum(lv).alias("sum_v"),
        F.sum(lv * lv).alias("ss_v"),
    )


def with_variances(moments: DataFrame) -> DataFrame:
    """Adds ``var_h, var_v, combined``; all null where there is no interior pixel."""
    n = F.col("n")
    n = F.when(n > 0, n)
    return moments.withColumns({
        "var_h": population_variance(n, F.col("sum_h"), F.col("ss_h")),
        "var_v": population_variance(n, F.col("sum_v"), F.col("ss_v")),
    }).withColumn("combined", combined_variance(F.col("var_h"), F.col("var_v")))


def directional_laplacian(
    pixels: DataFrame, image: str = "image_id", windows: DataFrame | None = None, tile: int = TILE
) -> DataFrame:
    """``(image_id, n, moments.., var_h, var_v, combined)``; images without interior pixels are absent."""
    return with_variances(laplacian_moments(second_difference(pixels, image, windows, tile), image))


def array_moments(grid: Column, width: Column, window: Column) -> Column:
    """Moments of a row-major array inside a window, as ``struct<n, sum_h, ss_h, sum_v, ss_v>``.

    Runs inside the row, so there is nothing to shuffle; meant for thumbnails and small crops.
    """
    inner_w, inner_h = window["x1"] - window["x0"] - 2, window["y1"] - window["y0"] - 2
    rows = F.sequence(window["y0"] + 1, window["y1"] - 2)

    def run(y: Column, down: int, right: int) -> Column:
        """The inner pixels of a row, or their neighbours on one side."""
        return F.slice(grid, (y + down) * width + window["x0"] + 2 + right, inner_w)

    def differences(before: tuple[int, int], after: tuple[int, int]) -> Column:
        def of_row(y: Column) -> Column:
            beside = F.zip_with(run(y, *before), run(y, *after), lambda a, b: a + b)
            return F.zip_with(run(y, 0, 0), beside, lambda c, s: (2 * c - s).cast("bigint"))

        return F.flatten(F.transform(rows, of_row))

    def sums(d: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        total = F.aggregate(d, zero, lambda acc, v: acc + v)
        return F.struct(total.alias("sum"), F.aggregate(d, zero, lambda acc, v: acc + v * v).alias("ss"))

    def both(s: Column) -> Column:
        parts = {"n": (inner_w * inner_h).cast("bigint"), "sum_h": s["h"]["sum"], "ss_h": s["h"]["ss"],
                 "sum_v": s["v"]["sum"], "ss_v": s["v"]["ss"]}
        return F.struct(*[parts[k].alias(k) for k in MOMENTS])

    along, across = bind(differences((0, -1), (0, 1)), sums), bind(differences((-1, 0), (1, 0)), sums)
    moments = bind(F.struct(along.alias("h"), across.alias("v")), both)
    return F.when(grid.isNotNull() & (inner_w > 0) & (inner_h > 0), moments)


def downscale_factor(width: Column, height: Column, max_side: int) -> Column:
    """Whole block size that brings the longer side to at most ``max_side``."""
    return F.greatest(F.ceil(F.greatest(width, height) / max_side), F.lit(1)).cast("int")


def downscale(pixels: DataFrame, block: Column | int, image: str = "image_id") -> DataFrame:
    """Area mean over blocks of ``block`` x ``block`` pixels, truncated to an integer.

    Grouped by (image, block), so a hot image is spread, and summed on the map side first.
    """
    k = F.lit(block) if isinstance(block, int) else block
    mean = F.floor(F.sum(F.col("g").cast("bigint")) / F.count("g")).cast("int")
    return pixels.groupBy(
        image, F.floor(F.col("y") / k).cast("int").alias("y"), F.floor(F.col("x") / k).cast("int").alias("x")
    ).agg(mean.alias("g"))
