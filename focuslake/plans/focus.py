"""From images, detections, regions and focus points to focus results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions.files import file_name
from ..functions.geometry import RECT, crop_window
from ..functions.scoring import blur_type, focus_score, focus_status, region_thresholds, subject_size_confidence
from ..operators.detections import best_detection, confidence_gate, top_detections
from ..operators.pixels import directional_laplacian, downscale_factor, with_variances
from ..operators.regions import assemble_regions, crop_failure, pick_path
from ..operators.udf import full_window, grid_moments_udf, laplacian_udf, regions_udf, shrink_udf
from ..session import shared_folder
from ..sources.images import read_images
from ..sources.previews import place_digits

# Picks, of some hundred bytes each, that may be sent to all tasks at once.
SHARD_PICKS = 100_000


def plan_regions(
    images: DataFrame, detections: DataFrame, animal: DataFrame, human: DataFrame, af: DataFrame, image: str = "image_id",
    k: int | None = C.MAX_DETECTIONS,
) -> DataFrame:
    """Images with the region to score: ``rect, region, window, size_conf, label, det_conf``.

    ``images`` needs ``width`` and ``height`` in analysis pixels. Detections are gated, ranked and
    reduced to one row per image before they are joined; the other inputs have one row per image.
    Only the ``k`` most confident detections of an image can be chosen, all of them for None.
    """
    gated = confidence_gate(detections)
    best = best_detection(top_detections(gated, k, image) if k else gated, image)
    assembled = assemble_regions(images, animal, human, af, image)
    return crop_failure(pick_path(assembled, best, image))


def score_columns(stats: DataFrame) -> DataFrame:
    """Adds ``score, status, blur_type`` from ``region, size_conf, var_h, var_v, combined``."""
    bounded = stats.withColumn("_b", region_thresholds(F.col("region")))
    divisor, sharp, acceptable = [F.col(f"_b.{k}") for k in ("divisor", "sharp", "acceptable")]
    scored = bounded.withColumn("score", focus_score(F.col("combined"), divisor, F.col("size_conf")))
    score = F.col("score")
    return scored.withColumns({
        "status": focus_status(score, sharp, acceptable),
        "blur_type": blur_type(score, sharp, acceptable, F.col("var_h"), F.col("var_v")),
    }).drop("_b")


def focus_results(stats: DataFrame, image: str = "image_id") -> DataFrame:
    """The result table; an image that could not be scored gets the values of an unanalysed one."""
    scored = score_columns(stats)
    done = F.col("score").isNotNull()

    def value(name: str, otherwise=None, kind: str | None = None) -> Column:
        kept = F.when(done, F.col(name)).otherwise(F.lit(otherwise))
        return (kept.cast(kind) if kind else kept).alias(name)

    return scored.select(
        image, "status", value("score", 0.0), value("region", C.FULL_IMAGE), "blur_type",
        value("size_conf", 0.0), value("label"), value("rect", kind=RECT), value("det_conf", kind="float"),
    )


def analyze_focus(planned: DataFrame, pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """Scores planned images against a pixel table ``(image_id, y, x, g)``.

    ``planned`` is used twice, for the windows and for the result: store it first if it is costly.
    """
    windows = planned.select(image, "window.*")
    stats = directional_laplacian(pixels, image, windows)
    return focus_results(planned.join(stats, image, "left"), image)


def analyze_grids(planned: DataFrame, image: str = "image_id", grid: str = "grid") -> DataFrame:
    """Scores planned images that carry their gray values as an array: no shuffle for pixels."""
    m = grid_moments_udf(F.col(grid), F.col("width"), F.col("window"))
    stats = with_variances(planned.withColumn("_m", m).select("*", "_m.*"))
    return focus_results(stats, image)


def score_regions(
    images: DataFrame, candidates: DataFrame, image: str = "image_id", max_side: int = C.ANALYSIS_SIDE, buffer: str = "image"
) -> DataFrame:
    """``(image_id, region, rect, window, n, moments.., size_conf, score, status, blur_type)`` of every candidate region.

    ``candidates`` is ``(image_id, regions)`` with ``regions`` an array of ``struct<region, rect>``, all regions that may be
    chosen for an image. An image is made gray and small once, and its pixels are gone through once, however many
    regions it has. A rectangle that misses the image has the whole image for its window. Regions without inner pixels have no score.
    """
    w, h = F.col(f"{buffer}.width"), F.col(f"{buffer}.height")
    block = F.coalesce(downscale_factor(w, h, max_side), F.lit(1))
    small_w, small_h = F.ceil(w / block).cast("int"), F.ceil(h / block).cast("int")

    def placed(r: Column) -> Column:
        window = F.coalesce(crop_window(r["rect"], small_w, small_h), full_window(small_w, small_h))
        return F.struct(r["region"].alias("region"), r["rect"].alias("rect"), window.alias("window"))

    joined = images.join(candidates, image).withColumn("_regions", F.transform("regions", placed))
    m = regions_udf(F.col(buffer), block, F.col("_regions.window"))
    each = joined.select(image, F.inline(F.arrays_zip(F.col("_regions").alias("r"), m.alias("m"))))
    stats = with_variances(each.select(image, "r.*", "m.*"))
    return score_columns(stats.withColumn("size_conf", subject_size_confidence(F.col("rect"))))


def shrunk(images: DataFrame, max_side: int = C.ANALYSIS_SIDE, buffer: str = "image") -> DataFrame:
    """Replaces each image by its gray version with a longer side of at most ``max_side``."""
    image = F.col(buffer)
    block = downscale_factor(image["width"], image["height"], max_side)
    small = shrink_udf(image, F.coalesce(block, F.lit(1)))
    return images.withColumn(buffer, small)


def score_joined(joined: DataFrame, buffer: str, result: str) -> DataFrame:
    """Results of picks that stand beside their image, which is null where there is none."""
    w, h = F.col(f"{buffer}.width"), F.col(f"{buffer}.height")
    cut = crop_failure(joined.withColumn("width", w).withColumn("height", h))
    m = laplacian_udf(F.col(buffer), F.lit(1), F.col("window"))
    return focus_results(with_variances(cut.withColumn("_m", m).select("*", "_m.*")), result)


def analyze_images(
    images: DataFrame, picked: DataFrame, key: str = "path", max_side: int = C.ANALYSIS_SIDE, buffer: str = "image",
    result: str | None = None,
) -> DataFrame:
    """Scores decoded images against the region picked for each file.

    ``picked`` comes from ``pick_path`` over the listing and never sees a pixel. Images are made gray
    and small where they are read, so a join moves at most one byte per analysis pixel; where
    ``picked`` is small enough for Spark to broadcast it, nothing moves at all. There is one row for each
    row of ``picked``, named by its column ``result``, which is ``key`` by default. For cards of any size whose
    images are previews, ``analyze_card`` moves none.
    """
    joined = picked.join(shrunk(images, max_side, buffer).select(key, buffer), key, "left")
    return score_joined(joined, buffer, result or key)


def score_shard(picks: DataFrame, images: DataFrame, max_side: int = C.ANALYSIS_SIDE, path: str = "path") -> DataFrame:
    """Results of a bounded number of picks ``(path, _name, ..)``, where the images are read: no pixel moves."""
    small = shrunk(images, max_side).select(file_name(F.col("path")).alias("_name"), "image")
    return score_joined(small.join(F.broadcast(picks), "_name"), "image", path)


def folders(counts: dict[str, int], most: int, prefix: str = "") -> list[tuple[str, int]]:
    """Folders of previews and their picks: none with more than ``most`` but those at the bottom, the others not taken apart."""
    held = {k: n for k, n in counts.items() if k.startswith(prefix)}
    total = sum(held.values())
    if total <= most or prefix in held:
        return [(prefix, total)] if total else []
    return [f for d in sorted({k[len(prefix)] for k in held}) for f in folders(held, most, prefix + d)]


def shards(counts: dict[str, int], most: int) -> list[tuple[list[str], int, int]]:
    """(folders, part, parts): what is scored together, at most ``most`` picks. A single folder with more is scored in parts."""
    out, room = [], 0
    for folder, total in folders(counts, most):
        if total <= room:
            out[-1][0].append(folder)
            room -= total
        else:
            parts = -(-total // most)
            out += [([folder], i, parts) for i in range(parts)]
            room = most - total if parts == 1 else 0
    return out


def analyze_card(
    picked: DataFrame, previews: DataFrame, root: str, max_side: int = C.ANALYSIS_SIDE, path: str = "path", most: int = SHARD_PICKS,
    folder: str | None = None,
) -> DataFrame:
    """One result for each file of ``picked``, named by its path.

    ``previews`` is what ``write_previews`` gave for ``root``, ``(path, preview)``. The folders of previews are scored one after
    another, small ones together: their picks, at most ``most`` small rows, go to the tasks that read the images. A shuffle
    only ever sees picks and results. Files of one stem stay apart. A file without a preview, or whose preview cannot be found, gets the values of
    one that was never analysed. Results are stored in ``folder``.
    """
    spark = picked.sparkSession
    folder = folder or shared_folder(spark, "card")
    named = picked.join(previews.select(path, F.col("preview").alias("_preview")), path, "left")
    named = named.withColumns({"_name": file_name(F.col("_preview")), "_digits": place_digits(F.col("_preview"))})
    named.write.parquet(f"{folder}/picks")
    named = spark.read.schema(named.schema).parquet(f"{folder}/picks")
    counts = {r["_digits"]: r["count"] for r in named.where("_digits is not null").groupBy("_digits").count().collect()}
    done = []
    for n, (prefixes, part, parts) in enumerate(shards(counts, most)):
        below = reduce(lambda a, b: a | b, [F.col("_digits").startswith(p) for p in prefixes])
        mine = below & (F.pmod(F.xxhash64(path), F.lit(parts)) == part)
        images = read_images(spark, *["/".join([root.rstrip("/"), *p]) for p in prefixes])
        score_shard(named.where(mine), images, max_side, path).write.parquet(f"{folder}/results-{n}")
        done.append(f"{folder}/results-{n}")
    if not done:
        return never_scored(named, path)
    results = spark.read.parquet(*done)
    return results.unionByName(never_scored(named.join(results.select(path), path, "left_anti"), path))


def never_scored(named: DataFrame, path: str) -> DataFrame:
    """The results of picks without an image."""
    image = F.lit(None).cast("struct<width: int, height: int, channels: int, data: binary>")
    return score_joined(named.withColumn("image", image), "image", path)


def focus_from_grids(grids: DataFrame, image: str = "vec_id") -> DataFrame:
    """Scores whole arrays ``(image, grid, width, region, size_conf)`` without choosing a region."""
    height = F.floor(F.size("grid") / F.col("width"))
    m = grid_moments_udf(F.col("grid"), F.col("width"), full_window(F.col("width"), height))
    stats = with_variances(grids.withColumn("_m", m).select("*", "_m.*"))
    return score_columns(stats).select(image, "score", "status", "blur_type")
