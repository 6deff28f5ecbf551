"""Pixel queries over 8x8 gray images."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions.geometry import crop_window, rect
from ...functions.scoring import subject_size_confidence
from ...operators import pixels as P
from ...operators.afpoints import rect_union
from ...operators.udf import full_window, grid_moments_udf
from ..focus import focus_from_grids
from ..views import grids, view
from .geometry import window_sql
from .registry import acceptable_sql, blur_sql, divisor_sql, r6, register, sharp_sql, size_conf_sql, status_sql, tidy

DIFF_SQL = """select vec_id, y, x,
    2*g - lag(g) over (partition by vec_id, y order by x) - lead(g) over (partition by vec_id, y order by x) as lh,
    2*g - lag(g) over (partition by vec_id, x order by y) - lead(g) over (partition by vec_id, x order by y) as lv
    from {pixels}"""
MOMENTS_SQL = """select vec_id, count(*) as n, cast(sum(lh) as bigint) as sum_h, cast(sum(lh * lh) as bigint) as ss_h,
    cast(sum(lv) as bigint) as sum_v, cast(sum(lv * lv) as bigint) as ss_v
    from d where lh is not null and lv is not null group by vec_id"""
VARIANCE_SQL = """select *, cast(ss_h as double) / n - (cast(sum_h as double) / n) * (cast(sum_h as double) / n) as var_h,
    cast(ss_v as double) / n - (cast(sum_v as double) / n) * (cast(sum_v as double) / n) as var_v from m"""
STATS = f"{r6('var_h', 'var_h')}, {r6('var_v', 'var_v')}, {r6('sqrt(greatest(var_h, 0e0) * greatest(var_v, 0e0))', 'combined')}"


def laplacian_sql(pixels: str) -> str:
    return f"""d as ({DIFF_SQL.format(pixels=pixels)}), m as ({MOMENTS_SQL}), v as ({VARIANCE_SQL})"""


def pixel_rows(spark, folder) -> DataFrame:
    return P.pixels_from_arrays(grids(spark, folder), "vec_id")


@register("second_difference", f"""with d as ({DIFF_SQL.format(pixels='fx_grid')})
    select vec_id, y, x, lh, lv from d where lh is not null and lv is not null""", "fx_grid")
def second_difference(spark, folder):
    return P.second_difference(pixel_rows(spark, folder), "vec_id")


LAPLACIAN_SQL = f"with {laplacian_sql('fx_grid')} select vec_id, n, sum_h, ss_h, sum_v, ss_v, {STATS} from v"


@register("directional_laplacian", LAPLACIAN_SQL, "fx_grid")
def directional_laplacian(spark, folder):
    return tidy(P.directional_laplacian(pixel_rows(spark, folder), "vec_id"))


@register("laplacian_udf", LAPLACIAN_SQL, "fx_grid")
def laplacian_udf(spark, folder):
    whole = full_window(F.lit(8), F.lit(8))
    m = grids(spark, folder).select("vec_id", grid_moments_udf("grid", "width", whole).alias("m")).select("vec_id", "m.*")
    return tidy(P.with_variances(m))


@register("laplacian_array", LAPLACIAN_SQL, "fx_grid")
def laplacian_array(spark, folder):
    whole = full_window(F.lit(8), F.lit(8))
    m = P.array_moments(F.col("grid"), F.col("width"), whole)
    return tidy(P.with_variances(grids(spark, folder).select("vec_id", m.alias("m")).select("vec_id", "m.*")))


@register("downscale", """select vec_id, y // 2 as y, x // 2 as x, cast(sum(g) // count(*) as int) as g from fx_grid
    group by vec_id, y // 2, x // 2""", "fx_grid")
def downscale(spark, folder):
    return P.downscale(pixel_rows(spark, folder), 2, "vec_id")


CROP_SQL = f"""with u as (select image_id, min(x) as x0, min(y) as y0, max(x + w) as x1, max(y + h) as y1 from fx_rects
      group by image_id),
    r as (select image_id, {{'x': x0, 'y': y0, 'w': x1 - x0, 'h': y1 - y0}} as r from u),
    c as (select image_id, {window_sql('r', '8', '8')} as c from r),
    p as (select vec_id, y, x, g from fx_grid join c on vec_id = image_id
      where x >= c.x0 and x < c.x1 and y >= c.y0 and y < c.y1)"""


def crop_windows(spark, folder) -> DataFrame:
    points = view(spark, folder, "fx_rects").select("image_id", rect("x", "y", "w", "h").alias("rect"))
    eight = F.lit(8)
    windows = rect_union(points).select(
        F.col("image_id").alias("vec_id"), crop_window(F.col("rect"), eight, eight).alias("c"))
    return windows.filter(F.col("c").isNotNull()).select("vec_id", "c.*")


@register("crop_pixels", CROP_SQL + " select vec_id, y, x, g from p", "fx_rects", "fx_grid")
def crop_pixels(spark, folder):
    return P.crop_pixels(pixel_rows(spark, folder), crop_windows(spark, folder), "vec_id").select("vec_id", "y", "x", "g")


@register("cropped_laplacian", f"{CROP_SQL}, {laplacian_sql('p')} select vec_id, n, sum_h, ss_h, sum_v, ss_v, {STATS} from v",
          "fx_rects", "fx_grid")
def cropped_laplacian(spark, folder):
    return tidy(P.directional_laplacian(pixel_rows(spark, folder), "vec_id", crop_windows(spark, folder)))


# Region by label, subject area by label: every status and blur type occurs.
GRID_REGIONS = ["Eyes (YOLO)", "Head (YOLO)", "Body (YOLO)", "Full Image"]
GRID_REGION_SQL = "case label % 4 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(GRID_REGIONS)) + " end"

FLAGSHIP_SQL = f"""with {laplacian_sql('fx_grid')},
    s as (select distinct vec_id, label, 1e-3 + label * 12e-4 as area, {GRID_REGION_SQL} as region from fx_grid),
    t as (select vec_id, var_h, var_v, {sharp_sql('region')} as sh, {acceptable_sql('region')} as ac,
      least(sqrt(greatest(var_h, 0e0) * greatest(var_v, 0e0)) / {divisor_sql('region')}, 1e0)
        * {size_conf_sql('area')} as sc from v join s using (vec_id))
    select vec_id, {r6('sc', 'score')}, {status_sql('sc', 'sh', 'ac')} as status,
      {blur_sql('sc', 'sh', 'ac', 'var_h', 'var_v')} as blur_type from t"""


def scored_grids(spark, folder) -> DataFrame:
    return with_grid_regions(grids(spark, folder))


def with_grid_regions(images: DataFrame) -> DataFrame:
    zero, area = F.lit(0.0), 0.001 + F.col("label") * 0.0012
    subject = rect(zero, zero, area, F.lit(1.0))
    return images.withColumn("region", F.expr(GRID_REGION_SQL)).withColumn(
        "size_conf", subject_size_confidence(subject))


@register("focus_from_grids", FLAGSHIP_SQL, "fx_grid")
def flagship(spark, folder):
    return tidy(focus_from_grids(scored_grids(spark, folder)))
