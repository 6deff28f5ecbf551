"""Rectangle and score expressions over detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...functions import geometry as G, scoring as S
from ...functions.cascade import eye_usable, overlap_usable
from ...functions.constants import REGION_BOUNDS
from ..views import table, view
from .registry import (
    acceptable_sql, blur_sql, clamp_sql, divisor_sql, expand_sql, flat_sql, intersect_sql, padded_sql, r6,
    rect_sql, register, sharp_sql, size_conf_sql, status_sql, tidy,
)

REGIONS = list(REGION_BOUNDS)
REGION_SQL = "case ord % 12 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(REGIONS)) + " end"

# A second box per row, so that pairs of boxes can be disjoint, touching, nested or overlapping.
OTHER = {"x": "(ord % 30) / 60e0", "y": "(ord % 20) / 40e0", "w": "2e-1", "h": "15e-2"}
BOXES_SQL = f"""select image_id, ord, label, confidence, {rect_sql('x', 'y', 'w', 'h')} as box,
    {rect_sql(*OTHER.values())} as other, {REGION_SQL} as region from fx_detections"""


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    other = F.struct(*[F.expr(e).alias(k) for k, e in OTHER.items()])
    return view(spark, folder, "fx_detections").select(
        "image_id", "ord", "label", "confidence", G.rect("x", "y", "w", "h").alias("box"),
        other.alias("other"), F.expr(REGION_SQL).alias("region"),
    )


@register("flip_rect", f"""with b as ({BOXES_SQL})
    select ord, {flat_sql(rect_sql('box.x', '1e0 - (box.y + box.h)', 'box.w', 'box.h'), 'flipped')} from b""",
    "fx_detections")
def flip_rect(spark, folder):
    return tidy(boxes(spark, folder).select("ord", G.flip_rect(F.col("box")).alias("flipped")))


WIDE = {"x": "box.x * 3e0 - 4e-1", "y": "box.y * 4e0 - 5e-1", "w": "box.w * 2e0", "h": "box.h * 3e0"}


@register("clamp_rect", f"""with b as ({BOXES_SQL}), c as (select ord, {rect_sql(*WIDE.values())} as wide from b),
    d as (select ord, {clamp_sql('wide')} as r from c) select ord, {flat_sql('r', 'r')} from d""", "fx_detections")
def clamp_rect(spark, folder):
    wide = G.rect(*[F.expr(e) for e in WIDE.values()])
    return tidy(boxes(spark, folder).select("ord", wide.alias("wide")).select(
        "ord", G.clamp_rect(F.col("wide")).alias("r")))


@register("rect_area", f"with b as ({BOXES_SQL}) select ord, {r6('box.w * box.h', 'area')} from b", "fx_detections")
def rect_area(spark, folder):
    return tidy(boxes(spark, folder).select("ord", G.rect_area(F.col("box")).alias("area")))


@register("rect_intersect", f"""with b as ({BOXES_SQL}), i as (select ord, {intersect_sql('box', 'other')} as r from b)
    select ord, {flat_sql('r', 'r')}, coalesce(r.w * r.h > 1e-3, false) as usable from i""", "fx_detections")
def rect_intersect(spark, folder):
    shared = boxes(spark, folder).select("ord", G.rect_intersect(F.col("box"), F.col("other")).alias("r"))
    return tidy(shared.withColumn("usable", overlap_usable(F.col("r"))))


@register("expand_rect", f"""with a as (select image_id, idx, {rect_sql('x', 'y', 'w', 'h')} as r from fx_rects),
    b as (select image_id, idx, {expand_sql('r')} as r from a), c as (select image_id, idx, {clamp_sql('r')} as r from b)
    select image_id, idx, {flat_sql('r', 'r')} from c""", "fx_rects")
def expand_rect(spark, folder):
    points = view(spark, folder, "fx_rects").select("image_id", "idx", G.rect("x", "y", "w", "h").alias("r"))
    return tidy(points.withColumn("r", G.expand_rect(F.col("r"))))


# Three points per row: two eyes and a nose. Rows differ in how many of them exist.
EXTENT_SQL = """select ord, box, eyes, list_filter(list_concat(eyes, [nose]), lambda p: p is not null) as points from (
    select ord, {'x': x, 'y': y, 'w': w, 'h': h} as box,
    case ord % 3 when 0 then [{'x': x, 'y': y}, {'x': x + w, 'y': y + h / 2}] when 1 then [{'x': x, 'y': y}]
      else list_filter([{'x': x, 'y': y}], lambda p: false) end as eyes,
    case when ord % 2 = 0 then {'x': x + w / 2, 'y': y + h} end as nose from fx_detections)"""


def _xs(points: str, axis: str, agg: str) -> str:
    return f"list_{agg}(list_transform({points}, lambda p: p.{axis}))"


def _extent_sql(points: str) -> list[str]:
    return [_xs(points, a, m) for a in "xy" for m in ("min", "max")]


def _detector_sql(points: str, pad: str) -> str:
    x0, x1, y0, y1 = _extent_sql(points)

    def side(lo, hi):
        return f"least(1e0, ({hi} - {lo}) + {pad} * 2)"

    return rect_sql(f"greatest(0e0, {x0} - {pad})", f"greatest(0e0, {y0} - {pad})", side(x0, x1), side(y0, y1))


def keypoints(spark, folder):
    def point(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    x, y, w, h, order = [F.col(c) for c in ("x", "y", "w", "h", "ord")]
    first = point(x, y)
    eyes = (
        F.when(order % 3 == 0, F.array(first, point(x + w, y + h / 2))).when(order % 3 == 1, F.array(first))
        .otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    )
    nose = F.when(order % 2 == 0, point(x + w / 2, y + h))
    return view(spark, folder, "fx_detections").select(
        "ord", G.rect("x", "y", "w", "h").alias("box"), eyes.alias("eyes"), nose.alias("nose"))


@register("padded_bbox", f"""with k as ({EXTENT_SQL}), r as (select ord,
    case when len(points) > 0 then {padded_sql(*_extent_sql('points'), '6e-2')} end as padded,
    case when len(points) >= 2 then {_detector_sql('points', '4e-2')}
      else {rect_sql('box.x', 'box.y', 'box.w', 'box.h * 3e-1')} end as head,
    case when len(eyes) >= 2 then {_detector_sql('eyes', '5e-2')} end as eye from k)
    select ord, {flat_sql('padded', 'padded')}, {flat_sql('head', 'head')}, {flat_sql('eye', 'eye')} from r""",
    "fx_detections")
def padded_bbox(spark, folder):
    points = F.filter(F.concat("eyes", F.array("nose")), lambda p: p.isNotNull())
    return tidy(keypoints(spark, folder).withColumn("points", points).select(
        "ord",
        G.padded_bbox(F.col("points"), 0.06).alias("padded"),
        G.head_box(F.col("eyes"), F.col("nose"), F.col("box")).alias("head"),
        G.eye_box(F.col("eyes")).alias("eye"),
    ))


@register("head_from_body", f"""with b as ({BOXES_SQL}), h as (
    select ord, {rect_sql('box.x', 'box.y', 'box.w', 'box.h * 3e-1')} as r from b) select ord, {flat_sql('r', 'r')} from h""",
    "fx_detections")
def head_from_body(spark, folder):
    return tidy(boxes(spark, folder).select("ord", G.head_from_body(F.col("box")).alias("r")))


def window_sql(r: str, w: str, h: str) -> str:
    x0, y0 = f"greatest(floor({r}.x * {w}), 0)", f"greatest(floor({r}.y * {h}), 0)"
    x1 = f"least(ceil({r}.x * {w} + {r}.w * {w}), {w})"
    y1 = f"least(ceil({r}.y * {h} + {r}.h * {h}), {h})"
    parts = {"x0": x0, "y0": y0, "x1": x1, "y1": y1}
    struct = "{" + ", ".join(f"'{k}': cast({v} as int)" for k, v in parts.items()) + "}"
    return f"case when {r} is not null and {x1} > {x0} and {y1} > {y0} then {struct} end"


FAR = {"x": "box.x * 3e0 - 4e-1", "y": "box.y * 4e0 - 5e-1", "w": "box.w", "h": "box.h"}


@register("crop_window", f"""with b as ({BOXES_SQL}), f as (select ord, {rect_sql(*FAR.values())} as far from b),
    w as (select ord, {window_sql('far', '6960', '4640')} as c from f)
    select ord, c.x0 as x0, c.y0 as y0, c.x1 as x1, c.y1 as y1 from w""", "fx_detections")
def crop_window(spark, folder):
    far = G.rect(*[F.expr(e) for e in FAR.values()])
    return boxes(spark, folder).select("ord", far.alias("far")).select(
        "ord", G.crop_window(F.col("far"), F.lit(6960), F.lit(4640)).alias("c")).select("ord", "c.*")


@register("gray", """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
    cast((l_partkey % 256 * 299 + l_suppkey % 256 * 587 + l_orderkey % 256 * 114) // 1000 as int) as g from lineitem""")
def gray(spark, folder):
    red, green, blue = [F.col(c) % 256 for c in ("l_partkey", "l_suppkey", "l_orderkey")]
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.gray(red, green, blue).alias("g"))


@register("subject_size_confidence", f"""with b as (select image_id, idx, w * h * 5e-1 as area from fx_rects)
    select image_id, idx, {r6(size_conf_sql('area'), 'size_conf')} from b""", "fx_rects")
def subject_size_confidence(spark, folder):
    small = G.rect(F.col("x"), F.col("y"), F.col("w") * F.col("h"), F.lit(0.5))
    return tidy(view(spark, folder, "fx_rects").select(
        "image_id", "idx", S.subject_size_confidence(small).alias("size_conf")))


FIT_SQL = """select ord, frame, zoom, x, y, w, h,
    6960e0 / 4640e0 as aspect, case when frame = 0 then 1920e0 else 1080e0 end as fw,
    case when frame = 0 then 1080e0 else 1920e0 end as fh
    from fx_detections, (select unnest([0, 1]) as frame), (select unnest([1e0, 3e0]) as zoom)"""


@register("fit_rect", f"""with f as ({FIT_SQL}), s as (select *,
      case when aspect > fw / fh then fw else fh * aspect end as sw,
      case when aspect > fw / fh then fw / aspect else fh end as sh from f),
    p as (select ord, frame, zoom, sw * zoom as zw, sh * zoom as zh, x, y, w, h,
      (fw - sw) / 2e0 + sw / 2e0 as cx, (fh - sh) / 2e0 + sh / 2e0 as cy from s)
    select ord, frame, zoom, round(cx - zw / 2e0 + 12e0 + x * zw, 6) as r_x, round(cy - zh / 2e0 - 7e0 + y * zh, 6) as r_y,
      round(w * zw, 6) as r_w, round(h * zh, 6) as r_h from p""", "fx_detections")
def fit_rect(spark, folder):
    frames = view(spark, folder, "fx_detections").select(
        "ord", G.rect("x", "y", "w", "h").alias("box"), F.explode(F.array(F.lit(0), F.lit(1))).alias("frame")
    ).withColumn("zoom", F.explode(F.array(F.lit(1.0), F.lit(3.0))))
    flat = F.col("frame") == 0
    fw, fh = F.when(flat, 1920.0).otherwise(1080.0), F.when(flat, 1080.0).otherwise(1920.0)
    return tidy(frames.select(
        "ord", "frame", "zoom",
        G.fit_rect(F.col("box"), 6960, 4640, fw, fh, F.col("zoom"), 12.0, -7.0).alias("r")))


@register("region_gate", f"""with b as ({BOXES_SQL}), i as (
      select ord, {rect_sql('box.x', 'box.y', 'box.w * 4e-1', 'box.h * 2e-2')} as eye, {intersect_sql('box', 'other')} as r from b)
    select ord, coalesce(eye.w * eye.h > 4e-4, false) as eye_ok, coalesce(r.w * r.h > 1e-3, false) as overlap_ok from i""",
    "fx_detections")
def region_gate(spark, folder):
    box = F.col("box")
    eye = G.rect(box["x"], box["y"], box["w"] * 0.4, box["h"] * 0.02)
    return boxes(spark, folder).select(
        "ord", eye_usable(eye).alias("eye_ok"),
        overlap_usable(G.rect_intersect(box, F.col("other"))).alias("overlap_ok"))


@register("region_thresholds", f"""with b as ({BOXES_SQL}) select ord, region, {divisor_sql('region')} as b_divisor,
    {sharp_sql('region')} as b_sharp, {acceptable_sql('region')} as b_acceptable from b""", "fx_detections")
def region_thresholds(spark, folder):
    return tidy(boxes(spark, folder).select("ord", "region", S.region_thresholds(F.col("region")).alias("b")))


# Variances that reach every class: large and small, balanced and one-sided.
SCORED_SQL = f"""select ord, region, size_conf, vh, vv, sh, ac, least(sqrt(vh * vv) / dv, 1e0) * size_conf as sc from (
    select ord, region, {size_conf_sql('box.w * box.h * 1e-1')} as size_conf, {divisor_sql('region')} as dv,
    {sharp_sql('region')} as sh, {acceptable_sql('region')} as ac,
    cast(confidence as double) * 14e2 as vh, cast(confidence as double) * 14e2 * ((ord % 10) + 1) / 8e0 as vv
    from ({BOXES_SQL}))"""


def scored(spark, folder):
    box, level = F.col("box"), F.col("confidence").cast("double") * 1400.0
    base = boxes(spark, folder).select(
        "ord", "region",
        S.subject_size_confidence(G.rect(box["x"], box["y"], box["w"] * box["h"], F.lit(0.1))).alias("size_conf"),
        S.region_thresholds(F.col("region")).alias("b"),
        level.alias("vh"), (level * ((F.col("ord") % 10) + 1) / 8.0).alias("vv"),
    )
    combined = S.combined_variance(F.col("vh"), F.col("vv"))
    return base.withColumn("sc", S.focus_score(combined, F.col("b.divisor"), F.col("size_conf")))


@register("focus_score", f"with s as ({SCORED_SQL}) select ord, {r6('sc', 'score')} from s", "fx_detections")
def focus_score(spark, folder):
    return tidy(scored(spark, folder).select("ord", F.col("sc").alias("score")))


@register("focus_status", f"with s as ({SCORED_SQL}) select ord, {status_sql('sc', 'sh', 'ac')} as status from s",
          "fx_detections")
def focus_status(spark, folder):
    return scored(spark, folder).select(
        "ord", S.focus_status(F.col("sc"), F.col("b.sharp"), F.col("b.acceptable")).alias("status"))


@register("blur_type", f"""with s as ({SCORED_SQL}) select ord, {blur_sql('sc', 'sh', 'ac', 'vh', 'vv')} as blur_type
    from s""", "fx_detections")
def blur_type(spark, folder):
    return scored(spark, folder).select("ord", S.blur_type(
        F.col("sc"), F.col("b.sharp"), F.col("b.acceptable"), F.col("vh"), F.col("vv")).alias("blur_type"))
