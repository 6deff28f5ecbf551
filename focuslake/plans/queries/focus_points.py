"""Focus-point queries over payloads per order and points per line item."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions.files import af_tier as tier_column
from ...functions.geometry import rect
from ...operators import afpoints as A
from ..views import af_tags, view
from .registry import flat_sql, r6, rect_sql, register, tidy


def points(spark, folder) -> DataFrame:
    return view(spark, folder, "fx_rects").select(
        "image_id", "kind", "idx", rect("x", "y", "w", "h").alias("rect"), "in_focus", "selected", "precise")


# Layout of both payload kinds, then one row per declared point.
LAYOUT_SQL = """select image_id, tag, vals,
    case when vals[1] > 1000 and vals[3] > 0 and vals[3] < 1000 and vals[4] >= 0 and vals[4] <= vals[3] then 2 else 0 end as o
    from fx_tags"""
USABLE_SQL = """select image_id, tag, vals, o, vals[o + 1] as num, vals[o + 2] as valid, vals[o + 5] as w, vals[o + 6] as h
    from a where vals[o + 1] between 1 and 1024 and vals[o + 5] > 0 and vals[o + 6] > 0 and len(vals) >= 6"""
POINTS_SQL = f"""a as ({LAYOUT_SQL}), u as ({USABLE_SQL}),
    e as (select *, unnest(range(0, least(greatest(1, valid), num))) as i, o + 7 as b, o + 7 + num * 4 as f,
      (num + 15) // 16 as words from u),
    q as (select image_id, tag, i, w, h, coalesce(vals[b + i], 0) as pw, coalesce(vals[b + num + i], 0) as ph,
      coalesce(vals[b + 2 * num + i], 0) as px, coalesce(vals[b + 3 * num + i], 0) as py,
      (coalesce(vals[f + i // 16], 0) >> (i % 16)) & 1 = 1 as in_focus,
      (coalesce(vals[f + words + i // 16], 0) >> (i % 16)) & 1 = 1 as selected from e),
    n as (select *, 5e-1 + px / cast(w as double) as cx,
      case when tag = 16403 then 5e-1 + py / cast(h as double) else 5e-1 - py / cast(h as double) end as cy,
      pw / cast(w as double) as nw, ph / cast(h as double) as nh from q where pw > 0 and ph > 0),
    p as (select image_id, tag, cast(i as int) as idx, in_focus, selected, tag = 16403 as precise,
      {rect_sql('greatest(0e0, least(1e0, cx - nw / 2))', 'greatest(0e0, least(1e0, cy - nh / 2))', 'least(nw, 1e0)', 'least(nh, 1e0)')} as rect
      from n)"""


@register("af_layout", f"""with a as ({LAYOUT_SQL}), u as ({USABLE_SQL})
    select image_id, tag, o as layout_start, num as layout_num, valid as layout_valid, w as layout_w, h as layout_h from u""",
    "fx_tags")
def af_layout(spark, folder):
    read = af_tags(spark, folder).select("image_id", "tag", A.af_layout(F.col("vals")).alias("layout"))
    usable = read.filter(F.col("layout").isNotNull())
    return usable.select("image_id", "tag", *[F.col(f"layout.{k}").alias(f"layout_{k}") for k in ("start", "num", "valid", "w", "h")])


@register("af_decode", f"with {POINTS_SQL} select image_id, tag, idx, in_focus, selected, precise, {flat_sql('rect', 'rect')} from p",
          "fx_tags")
def af_decode(spark, folder):
    return tidy(A.af_decode(af_tags(spark, folder), "image_id"))


@register("bitmask_flags", f"""with a as ({LAYOUT_SQL}), u as ({USABLE_SQL}),
    e as (select *, unnest(range(0, num)) as i, o + 7 + num * 4 as f, (num + 15) // 16 as words from u)
    select image_id, tag, cast(i as int) as idx, (coalesce(vals[f + i // 16], 0) >> (i % 16)) & 1 = 1 as in_focus,
      (coalesce(vals[f + words + i // 16], 0) >> (i % 16)) & 1 = 1 as selected from e""", "fx_tags")
def bitmask_flags(spark, folder):
    read = af_tags(spark, folder).withColumn("layout", A.af_layout(F.col("vals"))).filter(F.col("layout").isNotNull())
    flags = read.select("image_id", "tag", F.posexplode(A.bitmask_flags(F.col("vals"), F.col("layout"))).alias("idx", "f"))
    return flags.select("image_id", "tag", "idx", "f.in_focus", "f.selected")


@register("tag_priority", f"""with {POINTS_SQL}, t as (select image_id, tag, count(*) as points from p group by image_id, tag),
    r as (select *, row_number() over (partition by image_id order by case tag when 16403 then 1 else 2 end) as r from t)
    select image_id, tag, points, tag = 16403 as precise from r where r = 1""", "fx_tags")
def tag_priority(spark, folder):
    chosen = A.tag_priority(af_tags(spark, folder), "image_id")
    return chosen.select("image_id", "tag", F.size("points").cast("bigint").alias("points"), "precise")


TIER = "case when in_focus then 0 when selected then 1 else 2 end"


AF_RECTS_SQL = f"""with {POINTS_SQL}, c as (select image_id, min(case tag when 16403 then 1 else 2 end) as k from p group by image_id),
    s as (select p.*, {TIER} as tier from p join c on p.image_id = c.image_id and case tag when 16403 then 1 else 2 end = k),
    b as (select image_id, min(tier) as best from s group by image_id),
    v as (select s.image_id, min(rect.x) as x0, min(rect.y) as y0, max(rect.x + rect.w) as x1, max(rect.y + rect.h) as y1
      from s join b on s.image_id = b.image_id and tier = best group by s.image_id)
    select image_id, {flat_sql(rect_sql('x0', 'y0', 'x1 - x0', 'y1 - y0'), 'af_rect')} from v"""


@register("af_rects", AF_RECTS_SQL, "fx_tags")
def af_rects(spark, folder):
    return tidy(A.af_rects(af_tags(spark, folder), "image_id"))


@register("af_tier", f"select image_id, idx, {TIER} as tier, count(*) as points from fx_rects group by all", "fx_rects")
def af_tier(spark, folder):
    tier = tier_column(F.col("in_focus"), F.col("selected")).alias("tier")
    return points(spark, folder).groupBy("image_id", "idx", tier).agg(F.count(F.lit(1)).alias("points"))


@register("prefer_tier", f"""with t as (select *, {TIER} as tier from fx_rects),
    b as (select image_id, min(tier) as best from t group by image_id)
    select t.image_id, idx, tier, {r6('x', 'x')}, {r6('y', 'y')} from t join b on t.image_id = b.image_id and tier = best""",
    "fx_rects")
def prefer_tier(spark, folder):
    return tidy(A.prefer_tier(view(spark, folder, "fx_rects").select("image_id", "idx", "in_focus", "selected", "x", "y"))
                .select("image_id", "idx", "tier", "x", "y"))


UNION_SQL = "select image_id, min(x) as x0, min(y) as y0, max(x + w) as x1, max(y + h) as y1 from {rows} group by image_id"
BOX = rect_sql("x0", "y0", "x1 - x0", "y1 - y0")


@register("rect_union", f"with u as ({UNION_SQL.format(rows='fx_rects')}) select image_id, {flat_sql(BOX, 'rect')} from u", "fx_rects")
def rect_union(spark, folder):
    return tidy(A.rect_union(points(spark, folder)))


PREFERRED_SQL = f"""t as (select *, {TIER} as tier from fx_rects),
    b as (select image_id as best_id, min(tier) as best from t group by image_id),
    s as (select t.* from t join b on image_id = best_id and tier = best), u as ({UNION_SQL.format(rows='s')})"""


@register("preferred_union", f"with {PREFERRED_SQL} select image_id, {flat_sql(BOX, 'af_rect')} from u", "fx_rects")
def preferred_union(spark, folder):
    return tidy(A.preferred_union(points(spark, folder)))


@register("af_counts", """select image_id, count(*) as points, count_if(in_focus) as in_focus, count_if(selected) as selected,
    arg_min(precise, idx) as precise from fx_rects group by image_id""", "fx_rects")
def af_counts(spark, folder):
    return A.af_counts(points(spark, folder))
