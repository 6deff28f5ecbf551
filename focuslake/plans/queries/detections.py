"""Detection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions import labels as L
from ...functions.constants import ANIMALS, BIRDS, CLASS_LABELS
from ...functions.geometry import rect
from ...operators import detections as D
from ..views import anchors, table, view
from .registry import clamp_sql, flat_sql, r6, rect_sql, register, tidy

GATE = "cast(35e-2 as float)"
KNOWN_ANIMALS = ", ".join(f"'{a}'" for a in ANIMALS)
KNOWN_BIRDS = ", ".join(f"'{b}'" for b in BIRDS)


def detections(spark, folder) -> DataFrame:
    """``fx_detections`` with its box as a rectangle."""
    return view(spark, folder, "fx_detections").select(
        "image_id", "ord", "label", "confidence", rect("x", "y", "w", "h").alias("box"))


@register("confidence_gate", f"select image_id, ord, label, {r6('confidence', 'confidence')} from fx_detections where confidence >= {GATE}",
          "fx_detections")
def confidence_gate(spark, folder):
    return tidy(D.confidence_gate(detections(spark, folder)).select("image_id", "ord", "label", "confidence"))


TOP_SQL = """select image_id, ord, label, confidence, cast(row_number() over (partition by image_id
    order by confidence desc, ord) as int) as rank from {rows}"""


@register("top_detections", f"""with r as ({TOP_SQL.format(rows='fx_detections')})
    select image_id, ord, label, {r6('confidence', 'confidence')}, rank from r where rank <= 10""", "fx_detections")
def top_detections(spark, folder):
    return tidy(D.top_detections(detections(spark, folder).select("image_id", "ord", "label", "confidence")))


BEST_SQL = f"""select image_id, ord, label, confidence, x, y, w, h from (select *, row_number() over (
    partition by image_id order by label in ({KNOWN_ANIMALS}) desc, confidence desc, ord) as r
    from fx_detections where confidence >= {GATE}) where r = 1"""


@register("best_detection", f"""with b as ({BEST_SQL}) select image_id, ord, label, {r6('confidence', 'confidence')},
    {flat_sql(rect_sql('x', 'y', 'w', 'h'), 'box')} from b""", "fx_detections")
def best_detection(spark, folder):
    return tidy(D.best_detection(D.confidence_gate(detections(spark, folder))))


@register("largest_box", f"""with b as (select *, row_number() over (partition by image_id order by w * h desc, ord) as r
    from fx_detections where label = 'person')
    select image_id, ord, {flat_sql(rect_sql('x', 'y', 'w', 'h'), 'box')} from b where r = 1""", "fx_detections")
def largest_box(spark, folder):
    faces = detections(spark, folder).filter(F.col("label") == "person")
    return tidy(D.largest_box(faces.select("image_id", "ord", "box")))


@register("richest_pose", """with c as (select image_id, cast(in_focus as int) as pose, count(*) as joints from fx_rects
      group by image_id, in_focus),
    r as (select *, row_number() over (partition by image_id order by joints desc, pose) as r from c)
    select image_id, pose, joints from r where r = 1""", "fx_rects")
def richest_pose(spark, folder):
    joints = view(spark, folder, "fx_rects").select("image_id", F.col("in_focus").cast("int").alias("pose"))
    return D.richest_pose(joints)


@register("top_label", """with r as (select *, row_number() over (partition by image_id order by confidence desc, ord) as r
    from fx_detections) select image_id, label from r where r = 1""", "fx_detections")
def top_label(spark, folder):
    return D.top_label(detections(spark, folder))


@register("first_label", "select event_id, event_type as label from events")
def first_label(spark, folder):
    listed = F.array("event_type", F.lit("other"))
    return table(spark, folder, "events").select("event_id", D.first_label(listed).alias("label"))


@register("class_label_lookup", f"""with l as (select unnest([{', '.join(f"'{c}'" for c in CLASS_LABELS)}]) as label,
      unnest(range(0, {len(CLASS_LABELS)})) as idx)
    select e.event_id, coalesce(l.label, 'unknown') as label from events e left join l on e.event_id % 90 = l.idx""")
def class_label_lookup(spark, folder):
    index = (F.col("event_id") % 90).cast("int")
    return table(spark, folder, "events").select("event_id", L.class_label(index).alias("label"))


@register("normalise_label", "select ord, concat(upper(label[1]), lower(label[2:])) as label from fx_detections", "fx_detections")
def normalise_label(spark, folder):
    return view(spark, folder, "fx_detections").select("ord", L.normalise_label(F.col("label")).alias("label"))


@register("is_animal", f"select ord, lower(label) in ({KNOWN_ANIMALS}) as is_animal from fx_detections", "fx_detections")
def is_animal(spark, folder):
    return view(spark, folder, "fx_detections").select("ord", L.is_animal(F.upper("label")).alias("is_animal"))


@register("is_bird", f"select ord, lower(label) in ({KNOWN_BIRDS}) as is_bird from fx_detections", "fx_detections")
def is_bird(spark, folder):
    return view(spark, folder, "fx_detections").select("ord", L.is_bird(F.initcap("label")).alias("is_bird"))


@register("bird_subset", f"""with b as (select unnest([{KNOWN_ANIMALS}]) as name intersect select unnest([{KNOWN_BIRDS}]))
    select name, count(ord) as detections from b left join fx_detections on label = name group by name""", "fx_detections")
def bird_subset(spark, folder):
    both = F.array_intersect(F.array(*map(F.lit, ANIMALS)), F.array(*map(F.lit, BIRDS)))
    birds = spark.range(1).select(F.explode(both).alias("name"))
    counted = view(spark, folder, "fx_detections").groupBy(F.col("label").alias("name")).agg(F.count("ord").alias("detections"))
    return birds.join(counted, "name", "left").select("name", F.coalesce("detections", F.lit(0)).alias("detections"))


@register("class_argmax", """with s as (select anchor, features[6:13] as scores from fx_anchors),
    m as (select anchor, scores, list_max(scores) as top from s)
    select anchor, case when top <= 0 then 0 else cast(list_position(scores, top) as int) - 1 end as best_class,
      case when top <= 0 then 0e0 else round(cast(top as double), 6) end as best_score from m""", "fx_anchors")
def class_argmax(spark, folder):
    scores = F.slice("features", 6, 8)
    return tidy(anchors(spark, folder).select("anchor", D.class_argmax(scores).alias("best")))


def _keypoint_sql(k: int) -> str:
    at = 13 + 3 * k  # 0-based; DuckDB lists start at 1
    return f"""case when features[{at + 3}] > cast(3e-1 as float) then
        {{'x': cast(features[{at + 1}] as double), 'y': 1 - cast(features[{at + 2}] as double)}} end"""


POSE_SQL = f"""with o as (select image_id, anchor, features, features[5] as obj, features[6:13] as scores from fx_anchors
      where features[5] >= {GATE}),
    m as (select *, list_max(scores) as top from o),
    g as (select *, case when top <= 0 then 0 else list_position(scores, top) - 1 end as cls,
      cast(case when top <= 0 then 0 else top end as float) * obj as confidence from m),
    b as (select *, {rect_sql('cx - bw / 2', '1 - (cy + bh / 2)', 'bw', 'bh')} as raw from (select *,
      cast(features[1] as double) as cx, cast(features[2] as double) as cy, cast(features[3] as double) as bw,
      cast(features[4] as double) as bh from g where confidence >= {GATE})),
    c as (select *, {clamp_sql('raw')} as box, {_keypoint_sql(1)} as e1, {_keypoint_sql(2)} as e2, {_keypoint_sql(0)} as nose from b),
    l as (select unnest([{', '.join(f"'{c}'" for c in CLASS_LABELS)}]) as label,
      unnest(range(0, {len(CLASS_LABELS)})) as idx)
    select image_id, anchor as ord, label, {r6('confidence', 'confidence')}, {flat_sql('box', 'box')},
      cast(e1 is not null as int) + cast(e2 is not null as int) as eyes,
      {r6('coalesce(e1.x, e2.x)', 'eye_x')}, {r6('coalesce(e1.y, e2.y)', 'eye_y')},
      {r6('nose.x', 'nose_x')}, {r6('nose.y', 'nose_y')} from c left join l on cls = idx"""


@register("pose_decode", POSE_SQL, "fx_anchors")
def pose_decode(spark, folder):
    found = D.pose_decode(anchors(spark, folder))
    first = F.get("eye_kps", F.lit(0))
    return tidy(found.select(
        "image_id", "ord", "label", "confidence", "box", F.size("eye_kps").alias("eyes"),
        first["x"].alias("eye_x"), first["y"].alias("eye_y"), "nose"))


@register("classifier_boxes", f"""with r as ({TOP_SQL.format(rows=f'fx_detections where confidence >= {GATE}')})
    select image_id, ord, label, {r6('confidence', 'confidence')}, 0e0 as box_x, 0e0 as box_y, 1e0 as box_w, 1e0 as box_h
    from r where rank <= 10""", "fx_detections")
def classifier_boxes(spark, folder):
    kept = D.classifier_boxes(view(spark, folder, "fx_detections").select("image_id", "ord", "label", "confidence"))
    return tidy(kept.select("image_id", "ord", "label", "confidence", "box"))
