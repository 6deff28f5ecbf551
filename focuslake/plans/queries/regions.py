"""Region choice and the whole analysis over detections, poses, faces, focus points and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions.cascade import detector_region as detector_choice, fallback_region as fallback_choice
from ...functions.files import review_note as review_columns
from ...functions.geometry import eye_box, head_box, rect
from ...operators import regions as R
from ...operators.afpoints import preferred_union
from ...operators.detections import best_detection, confidence_gate, largest_box, top_detections
from ...operators.pixels import pixels_from_arrays
from ...session import shared_folder
from ..focus import analyze_focus, analyze_grids, plan_regions
from ..views import grids, view
from .detections import GATE, KNOWN_ANIMALS
from .focus_points import PREFERRED_SQL, points
from .geometry import window_sql
from .pixels import DIFF_SQL, MOMENTS_SQL, VARIANCE_SQL
from .registry import (
    acceptable_sql, blur_sql, clamp_sql, divisor_sql, expand_sql, flat_sql, intersect_sql, padded_sql, r6, rect_sql,
    register, sharp_sql, size_conf_sql, status_sql, tidy,
)

JOINT_SQL = """case kind when 1 then 'Left_Eye' when 2 then 'Right_Eye' when 3 then 'Nose' when 4 then 'Left_Ear'
    when 5 then 'Head_Top' else 'Tail' end"""


def joints(spark, folder) -> DataFrame:
    """Every focus point as a joint of one of two poses per image."""
    return view(spark, folder, "fx_rects").select(
        "image_id", F.col("in_focus").cast("int").alias("pose"), F.expr(JOINT_SQL).alias("joint"), "x", "y",
        (F.col("w") * 4.0).alias("confidence"))


JOINTS_SQL = f"""select image_id, cast(in_focus as int) as pose, lower({JOINT_SQL}) as joint, x, 1e0 - y as y,
    w * 4e0 as confidence from fx_rects"""


def _extent(cond: str, name: str) -> str:
    return ", ".join(
        f"{agg}({axis}) filter (where confidence > 2e-1 and ({cond})) as {name}_{axis}{i}"
        for axis in "xy" for i, agg in enumerate(("min", "max")))


POSES_SQL = f"""select image_id, pose, count(*) as joints, {_extent("joint like '%eye%'", 'eye')},
    {_extent("joint like '%eye%' or joint like '%ear%' or joint like '%nose%' or joint like '%head%'", 'head')},
    {_extent('true', 'body')} from j group by image_id, pose"""


def _padded(name: str, pad: str) -> str:
    return padded_sql(f"{name}_x0", f"{name}_x1", f"{name}_y0", f"{name}_y1", pad) + f" as {name}"


POSE_RECTS = f"{_padded('eye', '6e-2')}, {_padded('head', '4e-2')}, {_padded('body', '2e-2')}"
POSE_FLAT = ", ".join(flat_sql(k, k) for k in ("eye", "head", "body"))


@register("pose_regions", f"""with j as ({JOINTS_SQL}), p as ({POSES_SQL}), r as (select image_id, pose, joints, {POSE_RECTS} from p)
    select image_id, pose, joints, {POSE_FLAT} from r""", "fx_rects")
def pose_regions(spark, folder):
    return tidy(R.pose_regions(joints(spark, folder), "image_id", "pose"))


@register("animal_regions", f"""with j as ({JOINTS_SQL}), p as ({POSES_SQL}),
    b as (select *, row_number() over (partition by image_id order by joints desc, pose) as r from p),
    r as (select image_id, {POSE_RECTS} from b where r = 1) select image_id, {POSE_FLAT} from r""", "fx_rects")
def animal_regions(spark, folder):
    return tidy(R.animal_regions(joints(spark, folder)))


FACES_SQL = f"""select image_id, ord, {rect_sql('x', 'y', 'w', 'h')} as box from (select *, row_number() over (
    partition by image_id order by w * h desc, ord) as r from fx_detections where label = 'person') where r = 1"""


@register("face_eye_box", f"""with f as ({FACES_SQL}),
    p as (select f.image_id, box.x + d.x * box.w as x, 1e0 - (box.y + d.y * box.h) as y
      from f join fx_rects d on f.image_id = d.image_id where d.kind <= 2),
    e as (select image_id, min(x) as eye_x0, max(x) as eye_x1, min(y) as eye_y0, max(y) as eye_y1 from p group by image_id),
    r as (select image_id, {_padded('eye', '4e-2')} from e) select image_id, {flat_sql('eye', 'eye')} from r""",
    "fx_detections", "fx_rects")
def face_eye_box(spark, folder):
    faces = largest_box(_boxes(spark, folder).filter(F.col("label") == "person").select("image_id", "ord", "box"))
    landmarks = view(spark, folder, "fx_rects").filter("kind <= 2").select("image_id", "x", "y")
    return tidy(R.face_eye_box(faces, landmarks))


# --- inputs of the analysis: some images have detections, some animals, some faces, some focus points ----

def _boxes(spark, folder) -> DataFrame:
    return view(spark, folder, "fx_detections").withColumn("box", rect("x", "y", "w", "h"))


def subjects(spark, folder) -> DataFrame:
    """Detections with eye and nose points on some of them."""
    x, y, w, h, order = [F.col(c) for c in ("x", "y", "w", "h", "ord")]

    def point(px, py):
        return F.struct(px.alias("x"), py.alias("y"))

    eyes = F.when(order % 3 == 0, F.array(point(x, y), point(x + w / 4, y + h / 8))).otherwise(
        F.array().cast("array<struct<x:double,y:double>>"))
    return _boxes(spark, folder).select(
        "image_id", "ord", "label", "confidence", "box", eyes.alias("eye_kps"),
        F.when(order % 4 == 0, point(x + w / 2, y + h / 2)).alias("nose"))


def chosen_detections(spark, folder, wanted: DataFrame | None = None) -> DataFrame:
    return best_detection(R.of_images(top_detections(confidence_gate(subjects(spark, folder))), wanted))


KINDS = "label in ('bird', 'cat', 'kite')"
POSED = "image_id % 2 = 0"                      # images with poses, of which those below have no joint that counts
FAINT = "if(image_id % 6 = 0, 1e-1, confidence)"
NAMED = "ord % 7 <> 0"                          # boxes that a classifier names, every second of them twice
SECOND = "cast(6123e-4 as float)"


def animals(spark, folder, wanted: DataFrame | None = None) -> DataFrame:
    """Animals of images 100 and up: poses with a body, poses without, boxes alone; boxes with two labels, one or none."""
    poses = joints(spark, folder).where(POSED).withColumn("confidence", F.expr(FAINT))
    boxes = _boxes(spark, folder).where(KINDS)
    named = boxes.where(NAMED).select("image_id", "ord", "label", "confidence")
    second = named.where("ord % 2 = 0").withColumns({"label": F.lit("fox"), "confidence": F.expr(SECOND)})
    found = [t.withColumn("image_id", F.col("image_id") + 100) for t in (poses, boxes.select("image_id", "ord", "box"), named.union(second))]
    return R.animal_result(*found, wanted=wanted)


def humans(spark, folder, wanted: DataFrame | None = None) -> DataFrame:
    """People of images 200 and up: faces with landmarks, and faces without."""
    people = _boxes(spark, folder).where("label = 'person'").withColumn("image_id", F.col("image_id") + 200)
    marks = people.where("ord % 3 <> 0").select("image_id", "ord", F.inline(F.expr(LANDMARKS)))
    return R.human_result(people.select("image_id", "ord", "box"), marks, wanted=wanted)


# Two eyes within the face, counted from its lower left corner.
MARKS = [("(ord % 10) / 1e1", "(ord % 8) / 8e0"), ("(ord % 9) / 9e0", "5e-1")]
LANDMARKS = f"array({', '.join(f'struct({x} as x, {y} as y)' for x, y in MARKS)})"


def focus_rects(spark, folder) -> DataFrame:
    """Every third image has no focus point."""
    united = preferred_union(points(spark, folder))
    return united.withColumn("af_rect", F.when(F.col("image_id") % 3 != 0, F.col("af_rect")))


def images(spark, folder) -> DataFrame:
    return grids(spark, folder).select(
        F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), "grid")


FLIPPED = rect_sql("x", "1e0 - (y + h)", "w", "h")
ANIMALS_SQL = f"""with j as (select image_id + 100 as image_id, pose, joint, x, y, case when image_id % 6 = 0 then 1e-1 else confidence end as confidence
      from ({JOINTS_SQL}) where {POSED}), p as ({POSES_SQL}),
    rich as (select *, row_number() over (partition by image_id order by joints desc, pose) as r from p),
    posed as (select image_id, {POSE_RECTS} from rich where r = 1),
    boxed as (select image_id + 100 as image_id, ord, {FLIPPED} as box, row_number() over (partition by image_id order by w * h desc, ord) as r
      from fx_detections where {KINDS}),
    named as (select image_id + 100 as image_id, ord, label, confidence from fx_detections where {KINDS} and {NAMED}
      union all select image_id + 100, ord, 'fox', {SECOND} from fx_detections where {KINDS} and {NAMED} and ord % 2 = 0),
    firsts as (select *, row_number() over (partition by image_id order by confidence desc, ord) as of_image,
      row_number() over (partition by image_id, ord order by confidence desc) as of_box from named),
    both_parts as (select image_id, p.eye, p.head, p.body as posed_body, b.ord, b.box from (select * from posed where body is not null) p
      full join (select * from boxed where r = 1) b using (image_id))
    select image_id, eye, case when posed_body is not null then head else {rect_sql('box.x', 'box.y', 'box.w', 'box.h * 3e-1')} end as head,
      coalesce(posed_body, box) as body, case when posed_body is not null then i.label else o.label end as label
    from both_parts left join (select image_id, label from firsts where of_image = 1) i using (image_id)
      left join (select image_id, ord, label from firsts where of_box = 1) o using (image_id, ord)"""
HUMANS_SQL = f"""with faces as (select image_id + 200 as image_id, ord, x, y, w, h, {FLIPPED} as face,
      row_number() over (partition by image_id order by w * h desc, ord) as r from fx_detections where label = 'person'),
    marks as (select *, 1e0 - (y + (p).y * h) as py, x + (p).x * w as px from (select *, unnest([{', '.join(
        "{'x': " + x + ", 'y': " + y + "}" for x, y in MARKS)}]) as p from faces where r = 1 and ord % 3 <> 0)),
    ends as (select image_id, min(px) as eye_x0, max(px) as eye_x1, min(py) as eye_y0, max(py) as eye_y1 from marks group by image_id),
    eyes as (select image_id, {_padded('eye', '4e-2')} from ends)
    select image_id, eye, face from faces left join eyes using (image_id) where r = 1"""


@register("animal_result", f"""with a as ({ANIMALS_SQL}) select image_id, {POSE_FLAT}, label from a""", "fx_detections", "fx_rects")
def animal_result(spark, folder):
    return tidy(animals(spark, folder))


@register("human_result", f"""with h as ({HUMANS_SQL}) select image_id, {flat_sql('eye', 'eye')}, {flat_sql('face', 'face')} from h""", "fx_detections")
def human_result(spark, folder):
    return tidy(humans(spark, folder))


AF_SQL = f"""with {PREFERRED_SQL}
    select image_id, case when image_id % 3 <> 0 then {rect_sql('x0', 'y0', 'x1 - x0', 'y1 - y0')} end as af from u"""
PICK_SQL = f"""select image_id, ord, label, confidence, {rect_sql('x', 'y', 'w', 'h')} as box,
    case when ord % 3 = 0 then {rect_sql(
        'greatest(0e0, x - 5e-2)', 'greatest(0e0, y - 5e-2)',
        'least(1e0, (x + w / 4 - x) + 5e-2 * 2)', 'least(1e0, (y + h / 8 - y) + 5e-2 * 2)')} end as eye,
    case when ord % 12 = 0 then {rect_sql(
        'greatest(0e0, x - 4e-2)', 'greatest(0e0, y - 4e-2)',
        'least(1e0, (x + w / 2 - x) + 4e-2 * 2)', 'least(1e0, (y + h / 2 - y) + 4e-2 * 2)')}
      when ord % 3 = 0 then {rect_sql(
        'greatest(0e0, x - 4e-2)', 'greatest(0e0, y - 4e-2)',
        'least(1e0, (x + w / 4 - x) + 4e-2 * 2)', 'least(1e0, (y + h / 8 - y) + 4e-2 * 2)')}
      else {rect_sql('x', 'y', 'w', 'h * 3e-1')} end as head
    from (select *, row_number() over (partition by image_id order by label in ({KNOWN_ANIMALS}) desc, confidence desc, ord) as r
      from (select *, row_number() over (partition by image_id order by confidence desc, ord) as top
        from fx_detections where confidence >= {GATE}) where top <= 10) where r = 1"""


def _detector_sql(eye: str, head: str, af: str, shared: str) -> tuple[str, str]:
    name = f"""case when coalesce({eye}.w * {eye}.h > 4e-4, false) then 'Eyes (YOLO)'
        when coalesce({shared}.w * {shared}.h > 1e-3, false) then 'AF Point + Subject' else 'Head (YOLO)' end"""
    return name, f"case {name} when 'Eyes (YOLO)' then {eye} when 'AF Point + Subject' then {shared} else {head} end"


DETECTOR_NAME, DETECTOR_RECT = _detector_sql("eye", "head", "af", "shared")


@register("detector_region", f"""with pick as ({PICK_SQL}), af as ({AF_SQL}),
    j as (select pick.*, af.af from pick left join af using (image_id)), i as (select *, {intersect_sql('head', 'af')} as shared from j),
    c as (select image_id, {DETECTOR_NAME} as region, {DETECTOR_RECT} as rect from i)
    select image_id, region, {flat_sql('rect', 'rect')} from c""", "fx_detections", "fx_rects")
def detector_region(spark, folder):
    best = chosen_detections(spark, folder)
    eye, head = eye_box(F.col("eye_kps")), head_box(F.col("eye_kps"), F.col("nose"), F.col("box"))
    parts = best.select("image_id", eye.alias("eye"), head.alias("head"))
    joined = parts.join(focus_rects(spark, folder), "image_id", "left")
    chosen = detector_choice(F.col("eye"), F.col("head"), F.col("af_rect")).alias("c")
    return tidy(joined.select("image_id", chosen).select("image_id", "c.region", "c.rect"))


FALLBACK_CODE = """case when coalesce(a_eye.w * a_eye.h > 4e-4, false) then 'Animal Eyes'
    when coalesce(head_af.w * head_af.h > 1e-3, false) then 'head_af' when a_head is not null then 'Animal Head'
    when coalesce(h_eye.w * h_eye.h > 4e-4, false) then 'Human Eyes' when face is not null then 'Human Face'
    when coalesce(body_af.w * body_af.h > 1e-3, false) then 'body_af' when af is not null then 'AF Point'
    when a_body is not null then 'Animal Body' else 'Full Image' end"""
FALLBACK_NAME = "case when code in ('head_af', 'body_af') then 'AF Point + Subject' else code end"
FALLBACK_RECT = """case code when 'Animal Eyes' then a_eye when 'head_af' then head_af when 'Animal Head' then a_head
    when 'Human Eyes' then h_eye when 'Human Face' then face when 'body_af' then body_af when 'AF Point' then grown
    when 'Animal Body' then a_body end"""
ASSEMBLED_SQL = f"""img as (select vec_id as image_id from embeddings), a as ({ANIMALS_SQL}), h as ({HUMANS_SQL}), af as ({AF_SQL}),
    asm as (select img.image_id, a.eye as a_eye, a.head as a_head, a.body as a_body, a.label as a_label,
      h.eye as h_eye, h.face as face, af.af as af from img left join a using (image_id) left join h using (image_id)
      left join af using (image_id))"""
FALLBACK_SQL = f"""{ASSEMBLED_SQL}, g as (select *, case when af is not null then {expand_sql('af')} end as big from asm),
    x as (select *, {intersect_sql('a_head', 'af')} as head_af, {intersect_sql('af', 'a_body')} as body_af,
      {clamp_sql('big')} as grown from g),
    y as (select *, {FALLBACK_CODE} as code from x),
    fb as (select image_id, a_label, af, {FALLBACK_NAME} as region, {FALLBACK_RECT} as rect from y)"""


def assembled(spark, folder) -> DataFrame:
    return R.assemble_regions(
        images(spark, folder).drop("grid"), animals(spark, folder), humans(spark, folder), focus_rects(spark, folder))


@register("assemble_regions", f"""with {ASSEMBLED_SQL} select image_id, a_label as animal_label, {flat_sql('a_eye', 'animal_eye')},
    {flat_sql('a_head', 'animal_head')}, {flat_sql('a_body', 'animal_body')}, {flat_sql('h_eye', 'human_eye')},
    {flat_sql('face', 'human_face')}, {flat_sql('af', 'af_rect')} from asm""", "fx_detections", "fx_rects")
def assemble_regions(spark, folder):
    return tidy(assembled(spark, folder).drop("width", "height"))


@register("fallback_region", f"with {FALLBACK_SQL} select image_id, region, {flat_sql('rect', 'rect')} from fb",
          "fx_detections", "fx_rects")
def fallback_region(spark, folder):
    parts = ("animal_eye", "animal_head", "animal_body", "human_eye", "human_face", "af_rect")
    chosen = assembled(spark, folder).select("image_id", fallback_choice(*map(F.col, parts)).alias("c"))
    return tidy(chosen.select("image_id", "c.region", "c.rect"))


@register("af_subject_overlap", f"""with pick as ({PICK_SQL}), af as ({AF_SQL}),
    j as (select pick.image_id, pick.head, af.af from pick left join af using (image_id)),
    i as (select image_id, af, {intersect_sql('head', 'af')} as o from j)
    select image_id, {flat_sql('af', 'af_rect')}, {flat_sql('o', 'overlap')} from i""", "fx_detections", "fx_rects")
def af_subject_overlap(spark, folder):
    best = chosen_detections(spark, folder)
    heads = best.select("image_id", head_box(F.col("eye_kps"), F.col("nose"), F.col("box")).alias("head"))
    found = R.af_subject_overlap(heads, focus_rects(spark, folder), box="head")
    return tidy(found.select("image_id", "af_rect", "overlap"))


PICKED_SQL = f"""{FALLBACK_SQL}, pick as ({PICK_SQL}),
    j as (select fb.image_id, fb.af, fb.region as f_region, fb.rect as f_rect, fb.a_label, pick.eye, pick.head, pick.box,
      pick.confidence, pick.label, pick.box is not null as found from fb left join pick using (image_id)),
    i as (select *, {intersect_sql('head', 'af')} as shared from j),
    pk as (select image_id, case when found then 'detector' else 'fallback' end as path_taken, box, found,
      case when found then {DETECTOR_NAME} else f_region end as region,
      case when found then {DETECTOR_RECT} else f_rect end as rect,
      case when found then concat(upper(label[1]), lower(label[2:])) else a_label end as label, confidence as det_conf from i)"""


def picked(spark, folder) -> DataFrame:
    """The region of every image. What is known of other images is left out before it is grouped, where images are few."""
    listed = images(spark, folder).drop("grid")
    af = R.of_images(focus_rects(spark, folder), listed)
    parts = R.assemble_regions(listed, animals(spark, folder, listed), humans(spark, folder, listed), af)
    return R.pick_path(parts, chosen_detections(spark, folder, listed))


@register("pick_path", f"""with {PICKED_SQL} select image_id, path_taken, region, label, {r6('det_conf', 'det_conf')},
    {flat_sql('rect', 'rect')} from pk""", "fx_detections", "fx_rects")
def pick_path(spark, folder):
    return tidy(picked(spark, folder).select("image_id", "path_taken", "region", "label", "det_conf", "rect"))


def cropped_sql(width: str, height: str) -> str:
    """Adds the window of an image of the given size, and the values for a crop that failed."""
    whole = "{'x0': 0, 'y0': 0, 'x1': " + width + ", 'y1': " + height + "}"
    return f"""w as (select *, {window_sql('rect', width, height)} as win from pk),
    m0 as (select *, found and win is null as missed from w),
    cf as (select image_id, path_taken, label, det_conf, case when missed then 'Body (YOLO)' else region end as region,
      case when missed then box else rect end as rect,
      case when missed then 7e-1 else {size_conf_sql('(rect.w * rect.h)')} end as size_conf, coalesce(win, {whole}) as win from m0)"""


# Boxes moved to the right and down, so that some of them miss the image.
MOVED_SQL = f"""mv as (select * replace ({rect_sql('rect.x + image_id % 4 * 3e-1', 'rect.y + image_id % 3 * 3e-1', 'rect.w', 'rect.h')} as rect) from pk0)"""


@register("crop_failure", f"""with {PICKED_SQL.replace('pk as (', 'pk0 as (')}, {MOVED_SQL},
    pk as (select * replace (case when rect.x is null then null else rect end as rect) from mv), {cropped_sql('8', '8')}
    select image_id, region, {r6('size_conf', 'size_conf')}, {flat_sql('rect', 'rect')}, win.x0 as window_x0, win.y0 as window_y0,
      win.x1 as window_x1, win.y1 as window_y1 from cf""", "fx_detections", "fx_rects")
def crop_failure(spark, folder):
    r, i = F.col("rect"), F.col("image_id")
    moved = picked(spark, folder).withColumn("rect", rect(r["x"] + i % 4 * 0.3, r["y"] + i % 3 * 0.3, r["w"], r["h"]))
    cut = R.crop_failure(moved).select("image_id", "region", "size_conf", "rect", "window.*")
    for k in ("x0", "y0", "x1", "y1"):
        cut = cut.withColumnRenamed(k, f"window_{k}")
    return tidy(cut)


ANALYSIS_SQL = f"""{PICKED_SQL}, {cropped_sql('8', '8')},
    px as (select vec_id, y, x, g from fx_grid join cf on vec_id = image_id
      where x >= win.x0 and x < win.x1 and y >= win.y0 and y < win.y1),
    d as ({DIFF_SQL.format(pixels='px')}), m as ({MOMENTS_SQL}), v as ({VARIANCE_SQL}),
    s as (select cf.*, var_h, var_v, case when var_h is not null then
      least(sqrt(greatest(var_h, 0e0) * greatest(var_v, 0e0)) / {divisor_sql('region')}, 1e0) * size_conf end as sc,
      {sharp_sql('region')} as sh, {acceptable_sql('region')} as ac from cf left join v on vec_id = image_id),
    res as (select image_id, case when sc is null then 'Not Analyzed' else {status_sql('sc', 'sh', 'ac')} end as status,
      coalesce(sc, 0e0) as score, case when sc is null then 'Full Image' else region end as region,
      case when sc is null then 'Unknown' else {blur_sql('sc', 'sh', 'ac', 'var_h', 'var_v')} end as blur_type,
      case when sc is null then 0e0 else size_conf end as size_conf, case when sc is not null then label end as label,
      case when sc is not null then rect end as rect, case when sc is not null then det_conf end as det_conf from s)"""
RESULT_SQL = f"""with {ANALYSIS_SQL} select image_id, status, {r6('score', 'score')}, region, blur_type, {r6('size_conf', 'size_conf')},
    label, {flat_sql('rect', 'rect')}, {r6('det_conf', 'det_conf')} from res"""


def planned(spark, folder) -> DataFrame:
    return plan_regions(
        images(spark, folder), subjects(spark, folder), animals(spark, folder), humans(spark, folder), focus_rects(spark, folder))


def analyzed(spark, folder) -> DataFrame:
    return analyze_grids(planned(spark, folder))


@register("analyze_focus", RESULT_SQL, "fx_detections", "fx_rects", "fx_grid")
def analyze_arrays(spark, folder):
    return tidy(analyzed(spark, folder))


@register("analyze_focus_pixels", RESULT_SQL, "fx_detections", "fx_rects", "fx_grid")
def analyze_pixels(spark, folder):
    # Windows and results both need the plan; stored, it is worked out once.
    stored = f"{shared_folder(spark, 'plan')}/planned"
    planned(spark, folder).drop("grid").write.parquet(stored)
    plan = spark.read.parquet(stored)
    pixels = pixels_from_arrays(images(spark, folder).select("image_id", "grid", "width"))
    return tidy(analyze_focus(plan, pixels))


@register("review_note", f"""with {ANALYSIS_SQL} select image_id,
    case when status <> 'Not Analyzed' and label is not null then case when det_conf is not null
      then concat('YOLO ', cast(cast(trunc(det_conf * cast(100 as float)) as int) as string), '%') else 'Vision' end end as note_provenance,
    case when status not in ('Not Analyzed', 'Sharp') and blur_type not in ('None', 'Unknown') then blur_type end as note_blur,
    case when status not in ('Not Analyzed', 'Sharp') and size_conf < 7e-1 then 'Small subject' end as note_subject from res""",
    "fx_detections", "fx_rects", "fx_grid")
def review_note(spark, folder):
    cols = [F.col(c) for c in ("status", "label", "det_conf", "blur_type", "size_conf")]
    noted = analyzed(spark, folder).select("image_id", review_columns(*cols).alias("note"))
    return noted.select("image_id", *[F.col(f"note.{k}").alias(f"note_{k}") for k in ("provenance", "blur", "subject")])
