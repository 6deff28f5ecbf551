"""Keyword and sidecar queries: every detection as a labelled file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ...functions import labels as L
from ...functions.constants import BIRD_TERMS, NO_LABEL_ERROR
from ...functions.files import file_name
from ...operators.detections import best_detection, confidence_gate
from ...session import shared_folder
from ...sources import sidecars as S
from ...sources.listing import walk
from ..views import view
from .detections import BEST_SQL, detections
from .geometry import REGION_SQL
from .registry import register

# Labels with markup, empty labels and missing ones.
LABEL = """case when ord % 13 = 0 then null when ord % 11 = 0 then '' when ord % 7 = 0 then concat(label, ' & <co> "x" ''y''')
    when ord % 5 = 0 then concat('White-Tailed -- ', label) else label end"""
FILE_PATH = "concat('/card/DCIM/', cast(image_id as string), '_', cast(ord as string), '.CR3')"
FILES_SQL = f"select ord, {FILE_PATH} as path, {REGION_SQL} as region, {LABEL} as label from fx_detections"

BIRD_SQL = f"regexp_matches(lower(label), '{'|'.join(BIRD_TERMS)}')"
GROUP_SQL = f"""case when region not in ('Animal Eyes', 'Animal Head', 'Animal Body', 'Eyes (YOLO)', 'Head (YOLO)', 'Body (YOLO)')
    then 'Wildlife' when coalesce({BIRD_SQL}, false) then 'Birds' else 'Mammals' end"""


def escape_sql(text: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        text = f"replace({text}, '{raw}', '{entity}')"
    return text


KEYWORD_SQL = "concat('Wildlife|', grp, '|', label)"


def xmp_sql() -> str:
    fields = {"flat": escape_sql("label"), "group": "grp", "label": "label", "hierarchical": escape_sql(KEYWORD_SQL)}
    pieces = re.split(r"\{(\w+)\}", L.XMP_TEMPLATE.replace("{toolkit}", "focuslake"))
    return "concat(" + ", ".join(fields[p] if i % 2 else f"'{p}'" for i, p in enumerate(pieces)) + ")"


GROUPED_SQL = f"f as ({FILES_SQL}), g as (select *, {GROUP_SQL} as grp from f)"


def labelled(spark, folder) -> DataFrame:
    return view(spark, folder, "fx_detections").selectExpr(
        "ord", f"{FILE_PATH} as path", f"{REGION_SQL} as region", f"{LABEL} as label")


@register("species_group", f"with {GROUPED_SQL} select ord, grp as species_group from g", "fx_detections")
def species_group(spark, folder):
    return labelled(spark, folder).select("ord", L.species_group(F.col("region"), F.col("label")).alias("species_group"))


@register("hierarchical_keyword", f"with {GROUPED_SQL} select ord, 'Wildlife|' || grp || '|' || label as keyword from g", "fx_detections")
def hierarchical_keyword(spark, folder):
    group = L.species_group(F.col("region"), F.col("label"))
    return labelled(spark, folder).select("ord", L.hierarchical_keyword(group, F.col("label")).alias("keyword"))


@register("xml_escape", f"with f as ({FILES_SQL}) select ord, {escape_sql('label')} as escaped from f", "fx_detections")
def xml_escape(spark, folder):
    return labelled(spark, folder).select("ord", L.xml_escape(F.col("label")).alias("escaped"))


@register("build_xmp", f"with {GROUPED_SQL} select ord, {xmp_sql()} as xmp from g where label <> ''", "fx_detections")
def build_xmp(spark, folder):
    label = F.col("label")
    rows = labelled(spark, folder).filter(label != "")
    return rows.select("ord", L.build_xmp(label, L.species_group(F.col("region"), label)).alias("xmp"))


TABLE_SQL = f"""t as (select ord, path, replace(path, '.CR3', '.xmp') as sidecar_path, case when label <> '' then {xmp_sql()} end as xmp,
    case when label is null then 'skipped' when label = '' then 'error' else 'written' end as status,
    case when label = '' then concat(split_part(path, '/', -1), ': {NO_LABEL_ERROR}') end as error from g)"""


@register("sidecar_table", f"with {GROUPED_SQL}, {TABLE_SQL} select path, sidecar_path, xmp, status, error from t", "fx_detections")
def sidecar_table(spark, folder):
    return S.sidecar_table(labelled(spark, folder))


@register("write_summary", f"""with {GROUPED_SQL}, {TABLE_SQL}, c as (select count_if(status = 'written') as written,
    count_if(status = 'skipped') as skipped, count_if(status = 'error') as errors from t)
    select *, concat(written, ' XMP file(s) written', case when skipped > 0 then concat(', ', skipped, ' skipped') else '' end,
      case when errors > 0 then concat(', ', errors, ' error(s)') else '' end) as message from c""", "fx_detections")
def write_summary(spark, folder):
    return S.write_summary(S.sidecar_table(labelled(spark, folder)))


@register("sidecar_exists", """with s as (select regexp_replace(path, '([^/])[.][^./]+$', '\\1') || '.xmp' as there
      from fx_catalog where size % 2 = 0), f as (select path, regexp_replace(path, '([^/])[.][^./]+$', '\\1') || '.xmp' as sidecar from fx_catalog)
    select path, sidecar in (select there from s) as xmp_written from f""", "fx_catalog")
def sidecar_exists(spark, folder):
    files = view(spark, folder, "fx_catalog").select("path", "size")
    sidecars = files.filter("size % 2 = 0").select(L.sidecar_path(F.col("path")).alias("path"))
    return S.sidecar_exists(files, sidecars).select("path", "xmp_written")


LISTED_SQL = f"""f as ({FILES_SQL}), s as (select replace(path, '.CR3', '.xmp') as there from f where ord % 2 = 0)"""


@register("refresh_written", f"""with {LISTED_SQL} select ord, case when label is not null then replace(path, '.CR3', '.xmp') in (select there from s)
    else ord % 3 = 0 end as xmp_written from f""", "fx_detections")
def refresh_written(spark, folder):
    files = labelled(spark, folder).withColumn("xmp_written", F.col("ord") % 3 == 0)
    listed = files.filter("ord % 2 = 0").select(L.sidecar_path(F.col("path")).alias("path"))
    return S.refresh_written(files, listed).select("ord", "xmp_written")


@register("breaks_comment", f"with f as ({FILES_SQL}) select ord, contains(label, '--') as broken from f", "fx_detections")
def breaks_comment(spark, folder):
    return labelled(spark, folder).select("ord", L.breaks_comment(F.col("label")).alias("broken"))


# One file per image, named after its best detection.
BEST_FILES_SQL = f"""b as ({BEST_SQL}), f as (select image_id, ord, concat(cast(image_id as string), '.CR3') as path,
    {REGION_SQL} as region, {LABEL} as label from b)"""


def best_files(spark, folder, root: str) -> DataFrame:
    best = best_detection(confidence_gate(detections(spark, folder)))
    return best.select(
        F.concat(F.lit(root + "/"), F.col("image_id").cast("string"), F.lit(".CR3")).alias("path"),
        F.expr(REGION_SQL).alias("region"), F.expr(LABEL).alias("label"))


@register("write_sidecars", f"""with {BEST_FILES_SQL} select path as name,
    case when label is null then 'skipped' when label = '' then 'error' else 'written' end as status,
    case when label = '' then concat(path, ': {NO_LABEL_ERROR}') end as error,
    coalesce(label <> '', false) as xmp_written from f""", "fx_detections")
def write_sidecars(spark, folder):
    """Writes the files, stores what became of each, and looks for them in a new listing."""
    root = shared_folder(spark, "sidecars")
    files = best_files(spark, folder, f"{root}/files")
    outcome = f"{root}/outcome"
    S.write_sidecars(S.sidecar_table(files)).write.parquet(outcome)
    found = walk(spark, f"{root}/files", ["xmp"])
    flagged = S.sidecar_exists(spark.read.parquet(outcome), found)
    return flagged.select(file_name(F.col("path")).alias("name"), "status", "error", "xmp_written")


@register("save_sidecars", f"""with {BEST_FILES_SQL}, c as (select count_if(label <> '') as written, count_if(label is null) as skipped,
      count_if(label = '') as errors from f), s as (select count_if(label <> '') as found from f)
    select c.*, concat(written, ' XMP file(s) written', case when skipped > 0 then concat(', ', skipped, ' skipped') else '' end,
      case when errors > 0 then concat(', ', errors, ' error(s)') else '' end) as message, found from c, s""", "fx_detections")
def save_sidecars(spark, folder):
    """The same through the sink, whose tasks report what they did; the files are counted in a new listing."""
    root = shared_folder(spark, "sidecars")
    done = S.save_sidecars(S.sidecar_table(best_files(spark, folder, f"{root}/files")), f"{root}/summary")
    return done.withColumn("found", F.lit(walk(spark, f"{root}/files", ["xmp"]).count()))
