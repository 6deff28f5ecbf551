"""Catalog, browsing and decode-cascade queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions.constants import DECODE_ERROR, OPEN_ERROR, RAW_EXTENSIONS
from ...functions.files import file_ext, file_name
from ...functions.labels import sidecar_path as sidecar_column
from ...functions.scoring import is_rejected as rejected_column
from ...operators import attempts as T, catalog as K
from ...operators.metadata import flatten_metadata as flatten, search_metadata as search, unreadable_metadata as unreadable
from ...session import shared_folder
from ...sources.catalog_walk import read_catalog
from ...sources.files import write_files
from ...sources.headers import read_bytes as read_heads
from ...sources.listing import scan_catalog as scan, scan_many_roots as scan_roots
from ...streaming.changes import changed_files as changes
from ..views import VIEWS, results_view, table, view
from .registry import r6, register, tidy

EXT_SQL = r"upper(regexp_extract(path, '[^/]\.([^./]+)$', 1))"
RAW_SQL = f"lower({EXT_SQL}) in ({', '.join(repr(e) for e in RAW_EXTENSIONS)}) and not contains(path, '/.')"
NAME_SQL = "split_part(path, '/', -1)"


def card(spark, folder, label: str) -> str:
    """Writes every page as a file with the name of ``fx_catalog``; returns the root folder."""
    root = shared_folder(spark, label)
    files = table(spark, folder, "pages").selectExpr(
        f"{VIEWS['fx_catalog'][1]['path']} as path", "encode(html, 'UTF-8') as content")
    failed = write_files(files.withColumn("path", F.concat(F.lit(root), "path"))).filter("error is not null")
    if not failed.isEmpty():
        raise OSError("could not write the files to scan")
    return root


FILES_SQL = f"""select {NAME_SQL} as name, {EXT_SQL} as ext, octet_length(encode(html)) as size from (
    select c.path, p.html from fx_catalog c join pages p on cast(p.page_id as string) = regexp_extract(c.path, '([0-9]+)[.][^.]+$', 1))
    where {RAW_SQL}"""


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select(file_name(F.col("path")).alias("name"), file_ext(F.col("path")).alias("ext"), "size")


@register("scan_catalog", FILES_SQL, "fx_catalog")
def scan_catalog(spark, folder):
    return _listed(scan(spark, card(spark, folder, "card")))


@register("catalog_walk", f"select * from ({FILES_SQL}) where size > 1500 and ext <> '3FR'", "fx_catalog")
def catalog_walk(spark, folder):
    """The listing as a data source, which applies the filters on extension and size while it lists."""
    files = read_catalog(spark, card(spark, folder, "card")).where("size > 1500 and name like '%.%'")
    return files.where("ext <> '3FR'").select("name", "ext", "size")


@register("scan_many_roots", f"select * from ({FILES_SQL}) union all select * from ({FILES_SQL})", "fx_catalog")
def scan_many_roots(spark, folder):
    root = card(spark, folder, "card")
    return _listed(scan_roots(spark, root, root))


@register("read_bytes", f"""select {NAME_SQL} as name, octet_length(encode(html)) as size, md5(html) as digest from (
    select c.path, p.html from fx_catalog c join pages p on cast(p.page_id as string) = regexp_extract(c.path, '([0-9]+)[.][^.]+$', 1))
    where {RAW_SQL}""", "fx_catalog")
def read_bytes(spark, folder):
    heads = read_heads(scan(spark, card(spark, folder, "card")))
    return heads.select(
        file_name(F.col("path")).alias("name"), F.length("content").cast("bigint").alias("size"), F.md5("content").alias("digest"))


@register("catalog_content", f"""select {NAME_SQL} as name, md5(array_slice(encode(html), 1, 700)) as digest from (
    select c.path, p.html from fx_catalog c join pages p on cast(p.page_id as string) = regexp_extract(c.path, '([0-9]+)[.][^.]+$', 1))
    where {RAW_SQL}""", "fx_catalog")
def catalog_content(spark, folder):
    """The first bytes of every raw file, read while listing."""
    files = read_catalog(spark, card(spark, folder, "card"), 700)
    return files.where("error is null").select("name", F.md5("content").alias("digest"))


@register("changed_files", """with l as (select concat('/card/', cast(page_id as string)) as path, cast(length(html) as bigint) as size, page_id from pages)
    select path, size, count(*) as times from (
      select path, size from l
      union all select path, size + 1 from l where page_id % 3 = 0
      union all select path, size from l where page_id % 6 = 0
      union all select path || 'x', size from l where page_id % 5 = 0) group by 1, 2""")
def changed_files(spark, folder):
    """Three listings of a card in three micro-batches: whole, with changes and repeats, and with some files as they were and some new ones."""
    root = shared_folder(spark, "listings")
    pages = table(spark, folder, "pages").selectExpr(
        "page_id", "concat('/card/', page_id) as path", "cast(length(html) as bigint) as size", "timestamp'2024-01-01 00:00:00' as mtime")
    grown = pages.withColumn("size", F.expr("if(page_id % 3 = 0, size + 1, size)"))
    back = pages.withColumn("size", F.expr("if(page_id % 3 = 0 and page_id % 6 <> 0, size + 1, size)"))
    more = pages.where("page_id % 5 = 0").withColumn("path", F.concat("path", F.lit("x")))
    schema = pages.schema
    for listing in (pages, grown.union(grown), back.union(more)):
        listing.write.mode("append").parquet(f"{root}/listings")   # as many files as tasks; a batch takes all that are new
        files = spark.readStream.schema(schema).parquet(f"{root}/listings")
        query = changes(files).writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").outputMode("append")
        query.trigger(availableNow=True).start(f"{root}/changes").awaitTermination()
    return spark.read.parquet(f"{root}/changes").groupBy("path", "size").agg(F.count("*").alias("times"))


@register("raw_files", f"select path, size from fx_catalog where {RAW_SQL}", "fx_catalog")
def raw_files(spark, folder):
    return K.raw_files(view(spark, folder, "fx_catalog")).select("path", "size")


@register("union_listings", f"""select path, size from fx_catalog where {RAW_SQL} union all
    select path, size from fx_catalog""", "fx_catalog")
def union_listings(spark, folder):
    files = view(spark, folder, "fx_catalog").select("path", "size")
    return K.union_listings(K.raw_files(files), files)


def _tenths(unit: int, digits: int, name: str) -> str:
    step = unit // 10**digits
    n = f"((size + {step // 2}) // {step})"
    if not digits:
        return f"concat(cast({n} as string), ' {name}')"
    return f"concat(cast({n} // {10**digits} as string), '.', lpad(cast({n} % {10**digits} as string), {digits}, '0'), ' {name}')"


SIZE_SQL = f"""case when size = 0 then 'Zero KB' when size < 1000 then concat(cast(size as string), ' bytes')
    when size < 1000000 then {_tenths(1000, 0, 'KB')} when size < 1000000000 then {_tenths(10**6, 1, 'MB')}
    else {_tenths(10**9, 2, 'GB')} end"""
SIZED_SQL = "select path, mday, case when mday = 3 then 0 when mday = 5 then size % 1000 when mday = 7 then size * 40000 else size end as size from fx_catalog"


def sized(spark, folder) -> DataFrame:
    size = F.expr("case when mday = 3 then 0 when mday = 5 then size % 1000 when mday = 7 then size * 40000 else size end")
    return view(spark, folder, "fx_catalog").withColumn("size", size)


@register("format_size", f"with s as ({SIZED_SQL}) select path, {SIZE_SQL} as size_text from s", "fx_catalog")
def format_size(spark, folder):
    return K.catalog_columns(sized(spark, folder)).select("path", "size_text")


@register("catalog_columns", f"""select path, {NAME_SQL} as name, {EXT_SQL} as ext,
    coalesce(case when mday = 2 then null else size end, 0) as size from fx_catalog""", "fx_catalog")
def catalog_columns(spark, folder):
    known = F.when(F.coalesce(F.col("mday") == 2, F.lit(False)), None).otherwise(F.col("size"))
    return K.catalog_columns(view(spark, folder, "fx_catalog").withColumn("size", known)).select("path", "name", "ext", "size")


@register("sidecar_path", r"select path, concat(regexp_replace(path, '([^/])\.[^./]+$', '\1'), '.xmp') as sidecar from fx_catalog",
          "fx_catalog")
def sidecar_path(spark, folder):
    return view(spark, folder, "fx_catalog").select("path", sidecar_column(F.col("path")).alias("sidecar"))


# Names in several spellings: letters of both cases, composed and decomposed accents, and words without them.
ACCENTED = """concat(case doc_id % 6 when 0 then 'ÉTÉ_' when 1 then 'été-' when 2 then concat('E', chr(769), 'te', chr(769), ' ')
    when 3 then 'ete ' when 4 then 'Straße ' else 'ЛЕТО ' end, source, '/', lang, cast(doc_id as string))"""


@register("search_by_locale", f"""with n as (select doc_id, {ACCENTED} as name from documents)
    select 'case' as kind, doc_id from n where contains(lower(nfc_normalize(name)), 'été')
    union all select 'accents', doc_id from n where contains(strip_accents(lower(nfc_normalize(name))), 'ete')
    union all select 'cyrillic', doc_id from n where contains(lower(name), 'лето')""")
def search_by_locale(spark, folder):
    """Names by a collation, with accents and without."""
    names = table(spark, folder, "documents").selectExpr("doc_id", f"{ACCENTED.replace('chr(769)', "decode(X'CC81', 'UTF-8')")} as name")
    searches = {"case": ("éTé", "UNICODE_CI"), "accents": ("Ete", "UNICODE_CI_AI"), "cyrillic": ("Лето", "UNICODE_CI")}
    found = [K.search_name(names, query, collation).select(F.lit(kind).alias("kind"), "doc_id") for kind, (query, collation) in searches.items()]
    return found[0].union(found[1]).union(found[2])


@register("search_name", f"select path from fx_catalog where contains(lower({NAME_SQL}), 'img_1')", "fx_catalog")
def search_name(spark, folder):
    return K.search_name(K.catalog_columns(view(spark, folder, "fx_catalog")), "Img_1").select("path")


@register("sort_listing", f"select path, {NAME_SQL} as name from fx_catalog order by name, path", "fx_catalog")
def sort_listing(spark, folder):
    files = view(spark, folder, "fx_catalog").select("path", file_name(F.col("path")).alias("name"))
    return K.sort_catalog(files, "Name")


@register("sort_catalog", "select path, mday as mtime, size from fx_catalog order by mday desc nulls last, path", "fx_catalog")
def sort_catalog(spark, folder):
    files = view(spark, folder, "fx_catalog").select("path", F.col("mday").alias("mtime"), "size")
    return K.sort_catalog(files, "Date")


def results(spark, folder) -> DataFrame:
    return results_view(spark, folder)


@register("filter_mode", f"select doc_id, name, status, {r6('score', 'score')}, size from fx_results where status in ('Blurry', 'Slightly Blurry')",
          "fx_results")
def filter_mode(spark, folder):
    return tidy(K.filter_mode(results(spark, folder), "Rejected"))


@register("is_rejected", "select doc_id, status in ('Blurry', 'Slightly Blurry') as is_rejected from fx_results", "fx_results")
def is_rejected(spark, folder):
    return results(spark, folder).select("doc_id", rejected_column(F.col("status")).alias("is_rejected"))


@register("browse", f"""select doc_id, name, status, {r6('score', 'score')}, size from fx_results
    where contains(lower(name), 'en1') and status = 'Sharp' order by score desc, doc_id""", "fx_results")
def browse(spark, folder):
    return tidy(K.browse(results(spark, folder), "EN1", "Sharp", "Sharpness", key="doc_id"))


@register("status_summary", """select count_if(status = 'Sharp') as sharp, count_if(status in ('Blurry', 'Slightly Blurry')) as rejected,
    count(*) as total from fx_results""", "fx_results")
def status_summary(spark, folder):
    return K.status_summary(results(spark, folder))


@register("any_analyzed", """select 'all' as files, coalesce(bool_or(status <> 'Not Analyzed'), false) as any_analyzed from fx_results
    union all select 'none', coalesce(bool_or(status <> 'Not Analyzed'), false) from fx_results where status = 'none'""", "fx_results")
def any_analyzed(spark, folder):
    files = results(spark, folder)
    every = K.any_analyzed(files).withColumn("files", F.lit("all"))
    none = K.any_analyzed(files.filter("status = 'none'")).withColumn("files", F.lit("none"))
    return every.unionByName(none).select("files", "any_analyzed")


@register("has_label", "select ord, nullif(label, 'cat') as label from fx_detections where label <> 'cat'", "fx_detections")
def has_label(spark, folder):
    labelled = view(spark, folder, "fx_detections").selectExpr("ord", "nullif(label, 'cat') as label")
    return K.has_label(labelled)


# Two runs: the second one covers every other file and some that the catalog does not know.
@register("apply_results", f"""with r as (select doc_id, status, score, 1 as run from fx_results where status <> 'Not Analyzed'
      union all select case when doc_id % 10 = 0 then -1 - doc_id else doc_id end, 'Sharp', score / 2e0 + 25e-2, 2 from fx_results where doc_id % 2 = 0),
    l as (select *, row_number() over (partition by doc_id order by run desc) as n from r)
    select d.doc_id, coalesce(l.status, 'Not Analyzed') as status, {r6('coalesce(l.score, 0e0)', 'score')}
    from documents d left join l on d.doc_id = l.doc_id and l.n = 1""", "fx_results")
def apply_results(spark, folder):
    return tidy(K.apply_results(table(spark, folder, "documents").select("doc_id"), _runs(spark, folder), "doc_id", "run"))


def _runs(spark, folder) -> DataFrame:
    first = results(spark, folder).filter("status <> 'Not Analyzed'").selectExpr("doc_id", "status", "score", "1 as run")
    second = results(spark, folder).filter("doc_id % 2 = 0").selectExpr(
        "case when doc_id % 10 = 0 then -1 - doc_id else doc_id end as doc_id", "'Sharp' as status",
        "score / 2e0 + 25e-2 as score", "2 as run")
    return first.unionByName(second)


@register("rescan", """select d.doc_id, coalesce(l.quality is not null and d.doc_id % 5 <> 0 and d.doc_id % 7 <> 0, false) as kept,
    l.quality is null or d.doc_id % 5 = 0 or d.doc_id % 7 = 0 as to_do from documents d left join labels l on d.doc_id = l.doc_id""")
def rescan(spark, folder):
    from ...streaming.analysis import rescan as rescan_files

    # A fifth of the files has changed since, and a seventh is chosen to be done again.
    listing = table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("size"))
    before = listing.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    old = results(spark, folder).filter("status <> 'Not Analyzed'").select("doc_id", "status", "score").join(before, "doc_id")
    merged, left = rescan_files(listing, old, "doc_id", again=listing.filter("doc_id % 7 = 0"))
    to_do = left.withColumn("to_do", F.lit(True))
    return merged.join(to_do, "doc_id", "left").select(
        "doc_id", (F.col("status") != "Not Analyzed").alias("kept"), F.coalesce("to_do", F.lit(False)).alias("to_do"))


ATTEMPTS_SQL = "select l_orderkey as path, l_linenumber as stage, l_quantity > 25 as ok from lineitem"


def attempts(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey as path", "l_linenumber as stage", "l_linenumber % 3 as sub", "l_quantity > 25 as ok",
        "case l_partkey % 3 when 0 then 'thumb' when 1 then 'full' else 'jpeg' end as kind")


@register("first_success", f"""with a as ({ATTEMPTS_SQL}), f as (select path, min(stage) filter (where ok) as stage from a group by path)
    select o_orderkey as path, stage, coalesce(stage >= 3, false) as used_fallback,
      case when f.path is null then '{OPEN_ERROR}' when stage is null then '{DECODE_ERROR}' end as error
    from orders left join f on o_orderkey = f.path""")
def first_success(spark, folder):
    files = table(spark, folder, "orders").select(F.col("o_orderkey").alias("path"))
    return T.first_success(files, attempts(spark, folder))


@register("thumbnail_plan", """with a as (select l_orderkey as path, l_linenumber % 3 as sub, l_quantity > 25 as ok,
      case l_partkey % 3 when 0 then 'thumb' when 1 then 'full' else 'jpeg' end as kind from lineitem),
    k as (select path, kind, case when kind = 'jpeg' then null else sub end as sub, row_number() over (partition by path
      order by kind = 'jpeg', case when kind = 'jpeg' then 0 else sub end, kind = 'full') as r
      from a where ok and (kind <> 'full' or sub > 0))
    select o_orderkey as path, kind as source, cast(sub as int) as sub, case when kind = 'jpeg' then 400 end as width,
      case when kind = 'jpeg' then 300 end as height from orders left join k on o_orderkey = path and r = 1""")
def thumbnail_plan(spark, folder):
    files = table(spark, folder, "orders").select(F.col("o_orderkey").alias("path"))
    return T.thumbnail_plan(files, attempts(spark, folder))


FLAT_SQL = """select event_id, 'exif > kind' as key, json_extract_string(doc, '$.exif.kind') as value from fx_meta
    union all select event_id, 'exif > src > k', json_extract_string(doc, '$.exif.src.k') from fx_meta
    union all select event_id, 'tags', json_extract_string(doc, '$.tags') from fx_meta
    union all select event_id, 'user', json_extract_string(doc, '$.user') from fx_meta"""


@register("flatten_metadata", FLAT_SQL, "fx_meta")
def flatten_metadata(spark, folder):
    return flatten(view(spark, folder, "fx_meta"), key="event_id")


@register("search_metadata", f"""with f as ({FLAT_SQL}) select event_id, key, value from f
    where contains(lower(key), 'click') or contains(lower(value), 'click') order by event_id, key""", "fx_meta")
def search_metadata(spark, folder):
    return search(flatten(view(spark, folder, "fx_meta"), key="event_id"), "CLICK", "event_id")


@register("unreadable_metadata", """select event_id, case event_id % 7 when 0 then 'not JSON, or a key is repeated' else 'not an object' end as error
    from events where event_id % 7 in (0, 3)""")
def unreadable_metadata(spark, folder):
    """Documents cut off before their end, and lists in place of objects."""
    rest, doc = F.col("event_id") % 7, F.col("doc")
    broken = F.when(rest == 0, F.substring(doc, F.lit(1), F.length(doc) - 1)).when(rest == 3, F.concat(F.lit("["), doc, F.lit("]"))).otherwise(doc)
    return unreadable(view(spark, folder, "fx_meta").select("event_id", broken.alias("doc")), key="event_id")
