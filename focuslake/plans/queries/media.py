"""Queries over file contents: embedded data, tag containers, images, streams, detectors."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.geometry import head_from_body, rect
from ...operators import pixels as P
from ...operators.afpoints import header_af_rects as rects_of_headers
from ...operators.detections import confidence_gate, top_detections
from ...operators.udf import detect_in_batches as run_in_batches, detect_with as run_detector, full_window, laplacian_udf
from ...session import shared_folder
from ...sources import headers as H
from ...sources.catalog_walk import read_catalog, stream_catalog as stream_files
from ...sources.files import write_files
from ...sources.images import read_images as load_images
from ...sources.previews import write_previews
from ...streaming.analysis import (
    analyze_stream as run_stream, batch_counts, progress as share_done, score_arrivals, stored_results,
)
from ...streaming.current import current_results
from ..focus import analyze_card as score_card, analyze_images as score_images, focus_from_grids, score_regions as score_all
from ..views import af_payloads, grids, table, view
from .focus_points import AF_RECTS_SQL
from .geometry import window_sql
from .pixels import FLAGSHIP_SQL, LAPLACIAN_SQL, laplacian_sql, with_grid_regions
from .regions import RESULT_SQL, picked
from .registry import (
    acceptable_sql, blur_sql, divisor_sql, flat_sql, r6, rect_sql, register, sharp_sql, size_conf_sql, status_sql, tidy,
)

CARVED = """select page_id, case when a > 0 and z > 0 and n - z - 2 >= a then substring(html, a, n - z - a + 2) end as c from (
    select page_id, html, length(html) as n, position('<body' in html) as a, position(reverse('</p>') in reverse(html)) as z from pages)"""


@register("carve_between", f"select page_id, length(c) as size, md5(c) as digest from ({CARVED})")
def carve_between(spark, folder):
    body = H.carve_between(F.col("html"), "<body", "</p>")
    return table(spark, folder, "pages").select("page_id", body.alias("c")).select(
        "page_id", F.length("c").alias("size"), F.md5("c").alias("digest"))


@register("carve_embedded_jpeg", """select page_id, 'FFD8FF' || hex(encode(url)) || 'FFD900FFD8FF' || hex(encode(html)) || 'FFD9' as jpeg from pages""")
def carve_embedded_jpeg(spark, folder):
    """Two markers of each kind inside a page: the result reaches from the first start to the last end."""
    def text(c: str) -> Column:
        return F.encode(F.col(c), "UTF-8")

    def raw(digits: str) -> Column:
        return F.unhex(F.lit(digits))

    carrier = F.concat(
        text("html"), raw("FFD9FFD8FF"), text("url"), raw("FFD900FFD8FF"), text("html"), raw("FFD9"), text("url"))
    pages = table(spark, folder, "pages").select("page_id", carrier.alias("content"))
    return pages.select("page_id", F.hex(H.carve_embedded_jpeg(F.col("content"))).alias("jpeg"))


def _u16(v: Column, little: Column) -> Column:
    low, high = F.pmod(v, F.lit(256)), F.pmod(F.shiftright(v, 8), F.lit(256))
    return F.lpad(F.hex(F.when(little, low * 256 + high).otherwise(high * 256 + low)), 4, "0")


def _u32(v: int, little: Column) -> Column:
    big = v.to_bytes(4, "big").hex().upper()
    return F.when(little, v.to_bytes(4, "little").hex().upper()).otherwise(big)


def containers(spark, folder) -> DataFrame:
    """Both payloads of every order as one camera container, byte order by order key.

    Every third one starts with a box of the right name and an impossible size.
    """
    both = af_payloads(spark, folder)
    little = F.col("image_id") % 2 == 0

    def values(c: str) -> Column:
        return F.array_join(F.transform(c, lambda v: _u16(v, little)), "")

    def entry(tag: int, count: int, value: int) -> list[Column]:
        return [_u16(F.lit(tag), little), _u16(F.lit(3), little), _u32(count, little), _u32(value, little)]

    tiff = F.concat(
        F.when(little, "4949").otherwise("4D4D"), _u16(F.lit(42), little), _u32(8, little), _u16(F.lit(3), little),
        *entry(1, 1, 7), *entry(38, 16, 94), *entry(16403, 22, 50), _u32(0, little), values("new"), values("old"))
    name = F.lit("CMT3".encode().hex().upper())
    decoy = F.when(F.col("image_id") % 3 == 0, F.concat(F.lit("FFFFFFFF"), name)).otherwise(F.lit(""))
    size = F.lit((8 + 126).to_bytes(4, "big").hex().upper())
    box = F.concat(F.lit("00" * 16), decoy, size, name, tiff, F.lit("AB" * 24))
    return both.select("image_id", F.unhex(box).alias("content"))


@register("extract_af_tags", """select image_id, case tag when 38 then 1 else 2 end as entry, tag, len(vals) as cnt,
    array_to_string(vals, ',') as vals from fx_tags""", "fx_tags")
def extract_af_tags(spark, folder):
    tags = H.extract_af_tags(containers(spark, folder), "image_id")
    return tags.withColumn("cnt", F.col("cnt").cast("bigint")).withColumn(
        "vals", F.array_join(F.col("vals").cast("array<string>"), ","))


@register("header_af_rects", AF_RECTS_SQL, "fx_tags")
def header_af_rects(spark, folder):
    """Focus points straight from the headers, each within its row."""
    return tidy(rects_of_headers(containers(spark, folder), "image_id"))


def buffers(spark, folder) -> DataFrame:
    """Gray images as one byte per pixel."""
    levels = F.unhex(F.array_join(F.transform("grid", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    eight = F.lit(8)
    image = F.struct(eight.alias("width"), eight.alias("height"), F.lit(1).alias("channels"), levels.alias("data"))
    return grids(spark, folder).select("vec_id", image.alias("image"))


def _png(width: int, height: int, levels: bytes) -> bytes:
    import struct
    import zlib

    import numpy as np

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    pixels = np.frombuffer(levels, np.uint8).reshape(height, width)
    lines = np.pad(np.repeat(pixels, 3, axis=1), ((0, 0), (1, 0))).tobytes()   # each line begins with its filter, none
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_files(images: DataFrame, root: str, prefix: str = "") -> DataFrame:
    """``(path, content)``: every image as a PNG file below a folder."""

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [
                (f"{root}/{prefix}{r['vec_id']}.png", _png(r["image"]["width"], r["image"]["height"], r["image"]["data"]))
                for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary()))], names=["path", "content"])

    return images.mapInArrow(encode, "path string, content binary")


def image_folder(spark, folder, root: str | None = None, prefix: str = "", wanted: Column | None = None) -> str:
    """Writes every wanted image as a PNG file named by its number; returns the folder."""
    root = root or shared_folder(spark, "images")
    images = buffers(spark, folder) if wanted is None else buffers(spark, folder).where(wanted)
    if not write_files(png_files(images, root, prefix)).filter("error is not null").isEmpty():
        raise OSError("could not write the images")
    return root


IMAGE_NUMBER = r"regexp_extract(path, '([0-9]+)[.]png$', 1)"


@register("read_images", LAPLACIAN_SQL, "fx_grid")
def read_images(spark, folder):
    """Reads the images back through the image source and scores them whole."""
    image = F.col("image")
    m = laplacian_udf(image, F.lit(1), full_window(image["width"], image["height"]))
    loaded = load_images(spark, image_folder(spark, folder))
    stats = loaded.select(F.expr(IMAGE_NUMBER).cast("bigint").alias("vec_id"), m.alias("m")).select("vec_id", "m.*")
    return tidy(P.with_variances(stats))


@register("analyze_images", RESULT_SQL, "fx_detections", "fx_rects", "fx_grid")
def analyze_images(spark, folder):
    """The whole analysis over image files: regions from the tables, pixels from the files."""
    loaded = load_images(spark, image_folder(spark, folder))
    numbered = loaded.select(F.expr(IMAGE_NUMBER).cast("bigint").alias("image_id"), "image")
    return tidy(score_images(numbered, picked(spark, folder).drop("width", "height"), "image_id"))


def large_images(spark, folder) -> DataFrame:
    """Images of 16 x 16 pixels, each of four small ones side by side; one that is missing is black."""
    small = grids(spark, folder).selectExpr("vec_id div 4 as image_id", "int(vec_id % 4) as part", "grid")
    parts = [F.coalesce(F.max(F.when(F.col("part") == i, F.col("grid"))), F.array_repeat(F.lit(0), 64)) for i in range(4)]
    four = small.groupBy("image_id").agg(*[p.alias(f"g{i}") for i, p in enumerate(parts)])

    def line(left: str, right: str, y: int) -> list[Column]:
        return [F.slice(left, 8 * y + 1, 8), F.slice(right, 8 * y + 1, 8)]

    rows = [c for left, right in (("g0", "g1"), ("g2", "g3")) for y in range(8) for c in line(left, right, y)]
    data = F.unhex(F.array_join(F.transform(F.concat(*rows), lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    side = F.lit(16)
    return four.select("image_id", F.struct(side.alias("width"), side.alias("height"), F.lit(1).alias("channels"), data.alias("data")).alias("image"))


REGIONS_SQL = f"""top as (select *, row_number() over (partition by image_id order by confidence desc, ord) as r
      from fx_detections where confidence >= 35e-2),
    cand as (select image_id, r * 2 as k, 'Body (YOLO)' as region, {rect_sql('x', 'y', 'w', 'h')} as rect from top where r <= 10
      union all select image_id, r * 2 + 1, 'Head (YOLO)', {rect_sql('x', 'y', 'w', 'h * 3e-1')} from top where r <= 10),
    big as (select vec_id // 4 as image_id, x + 8 * (vec_id % 2) as x, y + 8 * (vec_id % 4 // 2) as y, g from fx_grid),
    small as (select image_id, x // 2 as x, y // 2 as y, cast(sum(g) // 4 as int) as g from big group by all),
    full_small as (select i.image_id, a.x, b.y, coalesce(s.g, 0) as g from (select distinct image_id from small) i
      cross join (select unnest(range(8)) as x) a cross join (select unnest(range(8)) as y) b left join small s using (image_id, x, y)),
    win as (select image_id, k, region, rect, coalesce({window_sql('rect', '8', '8')}, {{'x0': 0, 'y0': 0, 'x1': 8, 'y1': 8}}) as c from cand),
    px as (select image_id * 100 + k as vec_id, x, y, g from full_small join win using (image_id) where x >= c.x0 and x < c.x1 and y >= c.y0 and y < c.y1),
    {laplacian_sql('px')},
    s as (select w.image_id, w.region, w.rect, v.*, {size_conf_sql('(rect.w * rect.h)')} as size_conf from win w join v on v.vec_id = w.image_id * 100 + w.k),
    t as (select *, least(sqrt(greatest(var_h, 0e0) * greatest(var_v, 0e0)) / {divisor_sql('region')}, 1e0) * size_conf as sc,
      {sharp_sql('region')} as sh, {acceptable_sql('region')} as ac from s)"""


@register("score_regions", f"""with {REGIONS_SQL} select image_id, region, {flat_sql('rect', 'rect')}, n, sum_h, ss_h, sum_v, ss_v, {r6('sc', 'score')},
    {status_sql('sc', 'sh', 'ac')} as status, {blur_sql('sc', 'sh', 'ac', 'var_h', 'var_v')} as blur_type from t""", "fx_detections", "fx_grid")
def score_regions(spark, folder):
    """Bodies and heads of the ten surest detections of an image, all scored in one pass over its pixels, which are halved first."""
    top = top_detections(confidence_gate(view(spark, folder, "fx_detections").withColumn("box", rect("x", "y", "w", "h"))))
    body, head = F.col("box"), head_from_body(F.col("box"))
    both = F.array(*[F.struct(F.lit(name).alias("region"), r.alias("rect")) for name, r in (("Body (YOLO)", body), ("Head (YOLO)", head))])
    candidates = top.groupBy("image_id").agg(F.flatten(F.collect_list(both)).alias("regions"))
    found = score_all(large_images(spark, folder), candidates, max_side=8).where("n > 0")
    return tidy(found.select("image_id", "region", "rect", "n", "sum_h", "ss_h", "sum_v", "ss_v", "score", "status", "blur_type"))


def card_picks(spark, folder, root: str) -> DataFrame:
    """The regions picked for the images of a card whose names begin with an underscore."""
    path = F.concat(F.lit(f"{root}/_MG_"), F.col("image_id").cast("string"), F.lit(".png"))
    return picked(spark, folder).drop("width", "height").withColumn("path", path)


def _by_number(results: DataFrame) -> DataFrame:
    rest = [c for c in results.columns if c != "path"]
    return tidy(results.select(F.expr(IMAGE_NUMBER).cast("bigint").alias("image_id"), *rest))


@register("analyze_card", RESULT_SQL, "fx_detections", "fx_rects", "fx_grid")
def analyze_card(spark, folder):
    """The same for a card on disk whose names begin with an underscore: listed, previews written apart, scored folder by folder."""
    root = shared_folder(spark, "card")
    image_folder(spark, folder, f"{root}/DCIM", "_MG_")
    write_previews(read_catalog(spark, f"{root}/DCIM", raw=False), f"{root}/previews").write.parquet(f"{root}/previews-table")
    previews = spark.read.parquet(f"{root}/previews-table")
    return _by_number(score_card(card_picks(spark, folder, f"{root}/DCIM"), previews, f"{root}/previews", most=1_000))


@register("stream_catalog", RESULT_SQL, "fx_detections", "fx_rects", "fx_grid")
def stream_catalog(spark, folder):
    """The same for a card that fills up while a stream watches it, over a stop in between; the stream lists names with underscores too."""
    root, third = shared_folder(spark, "filling"), F.col("vec_id") % 3
    plan = card_picks(spark, folder, f"{root}/DCIM")
    for wanted in (third == 0, third != 0):
        image_folder(spark, folder, f"{root}/DCIM", "_MG_", wanted)
        time.sleep(1)
        files = stream_files(spark, f"{root}/DCIM", settle="0.5")
        analyze = score_arrivals(lambda batch: plan.join(batch.select("path"), "path", "left_semi"), f"{root}/previews")
        run_stream(files, analyze, f"{root}/results", f"{root}/checkpoint", current=f"{root}/current").awaitTermination()
    return _by_number(current_results(spark, f"{root}/current").drop("stored_at", "batch_id", "run"))


@register("analyze_stream", FLAGSHIP_SQL, "fx_grid")
def analyze_stream(spark, folder):
    """The flagship over a stream of files of the embeddings, one to a batch, stored batch by batch."""
    root = shared_folder(spark, "stream")
    rows = table(spark, folder, "embeddings")
    rows.repartition(3, "vec_id").write.parquet(f"{root}/arriving")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/arriving")

    def analyze(batch: DataFrame) -> DataFrame:
        level = "transform(embedding, e -> cast(floor((cast(e as double) + 1e0) * 64e0) as int))"
        images = batch.selectExpr("vec_id", "label", f"{level} as grid", "8 as width")
        return focus_from_grids(with_grid_regions(images))

    query = run_stream(arriving, analyze, f"{root}/results", f"{root}/checkpoint")
    query.awaitTermination()
    return tidy(stored_results(spark, f"{root}/results", "vec_id"))


@register("progress", """with n as (select count(*) as n, count(*) filter (vec_id % 4 = 0) as later from embeddings)
    select 'before' as step, 0e0 as share from n union all select 'all but later ones', round(n / (n + later), 6) from n
    union all select 'without those that are gone', 1e0 from n union all select 'counted', cast(n as double) from n""")
def progress(spark, folder):
    """How far a stream is by a listing, before its first batch, with files to come and with files that are gone; and what it counted itself."""
    root = shared_folder(spark, "progress")
    rows, sink = table(spark, folder, "embeddings").select("vec_id"), f"{root}/results"
    rows.repartition(3, "vec_id").write.parquet(f"{root}/arriving")
    shares = [("before", share_done(spark, sink, rows, "vec_id"))]
    arriving = spark.readStream.schema("vec_id bigint").option("maxFilesPerTrigger", 1).parquet(f"{root}/arriving")
    run_stream(arriving, lambda batch: batch, sink, f"{root}/checkpoint").awaitTermination()
    later = rows.where("vec_id % 4 = 0").selectExpr("-1 - vec_id as vec_id")
    shares.append(("all but later ones", share_done(spark, sink, rows.union(later), "vec_id")))
    shares.append(("without those that are gone", share_done(spark, sink, rows.where("vec_id % 2 = 0"), "vec_id")))
    shares.append(("counted", float(batch_counts(spark, sink).agg(F.sum("files")).first()[0])))
    return tidy(spark.createDataFrame(shares, "step string, share double"))


def bright_area():
    """A stand-in for a model: the box around all pixels brighter than a threshold."""

    def detect(g):
        import numpy as np

        ys, xs = np.nonzero(g > 76)
        if not len(ys):
            return []
        h, w = g.shape
        x0, y0 = xs.min(), ys.min()
        box = (x0 / w, y0 / h, (xs.max() + 1 - x0) / w, (ys.max() + 1 - y0) / h)
        return [("bright", len(ys) / g.size, box, [], None)]

    return detect


BRIGHT_SQL = f"""with b as (select vec_id, count(*) as n, min(x) as x0, max(x) + 1 as x1, min(y) as y0, max(y) + 1 as y1
      from fx_grid where g > 76 group by vec_id)
    select vec_id, 0 as ord, 'bright' as label, {r6('cast(n / 64e0 as float)', 'confidence')}, x0 / 8e0 as box_x, y0 / 8e0 as box_y,
      (x1 - x0) / 8e0 as box_w, (y1 - y0) / 8e0 as box_h from b"""


@register("detect_with", BRIGHT_SQL, "fx_grid")
def detect_with(spark, folder):
    found = run_detector(buffers(spark, folder), bright_area, "vec_id")
    return tidy(found.select("vec_id", "ord", "label", "confidence", "box"))


def bright_areas():
    """The same for a batch of squares, of which an image fills the upper left 8 x 8 pixels."""

    def predict(squares):
        import numpy as np

        found = []
        for g in squares:
            ys, xs = np.nonzero(np.round(g * 255) > 76)
            found.append([[0, len(ys) / 64, xs.min(), ys.min(), xs.max() + 1 - xs.min(), ys.max() + 1 - ys.min()]] if len(ys) else [])
        return found

    return predict


@register("detect_in_batches", BRIGHT_SQL, "fx_grid")
def detect_in_batches(spark, folder):
    found = run_in_batches(buffers(spark, folder), bright_areas, ["bright"], side=16, key="vec_id")
    return tidy(found.select("vec_id", "ord", "label", "confidence", "box"))
