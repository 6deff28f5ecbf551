"""Inputs for the registered queries, derived from the given tables.

Each view is a base table and one SQL expression per column, written so that Spark and DuckDB read
the same text. Nothing is filtered or capped: every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "fx_catalog": ("pages", {
        "path": """concat('/card/DCIM/', cast(100 + page_id % 3 as string), '/',
            case page_id % 4 when 0 then '_MG_' when 1 then 'IMG_' when 2 then 'DSC_' else '.hid_' end,
            cast(page_id as string),
            case page_id % 6 when 0 then '.CR3' when 1 then '.cr3' when 2 then '.NEF' when 3 then '.jpg'
                when 4 then '.Dng' else '.txt' end)""",
        "size": "cast(length(html) * (page_id % 9 + 1) * (page_id % 9 + 1) * (page_id % 5 * 40 + 1) as bigint)",
        "mday": "case when page_id % 7 = 0 then null else page_id % 11 end",
    }),
    "fx_detections": ("events", {
        "image_id": "user_id",
        "ord": "event_id",
        "label": """case event_type when 'click' then 'bird' when 'view' then 'person'
            when 'purchase' then 'kite' when 'error' then 'bowl' else 'cat' end""",
        "confidence": "cast(value / (value + 20e0) as float)",
        "x": "(event_id % 50) / 100e0",
        "y": "(event_id % 40) / 100e0",
        "w": "(event_id % 7 + 1) / 20e0",
        "h": "(event_id % 5 + 1) / 20e0",
    }),
    # idx orders the points of an image; it needs no window over the image.
    "fx_rects": ("lineitem", {
        "image_id": "l_orderkey",
        "kind": "l_linenumber",
        "idx": "l_linenumber * 100000000000 + l_partkey",
        "x": "l_quantity / 100e0",
        "y": "l_discount * 8e0",
        "w": "(l_partkey % 20 + 1) / 100e0",
        "h": "(l_suppkey % 25 + 1) / 80e0",
        "in_focus": "l_returnflag = 'R'",
        "selected": "l_linestatus = 'O'",
        "precise": "l_partkey % 2 = 0",
    }),
    "fx_meta": ("events", {
        "event_id": "event_id",
        "doc": """concat('{"exif":{"src":', props, ',"kind":"', event_type, '"},"user":',
            cast(user_id as string), ',"tags":[1,2],"gps":{}}')""",
    }),
    "fx_af": ("orders", {
        "image_id": "o_orderkey",
        "tag": "16403",
        "num": "cast(o_custkey % 4 as int)",
        "img_w": "case when o_orderkey % 5 = 0 then 0 else 6960 end",
        "h0": "cast(o_orderkey % 200 as int)",
        "x0": "cast(o_orderkey % 900 as int) - 450",
        "y0": "cast(o_custkey % 700 as int) - 350",
        "m0": "cast(o_orderkey % 8 as int)",
        "m1": "cast(o_custkey % 8 as int)",
    }),
}

# One prefixed payload of three points per order; every fifth is a stub with no image width.
AF_VALUES = [
    "2000", "0", "3", "num", "6960", "4640", "img_w", "4640",
    "163", "h0", "90", "163", "120", "90",
    "x0", "10", "-30", "y0", "44", "5",
    "m0", "m1",
]
# The same order in the older layout: two points, vertical axis upwards.
AF_OLD_VALUES = ["2", "2", "6960", "4640", "6960", "4640", "348", "300", "348", "h0", "x0", "12", "y0", "-9", "m1", "m0"]

RESULTS_SQL = """
select d.doc_id, concat(d.source, '/', d.lang, cast(d.doc_id as string)) as name,
  case when l.quality is null then 'Not Analyzed' when l.quality = 1 and l.toxic = 0 then 'Sharp'
       when l.quality = 1 then 'Slightly Blurry' else 'Blurry' end as status,
  case when l.quality is null then 0e0 else (d.n_chars % 1000) / 1000e0 end as score, d.n_chars as size
from documents d left join labels l on d.doc_id = l.doc_id"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    base, columns = VIEWS[name]
    return table(spark, folder, base).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def results_view(spark: SparkSession, folder: str) -> DataFrame:
    """``fx_results``: analysed files from documents and their labels."""
    d, label = table(spark, folder, "documents"), table(spark, folder, "labels")
    quality, toxic = F.col("quality"), F.col("toxic")
    status = (
        F.when(quality.isNull(), "Not Analyzed").when((quality == 1) & (toxic == 0), "Sharp")
        .when(quality == 1, "Slightly Blurry").otherwise("Blurry")
    )
    score = F.when(quality.isNull(), 0.0).otherwise((F.col("n_chars") % 1000) / 1000.0)
    return d.select("doc_id", "source", "lang", "n_chars").join(label, "doc_id", "left").select(
        "doc_id",
        F.concat("source", F.lit("/"), "lang", F.col("doc_id").cast("string")).alias("name"),
        status.alias("status"),
        score.alias("score"),
        F.col("n_chars").alias("size"),
    )


def grids(spark: SparkSession, folder: str) -> DataFrame:
    """Each 64-float embedding as an 8x8 gray image: ``(vec_id, label, grid, width)``."""
    level = "transform(embedding, e -> cast(floor((cast(e as double) + 1e0) * 64e0) as int))"
    return table(spark, folder, "embeddings").selectExpr("vec_id", "label", f"{level} as grid", "8 as width")


def anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Each embedding as one anchor of a detector's output: ``(image_id, anchor, features)``."""
    level = """transform(embedding, e ->
        cast(least(greatest((cast(e as double) + 35e-2) * 14e-1, 0e0), 1e0) as float))"""
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id div 50 as image_id", "vec_id as anchor", f"{level} as features"
    )


def _payload(values: list[str]) -> str:
    return f"array({', '.join(values)})"


def af_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """``(image_id, new, old)``: both payloads of every order, the greatest of each if its number is repeated.

    Orders are dealt out before payloads are built from them: rows are small on the way, and what follows keeps all cores busy.
    """
    orders = spread(view(spark, folder, "fx_af"), "image_id")
    both = orders.selectExpr("image_id", f"{_payload(AF_VALUES)} as new", f"{_payload(AF_OLD_VALUES)} as old")
    return both.groupBy("image_id").agg(F.max("new").alias("new"), F.max("old").alias("old"))


def af_tags(spark: SparkSession, folder: str) -> DataFrame:
    """``(image_id, tag, vals)``: the newer and the older payload of every order."""
    base, new, old = view(spark, folder, "fx_af"), _payload(AF_VALUES), _payload(AF_OLD_VALUES)
    return base.selectExpr("image_id", f"inline(array(struct(tag, {new} as vals), struct(38 as tag, {old} as vals)))")


# --- the same views as DuckDB text ---------------------------------------------------------------

def _duck_view(name: str) -> str:
    base, columns = VIEWS[name]
    return "select " + ", ".join(f"{e} as {c}" for c, e in columns.items()) + f" from {base}"


DUCK_VIEWS: dict[str, str] = {name: _duck_view(name) for name in VIEWS} | {
    "fx_results": RESULTS_SQL,
    "fx_grids": """select vec_id, label,
        list_transform(embedding, lambda e: cast(floor((cast(e as double) + 1e0) * 64e0) as int)) as grid
        from embeddings""",
    "fx_grid": """select vec_id, label, i % 8 as x, i // 8 as y,
        cast(floor((cast(embedding[i + 1] as double) + 1e0) * 64e0) as int) as g
        from (select vec_id, label, embedding, unnest(range(0, 64)) as i from embeddings)""",
    "fx_anchors": """select vec_id // 50 as image_id, vec_id as anchor,
        list_transform(embedding, lambda e:
            cast(least(greatest((cast(e as double) + 35e-2) * 14e-1, 0e0), 1e0) as float)) as features
        from embeddings""",
    "fx_tags": f"""select image_id, tag, [{', '.join(AF_VALUES)}] as vals from ({_duck_view('fx_af')})
        union all select image_id, 38 as tag, [{', '.join(AF_OLD_VALUES)}] as vals from ({_duck_view('fx_af')})""",
}
