"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..views import DUCK_VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SIDES = ["x", "y", "w", "h"]


def register(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """``sql`` may name the given tables and the listed views."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return query

    return add


def with_views(sql: str, *views: str) -> str:
    parts = [f"{v} as ({DUCK_VIEWS[v]})" for v in views]
    body = sql.strip()
    if body.startswith("with "):
        return "with " + ", ".join([*parts, body[5:]])
    return ("with " + ", ".join(parts) + " " if parts else "") + body


def tidy(df: DataFrame) -> DataFrame:
    """Flat columns for comparison: rectangles as four columns, fractions rounded to 6 places."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, StructType):
            out += [_rounded(c[k.name]).alias(f"{f.name}_{k.name}") for k in f.dataType.fields]
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(_rounded(c).alias(f.name))
        else:
            out.append(c)
    return df.select(out)


def _rounded(c):
    return F.round(c.cast("double"), 6) + F.lit(0.0)


# --- SQL text for DuckDB -------------------------------------------------------------------------

def r6(expr: str, name: str) -> str:
    return f"round(cast({expr} as double), 6) + 0e0 as {name}"


def rect_sql(x: str, y: str, w: str, h: str) -> str:
    return "{'x': " + x + ", 'y': " + y + ", 'w': " + w + ", 'h': " + h + "}"


def flat_sql(rect: str, name: str) -> str:
    return ", ".join(r6(f"{rect}.{k}", f"{name}_{k}") for k in SIDES)


def clamp_sql(r: str) -> str:
    def start(o: str) -> str:
        return f"greatest(0e0, least({r}.{o}, 1e0))"

    def side(o: str, s: str) -> str:
        return f"greatest(least({r}.{o} + {r}.{s}, 1e0) - {start(o)}, 0e0)"

    return f"case when {r} is not null then {rect_sql(start('x'), start('y'), side('x', 'w'), side('y', 'h'))} end"


def intersect_sql(a: str, b: str) -> str:
    x, y = f"greatest({a}.x, {b}.x)", f"greatest({a}.y, {b}.y)"
    w = f"(least({a}.x + {a}.w, {b}.x + {b}.w) - {x})"
    h = f"(least({a}.y + {a}.h, {b}.y + {b}.h) - {y})"
    return f"""case when {a} is not null and {b} is not null and {w} >= 0 and {h} >= 0
        then {rect_sql(x, y, w, h)} end"""


def expand_sql(r: str) -> str:
    return rect_sql(f"{r}.x - {r}.w * 5e-1", f"{r}.y - {r}.h * 5e-1", f"{r}.w * 2e0", f"{r}.h * 2e0")


def padded_sql(x0: str, x1: str, y0: str, y1: str, pad: str) -> str:
    """Cut at the image edge, at least 0.01."""

    def start(lo: str) -> str:
        return f"greatest(0e0, {lo} - {pad})"

    def side(lo: str, hi: str) -> str:
        return f"greatest(least(1e0 - {start(lo)}, ({hi} - {lo}) + {pad} * 2), 1e-2)"

    return f"""case when {x0} is not null then
        {rect_sql(start(x0), start(y0), side(x0, x1), side(y0, y1))} end"""


def size_conf_sql(area: str) -> str:
    return f"""case when {area} is null then 7e-1 when {area} >= 1e-2 then 1e0 when {area} < 2e-3 then 3e-1
        else 3e-1 + 7e-1 * ({area} - 2e-3) / 8e-3 end"""


EYE_REGIONS = "('Eyes (YOLO)', 'Animal Eyes', 'Human Eyes')"
HEAD_REGIONS = "('Head (YOLO)', 'Animal Head', 'Human Face')"
BODY_REGIONS = "('Body (YOLO)', 'Animal Body', 'AF Point', 'AF Point + Subject')"


def bound_sql(region: str, eyes: str, head: str, body: str, full: str) -> str:
    return f"""case when {region} in {EYE_REGIONS} then {eyes} when {region} in {HEAD_REGIONS} then {head}
        when {region} in {BODY_REGIONS} then {body} else {full} end"""


def divisor_sql(region: str) -> str:
    return bound_sql(region, "2e2", "4e2", "7e2", "1e3")


def sharp_sql(region: str) -> str:
    return bound_sql(region, "55e-2", "6e-1", "62e-2", "65e-2")


def acceptable_sql(region: str) -> str:
    return bound_sql(region, "25e-2", "3e-1", "32e-2", "35e-2")


def status_sql(score: str, sharp: str, acceptable: str) -> str:
    return f"""case when {score} >= {sharp} then 'Sharp' when {score} >= {acceptable} then 'Slightly Blurry'
        else 'Blurry' end"""


def blur_sql(score: str, sharp: str, acceptable: str, vh: str, vv: str) -> str:
    return f"""case when {score} >= {sharp} then 'None'
        when greatest({vh}, {vv}) > 1e0 and least({vh}, {vv}) / greatest({vh}, {vv}) < 4e-1 then 'Motion Blur'
        when {score} < {acceptable} then 'Out of Focus' else 'Mixed' end"""
