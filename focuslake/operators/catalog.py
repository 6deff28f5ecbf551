"""Browsing and updating the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions.files import file_ext, file_name, format_size, is_raw_name
from ..functions.geometry import RECT
from ..functions.scoring import is_rejected


def raw_files(listing: DataFrame) -> DataFrame:
    """Rows of a listing that are raw files and not hidden."""
    return listing.filter(is_raw_name(F.col("path")))


def union_listings(*listings: DataFrame) -> DataFrame:
    """Several roots one after the other: no sorting and no removal of duplicates."""
    out = listings[0]
    for more in listings[1:]:
        out = out.unionByName(more)
    return out


def catalog_columns(listing: DataFrame) -> DataFrame:
    """Adds ``name``, ``ext`` and ``size_text``, and takes a missing size as 0."""
    size = F.coalesce(F.col("size"), F.lit(0)).cast("bigint")
    path = F.col("path")
    return (
        listing.withColumn("name", file_name(path)).withColumn("ext", file_ext(path))
        .withColumn("size", size).withColumn("size_text", format_size(F.col("size")))
    )


def contains_text(text: Column, query: str) -> Column:
    return F.contains(F.lower(text), F.lit(query.lower()))


def contains_in(text: Column, query: str, collation: str) -> Column:
    """Substring search by a collation, e.g. ``UNICODE_CI`` (letters of any case) or ``UNICODE_CI_AI`` (any accent as well)."""
    return F.contains(F.collate(text, collation), F.collate(F.lit(query), collation))


def search_name(files: DataFrame, query: str, collation: str | None = None) -> DataFrame:
    """Case-insensitive search in names; an empty query keeps all.

    With a collation letters are compared as in its locale, e.g. ``tr_CI``: two spellings of one accented letter are the same then.
    """
    if not query:
        return files
    return files.filter(contains_in(F.col("name"), query, collation) if collation else contains_text(F.col("name"), query))


def filter_mode(files: DataFrame, mode: str = "All") -> DataFrame:
    """``All``, ``Sharp``, ``Rejected`` or ``Unanalyzed``."""
    status = F.col("status")
    wanted = {
        "All": None,
        "Sharp": status == C.SHARP,
        "Rejected": is_rejected(status),
        "Unanalyzed": status == C.NOT_ANALYZED,
    }[mode]
    return files if wanted is None else files.filter(wanted)


def has_label(files: DataFrame) -> DataFrame:
    """An empty label passes: it fails later, when it is written."""
    return files.filter(F.col("label").isNotNull())


def sort_catalog(files: DataFrame, order: str = "Name", key: str = "path") -> DataFrame:
    """``Name`` ascending; ``Date``, ``Size`` or ``Sharpness`` descending. Files without a date come last."""
    first = {
        "Name": F.col("name").asc(),
        "Date": F.desc_nulls_last("mtime"),
        "Size": F.desc("size"),
        "Sharpness": F.desc("score"),
    }[order]
    return files.orderBy(first, F.col(key).asc())


def browse(
    files: DataFrame, query: str = "", mode: str = "All", order: str = "Name", key: str = "path", collation: str | None = None
) -> DataFrame:
    """Search, then filter, then sort."""
    return sort_catalog(filter_mode(search_name(files, query, collation), mode), order, key)


def status_summary(files: DataFrame) -> DataFrame:
    status = F.col("status")
    return files.agg(
        F.count_if(status == C.SHARP).alias("sharp"),
        F.count_if(is_rejected(status)).alias("rejected"),
        F.count(F.lit(1)).alias("total"),
    )


def any_analyzed(files: DataFrame) -> DataFrame:
    found = F.bool_or(F.col("status") != C.NOT_ANALYZED)
    return files.agg(F.coalesce(found, F.lit(False)).alias("any_analyzed"))


# What a file shows before it is analysed, and after an analysis that could not decode it.
RESULT_DEFAULTS = {
    "status": ("string", C.NOT_ANALYZED),
    "score": ("double", 0.0),
    "region": ("string", C.FULL_IMAGE),
    "blur_type": ("string", C.UNKNOWN_BLUR),
    "size_conf": ("double", 0.0),
    "label": ("string", None),
    "rect": (RECT, None),
    "det_conf": ("float", None),
}


def latest_results(results: DataFrame, run: str | list[str], key: str = "path") -> DataFrame:
    """One row per file: that of its latest run, reduced on the map side first.

    ``run`` may be several columns, compared in turn. Of rows that are equal in all of them the same one
    is kept every time, chosen by a hash of the row.
    """
    rest = [c for c in results.columns if c != key]
    order = F.struct(*([run] if isinstance(run, str) else run), F.xxhash64(*rest))
    last = F.max_by(F.struct(*rest), order).alias("_last")
    return results.groupBy(key).agg(last).select(key, "_last.*")


def apply_results(
    catalog: DataFrame, results: DataFrame, key: str = "path", run: str | list[str] | None = None
) -> DataFrame:
    """Catalog with its results; files without one keep the defaults, unknown files are ignored."""
    latest = latest_results(results, run, key) if run else results
    fields = [c for c in RESULT_DEFAULTS if c in latest.columns]
    joined = catalog.drop(*fields).join(latest.select(key, *fields), key, "left")
    for name in fields:
        kind, value = RESULT_DEFAULTS[name]
        if value is not None:
            joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(value).cast(kind)))
    return joined


def pending(catalog: DataFrame, results: DataFrame, key: str = "path") -> DataFrame:
    """Files of a new listing that no run has analysed yet."""
    return catalog.join(results.select(key).distinct(), key, "left_anti")
