"""Catalog columns: names, extensions, sizes, review notes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as C


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_ext(path: Column) -> Column:
    """Extension in upper case, empty if there is none."""
    return F.upper(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def plain_path(path: Column) -> Column:
    """Local paths without their scheme, so that ``/a``, ``file:/a`` and ``file:///a`` are the same."""
    return F.regexp_replace(path, r"^file:(//)?(?=/)", "")


def file_stem(path: Column) -> Column:
    """The plain path without its last extension: the same for a raw file, its preview and its sidecar."""
    return F.regexp_replace(plain_path(path), r"([^/])\.[^./]+$", "$1")


def has_raw_ext(path: Column) -> Column:
    return F.lower(file_ext(path)).isin(*C.RAW_EXTENSIONS)


def is_raw_name(path: Column) -> Column:
    """A raw-file extension and no hidden part in the path."""
    return has_raw_ext(path) & ~F.contains(path, F.lit("/."))


def format_size(size: Column) -> Column:
    """Decimal file size: KB without decimals, MB with one, GB with two. Integer arithmetic only."""

    def scaled(unit: int, decimals: int, name: str) -> Column:
        steps = F.floor((size + unit // 10**decimals // 2) / (unit // 10**decimals)).cast("bigint")
        if not decimals:
            return F.concat(steps.cast("string"), F.lit(f" {name}"))
        whole = F.floor(steps / 10**decimals).cast("bigint")
        rest = F.lpad((steps % 10**decimals).cast("string"), decimals, "0")
        return F.concat(whole.cast("string"), F.lit("."), rest, F.lit(f" {name}"))

    return (
        F.when(size == 0, "Zero KB")
        .when(size < 1000, F.concat(size.cast("string"), F.lit(" bytes")))
        .when(size < 1000**2, scaled(1000, 0, "KB"))
        .when(size < 1000**3, scaled(1000**2, 1, "MB"))
        .otherwise(scaled(1000**3, 2, "GB"))
    )


def review_note(status: Column, label: Column, det_conf: Column, blur: Column, size_conf: Column) -> Column:
    """``struct<provenance, blur, subject>``: what a reviewer is told about an analysed file."""
    analyzed = status != C.NOT_ANALYZED
    doubtful = analyzed & (status != C.SHARP)
    percent = (det_conf.cast("float") * F.lit(100).cast("float")).cast("int")
    provenance = F.when(
        analyzed & label.isNotNull(),
        F.coalesce(F.concat(F.lit("YOLO "), percent.cast("string"), F.lit("%")), F.lit("Vision")),
    )
    chip = F.when(doubtful & ~blur.isin(C.BLUR_NONE, C.UNKNOWN_BLUR), blur)
    subject = F.when(doubtful & (size_conf < 0.7), "Small subject")
    return F.struct(provenance.alias("provenance"), chip.alias("blur"), subject.alias("subject"))


def af_tier(in_focus: Column, selected: Column) -> Column:
    """0 for a point in focus, 1 for one that was only selected, 2 otherwise."""
    return F.when(in_focus, 0).when(selected, 1).otherwise(2)
