"""Focus points: decoding of the camera's arrays, preference, and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions.binding import bind
from ..functions.files import af_tier
from ..functions.geometry import rect
from ..sources.headers import tag_array

PRECISE_TAG = C.AF_TAGS[0]


def _word(vals: Column, i: Column | int) -> Column:
    """Value at a 0-based place, 0 beyond the end."""
    return F.coalesce(F.get(vals, F.lit(i) if isinstance(i, int) else i), F.lit(0)).cast("int")


def _start(vals: Column) -> Column:
    """Newer cameras put two words in front of the counts; they show as a byte count that is too
    large for a point count, followed by plausible counts.
    """
    prefixed = (
        (_word(vals, 0) > 1000)
        & (_word(vals, 2) > 0)
        & (_word(vals, 2) < 1000)
        & (_word(vals, 3) >= 0)
        & (_word(vals, 3) <= _word(vals, 2))
    )
    return F.when(prefixed, 2).otherwise(0)


def _usable(vals: Column, num: Column, w: Column, h: Column) -> Column:
    return vals.isNotNull() & (F.size(vals) >= 6) & (num > 0) & (num <= C.MAX_AF_POINTS) & (w > 0) & (h > 0)


def af_layout(vals: Column) -> Column:
    """``struct<start, num, valid, w, h>``, null for a payload that holds no usable points."""

    def read(start: Column) -> Column:
        places = {"num": 0, "valid": 1, "w": 4, "h": 5}
        return F.struct(start.alias("start"), *[_word(vals, start + i).alias(k) for k, i in places.items()])

    return bind(
        bind(_start(vals), read), lambda l: F.when(_usable(vals, l["num"], l["w"], l["h"]), l)
    )


def mask_bit(vals: Column, base: Column, i: Column) -> Column:
    """Bit ``i`` of a mask of 16-bit words that starts at ``base``; false beyond the end."""
    word = F.get(vals, base + F.floor(i / 16).cast("int")).cast("int")
    return F.coalesce(F.getbit(word, i % 16) == 1, F.lit(False))


def bitmask_flags(vals: Column, layout: Column) -> Column:
    """``array<struct<in_focus, selected>>``, one entry per declared point."""
    focus, selected = _mask_bases(layout)
    return F.transform(
        F.sequence(F.lit(0), layout["num"] - 1),
        lambda i: F.struct(
            mask_bit(vals, focus, i).alias("in_focus"), mask_bit(vals, selected, i).alias("selected")
        ),
    )


def _mask_bases(layout: Column) -> tuple[Column, Column]:
    focus = layout["start"] + 6 + layout["num"] * 4
    return focus, focus + _mask_words(layout["num"])


def _mask_words(num: Column) -> Column:
    return F.floor((num + 15) / 16).cast("int")


def _rect(w: Column, h: Column, x: Column, y: Column, w_img: Column, h_img: Column, y_down: Column) -> Column:
    """A point's rectangle from pixel sizes and a position relative to the centre."""
    unit, zero = F.lit(1.0), F.lit(0.0)
    nw, nh, rise = w / w_img, h / h_img, y / h_img
    cy = F.when(y_down, 0.5 + rise).otherwise(0.5 - rise)
    return rect(
        F.greatest(zero, F.least(unit, 0.5 + x / w_img - nw / 2)),
        F.greatest(zero, F.least(unit, cy - nh / 2)),
        F.least(nw, unit),
        F.least(nh, unit),
    )


def _last_point(num: Column, valid: Column) -> Column:
    """A payload may claim more valid points than it declares; those have no mask and are left out."""
    return F.least(F.greatest(F.lit(1), valid), num) - 1


def _real(vals: Column, base: Column, num: Column, i: Column) -> Column:
    """The point has a width and a height."""
    return (_word(vals, base + i) > 0) & (_word(vals, base + num + i) > 0)


def has_points(vals: Column) -> Column:
    """Whether a payload decodes to at least one point."""

    def any_real(l: Column) -> Column:
        places = F.sequence(F.lit(0), _last_point(l["num"], l["valid"]))
        return F.exists(places, lambda i: _real(vals, l["start"] + 6, l["num"], i))

    return F.coalesce(bind(af_layout(vals), any_real), F.lit(False))


def af_points_array(vals: Column, layout: Column, y_down: Column) -> Column:
    """Decoded points as ``array<struct<idx, rect, in_focus, selected>>``, all inside one row."""

    def decode(l: Column) -> Column:
        num, base = l["num"], l["start"] + 6
        focus, selected = _mask_bases(l)

        def point(i: Column) -> Column:
            w, h, x, y = [_word(vals, base + num * k + i) for k in range(4)]
            return F.struct(
                i.alias("idx"),
                _rect(w, h, x, y, l["w"], l["h"], y_down).alias("rect"),
                mask_bit(vals, focus, i).alias("in_focus"),
                mask_bit(vals, selected, i).alias("selected"),
            )

        places = F.sequence(F.lit(0), _last_point(num, l["valid"]))
        return F.when(l.isNotNull(), F.transform(F.filter(places, lambda i: _real(vals, base, num, i)), point))

    return bind(layout, decode)


def af_decode(tags: DataFrame, image: str = "path") -> DataFrame:
    """``(path, tag, precise, idx, rect, in_focus, selected)``: every real point of every payload.

    Points become rows first and are decoded after that, with plain expressions on plain columns.
    """
    vals, num, valid = F.col("vals"), F.col("_num"), F.col("_valid")
    base = F.col("_start") + 6
    usable = (
        tags.select(image, "tag", "vals", _start(vals).alias("_start"))
        .select("*", *[_word(vals, F.col("_start") + i).alias(k) for k, i in
                       (("_num", 0), ("_valid", 1), ("_w", 4), ("_h", 5))])
        .filter(_usable(vals, num, F.col("_w"), F.col("_h")))
    )
    spread = usable.withColumn("idx", F.explode(F.sequence(F.lit(0), _last_point(num, valid))))
    sizes = ("_pw", "_ph", "_px", "_py")
    words = spread.select("*", *[_word(vals, base + num * k + F.col("idx")).alias(c) for k, c in enumerate(sizes)])
    real = words.filter((F.col("_pw") > 0) & (F.col("_ph") > 0))
    focus = base + num * 4
    box = _rect(*[F.col(c) for c in sizes], F.col("_w"), F.col("_h"), F.col("tag") == PRECISE_TAG)
    return real.select(
        image, "tag", (F.col("tag") == PRECISE_TAG).alias("precise"), "idx", box.alias("rect"),
        mask_bit(vals, focus, F.col("idx")).alias("in_focus"),
        mask_bit(vals, focus + _mask_words(num), F.col("idx")).alias("selected"),
    )


def tag_priority(tags: DataFrame, image: str = "path") -> DataFrame:
    """``(path, tag, points, precise)``: per file the first tag, in order of preference, that decodes.

    A payload without points does not count, so a stub falls through to the next tag and never moves. Of a repeated tag
    the least payload counts.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in C.AF_TAGS]), F.col("tag"))
    # Payloads are moved as they are, and compared only where a tag is repeated; the one that wins is decoded.
    first = F.min(F.struct(rank.alias("_rank"), "tag", "vals")).alias("_first")
    precise = F.col("tag") == PRECISE_TAG
    return (
        tags.where((rank > 0) & has_points(F.col("vals"))).groupBy(image).agg(first).select(image, "_first.tag", "_first.vals")
        .select(image, "tag", af_points_array(F.col("vals"), af_layout(F.col("vals")), precise).alias("points"),
                precise.alias("precise"))
    )


def preferred_points(points: Column) -> Column:
    """Points in focus; without any, the selected ones; without those, all."""
    focus, selected = F.filter(points, lambda p: p["in_focus"]), F.filter(points, lambda p: p["selected"])
    return F.when(F.size(focus) > 0, focus).when(F.size(selected) > 0, selected).otherwise(points)


def points_union(points: Column) -> Column:
    """Bounding box of an array of points, null for none."""

    def box(rects: Column) -> Column:
        x0, y0 = F.array_min(rects["x"]), F.array_min(rects["y"])
        x1 = F.array_max(F.transform(rects, lambda r: r["x"] + r["w"]))
        y1 = F.array_max(F.transform(rects, lambda r: r["y"] + r["h"]))
        return rect(x0, y0, x1 - x0, y1 - y0)

    return bind(points["rect"], box)


def af_rects(tags: DataFrame, image: str = "path") -> DataFrame:
    """``(path, af_rect)`` straight from tag payloads: decode, prefer, unite."""
    chosen = tag_priority(tags, image).withColumn("points", preferred_points(F.col("points")))
    return chosen.select(image, points_union(F.col("points")).alias("af_rect"))


def header_af_rects(headers: DataFrame, key: str = "path") -> DataFrame:
    """``(path, af_rect)`` straight from file headers ``(path, content)``: all tags of a file are in its row, nothing is shuffled."""
    first = F.slice(F.filter("_tags", lambda t: has_points(t["vals"])), 1, 1)
    found = headers.select(key, tag_array(F.col("content")).alias("_tags"))
    # Rows come from a generator: a filter on a column would be moved before it and work out all of the column again.
    chosen = found.select(key, F.inline_outer(first)).filter(F.col("tag").isNotNull())
    vals, precise = F.col("vals"), F.col("tag") == PRECISE_TAG
    points = af_points_array(vals, af_layout(vals), precise)
    return chosen.select(key, bind(points, lambda p: points_union(preferred_points(p))).alias("af_rect"))


def prefer_tier(points: DataFrame, image: str = "image_id") -> DataFrame:
    """Row form of ``preferred_points``: the rows of each image's best tier."""
    tiered = points.withColumn("tier", af_tier(F.col("in_focus"), F.col("selected")))
    best = tiered.groupBy(image).agg(F.min("tier").alias("tier"))
    return tiered.join(best, [image, "tier"], "left_semi")


def _union_of(wanted: Column | None = None) -> Column:
    r = F.col("rect")

    def side(agg, c: Column) -> Column:
        return agg(c if wanted is None else F.when(wanted, c))

    x0, y0 = side(F.min, r["x"]), side(F.min, r["y"])
    x1, y1 = side(F.max, r["x"] + r["w"]), side(F.max, r["y"] + r["h"])
    return rect(x0, y0, x1 - x0, y1 - y0)


def rect_union(rects: DataFrame, image: str = "image_id") -> DataFrame:
    """``(image_id, rect)``: bounding box of all rectangles of an image."""
    return rects.groupBy(image).agg(_union_of().alias("rect"))


def preferred_union(points: DataFrame, image: str = "image_id", out: str = "af_rect") -> DataFrame:
    """``(image_id, af_rect)``: ``rect_union`` of ``prefer_tier`` in a single aggregation.

    All tiers are reduced side by side and the best non-empty one is picked afterwards, so no row
    has to be joined back.
    """
    tier = af_tier(F.col("in_focus"), F.col("selected"))
    return points.groupBy(image).agg(
        F.coalesce(*[_union_of(tier == t) for t in range(3)]).alias(out)
    )


def af_counts(points: DataFrame, image: str = "image_id", order: str = "idx") -> DataFrame:
    """Points, points in focus, selected points, and whether the first point is precise."""
    return points.groupBy(image).agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if("in_focus").alias("in_focus"),
        F.count_if("selected").alias("selected"),
        F.min_by("precise", order).alias("precise"),
    )
