"""Rectangle arithmetic on Columns.

A rectangle is ``struct<x, y, w, h>`` of doubles in 0..1 with its origin at the top left. A missing
rectangle is a null struct, and every function here returns null for it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RECT = "struct<x:double,y:double,w:double,h:double>"


def rect(x, y, w, h, present: Column | None = None) -> Column:
    """Struct from four numeric columns or names; null where ``present`` is false.

    Without ``present`` it is null if any side is null.
    """
    sides = [F.col(c) if isinstance(c, str) else c for c in (x, y, w, h)]
    known = sum(sides[1:], sides[0]).isNotNull() if present is None else present
    return F.when(known, F.struct(*[c.alias(k) for k, c in zip("xywh", sides)])).cast(RECT)


def unit_rect() -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in (("x", 0.0), ("y", 0.0), ("w", 1.0), ("h", 1.0))])


def null_rect() -> Column:
    return F.lit(None).cast(RECT)


def rect_area(r: Column) -> Column:
    return r["w"] * r["h"]


def flip_rect(r: Column) -> Column:
    """Bottom-left origin to top-left origin."""
    return rect(r["x"], 1.0 - (r["y"] + r["h"]), r["w"], r["h"], r.isNotNull())


def clamp_rect(r: Column, bounds: Column | None = None) -> Column:
    """Part of ``r`` inside ``bounds``; a rectangle outside collapses onto the nearest edge."""
    b = unit_rect() if bounds is None else bounds

    def side(o: str, s: str) -> tuple[Column, Column]:
        far = b[o] + b[s]
        start = F.greatest(b[o], F.least(r[o], far))
        return start, F.greatest(F.least(r[o] + r[s], far) - start, F.lit(0.0))

    (x, w), (y, h) = side("x", "w"), side("y", "h")
    return rect(x, y, w, h, r.isNotNull())


def rect_intersect(a: Column, b: Column) -> Column:
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - x
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - y
    # greatest/least skip nulls, so presence is tested on the inputs.
    return rect(x, y, w, h, a.isNotNull() & b.isNotNull() & (w >= 0) & (h >= 0))


def expand_rect(r: Column) -> Column:
    """Twice the width and height around the same centre, kept inside the image."""
    return clamp_rect(rect(r["x"] - r["w"] * 0.5, r["y"] - r["h"] * 0.5, r["w"] * 2.0, r["h"] * 2.0, r.isNotNull()))


def head_from_body(body: Column) -> Column:
    """Top 30 % of a body box."""
    return rect(body["x"], body["y"], body["w"], body["h"] * 0.3, body.isNotNull())


def padded_extent(min_x: Column, max_x: Column, min_y: Column, max_y: Column, pad: float) -> Column:
    """Bounding box grown by ``pad``, cut at the image edge, at least 0.01 wide and high."""

    def side(lo: Column, hi: Column) -> tuple[Column, Column]:
        start = F.greatest(F.lit(0.0), lo - pad)
        return start, F.greatest(F.least(1.0 - start, (hi - lo) + pad * 2), F.lit(0.01))

    (x, w), (y, h) = side(min_x, max_x), side(min_y, max_y)
    return rect(x, y, w, h, min_x.isNotNull() & min_y.isNotNull())


def detector_extent(min_x: Column, max_x: Column, min_y: Column, max_y: Column, pad: float) -> Column:
    """The detector's variant: width capped at 1 rather than at the image edge, and no floor."""

    def side(lo: Column, hi: Column) -> tuple[Column, Column]:
        return F.greatest(F.lit(0.0), lo - pad), F.least(F.lit(1.0), (hi - lo) + pad * 2)

    (x, w), (y, h) = side(min_x, max_x), side(min_y, max_y)
    return rect(x, y, w, h, min_x.isNotNull() & min_y.isNotNull())


def _extent(points: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = points["x"], points["y"]  # array<struct>.field is array<field>
    return F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)


def padded_bbox(points: Column, pad: float) -> Column:
    """``padded_extent`` of an array of points; null for an empty array."""
    return padded_extent(*_extent(points), pad)


def eye_box(eyes: Column) -> Column:
    """Detector eye region: needs two points and more than 0.005 on each side."""
    box = detector_extent(*_extent(eyes), 0.05)
    return F.when((F.size(eyes) >= 2) & (box["w"] > 0.005) & (box["h"] > 0.005), box)


def head_box(eyes: Column, nose: Column, body: Column) -> Column:
    """Detector head region: around eyes and nose if two points exist, else the top of the body."""
    points = F.filter(F.concat(F.coalesce(eyes, F.array()), F.array(nose)), lambda p: p.isNotNull())
    return F.when(F.size(points) >= 2, detector_extent(*_extent(points), 0.04)).otherwise(head_from_body(body))


def crop_window(r: Column, width: Column, height: Column) -> Column:
    """Pixel window ``struct<x0, y0, x1, y1>`` (far edge exclusive), null without overlap.

    The origin is rounded down and the far edge up.
    """

    def side(o: str, s: str, n: Column) -> tuple[Column, Column]:
        lo, hi = F.floor(r[o] * n), F.ceil(r[o] * n + r[s] * n)
        return F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, n).cast("int")

    (x0, x1), (y0, y1) = side("x", "w", width), side("y", "h", height)
    window = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return F.when(r.isNotNull() & (x1 > x0) & (y1 > y0), window)


def fit_rect(r, image_w, image_h, frame_w, frame_h, scale=1.0, offset_x=0.0, offset_y=0.0) -> Column:
    """A normalised rectangle in the coordinates of a frame the image is fitted into.

    The image keeps its aspect ratio and is centred, then zoomed about the centre and moved.
    """
    iw, ih, fw, fh, zoom, dx, dy = [
        c if isinstance(c, Column) else F.lit(float(c))
        for c in (image_w, image_h, frame_w, frame_h, scale, offset_x, offset_y)
    ]
    aspect = iw / ih
    wide = aspect > fw / fh
    shown_w = F.when(wide, fw).otherwise(fh * aspect)
    shown_h = F.when(wide, fw / aspect).otherwise(fh)

    def side(o: str, s: str, shown: Column, frame: Column, move: Column) -> tuple[Column, Column]:
        centre = (frame - shown) / 2.0 + shown / 2.0
        zoomed = shown * zoom
        return centre - zoomed / 2.0 + move + r[o] * zoomed, r[s] * zoomed

    (x, w), (y, h) = side("x", "w", shown_w, fw, dx), side("y", "h", shown_h, fh, dy)
    return rect(x, y, w, h)
