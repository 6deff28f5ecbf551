"""Focus-point payloads with known results, and containers built here byte by byte."""

import struct

import pytest
from pyspark.sql import functions as F

from focuslake.operators import afpoints as A
from focuslake.sources import headers as H

PRECISE, LEGACY, OLDEST = 0x4013, 0x0026, 0x0025
POINT = [2000, 0, 3, 1, 6960, 4640, 6960, 4640, 163, 0, 0, 163, 0, 0, -121, 0, 0, 405, 0, 0, 0, 1]
STUB = [3000, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0]
OLD = [3, 2, 6960, 4640, 6960, 4640, 348, 348, 0, 348, 348, 0, 10, -121, 0, 404, 404, 0, 0, 2]


def tags(spark, *rows):
    return spark.createDataFrame([("p", t, v) for t, v in rows], "path string, tag int, vals array<int>")


def test_precise_point(spark):
    (p,) = A.af_decode(tags(spark, (PRECISE, POINT))).collect()
    assert (p.idx, p.in_focus, p.selected, p.precise) == (0, False, True, True)
    assert tuple(p.rect) == pytest.approx((0.470905, 0.569720, 0.023420, 0.035129), abs=1e-6)
    assert p.rect.x + p.rect.w / 2 == pytest.approx(0.482615, abs=1e-6)
    assert p.rect.y + p.rect.h / 2 == pytest.approx(0.587284, abs=1e-6)


def test_stub_falls_back_to_the_legacy_tag(spark):
    (row,) = A.tag_priority(tags(spark, (PRECISE, STUB), (LEGACY, OLD))).collect()
    assert (row.tag, row.precise) == (LEGACY, False)
    (kept,) = A.tag_priority(tags(spark, (PRECISE, STUB), (LEGACY, OLD))).select(
        F.inline(A.preferred_points(F.col("points")))).collect()
    assert kept.idx == 1 and kept.rect.w == pytest.approx(0.05)
    assert kept.rect.y + kept.rect.h / 2 == pytest.approx(0.412931, abs=1e-6)


@pytest.mark.parametrize("order", [1, -1])
def test_priority_does_not_depend_on_order(spark, order):
    rows = [(PRECISE, POINT), (LEGACY, OLD), (OLDEST, OLD)][::order]
    assert A.tag_priority(tags(spark, *rows)).first().tag == PRECISE


@pytest.mark.parametrize("order", [1, -1])
def test_a_repeated_tag_does_not_depend_on_order(spark, order):
    other = [*OLD[:10], 348, 0, *OLD[12:]]
    df = tags(spark, *[(LEGACY, OLD), (LEGACY, other), (PRECISE, STUB)][::order])
    found, alone = (A.tag_priority(x).first() for x in (df, tags(spark, (LEGACY, min(OLD, other)))))
    assert found == alone


@pytest.mark.parametrize("vals", [
    None, [], [1, 1, 10, 10, 10], STUB,
    [0, 1, 10, 10, 10, 10, 5, 5, 0, 0], [1025, 1, 10, 10, 10, 10, 5, 5, 0, 0], [1, 1, 10, 10, -1, 10, 5, 5, 0, 0]])
def test_unusable_payloads(spark, vals):
    df = tags(spark, (LEGACY, vals))
    assert A.af_decode(df).count() == 0 and A.tag_priority(df).count() == 0 and A.af_rects(df).count() == 0


def test_more_valid_points_than_declared(spark):
    vals = [1, 5, 100, 100, 100, 100, 10, 10, 0, 0, 1]
    assert [p.idx for p in A.af_decode(tags(spark, (LEGACY, vals))).collect()] == [0]


def test_no_valid_point_still_reads_the_first(spark):
    vals = [2, 0, 100, 100, 100, 100, 10, 10, 10, 10]
    (p,) = A.af_decode(tags(spark, (LEGACY, vals))).collect()
    assert (p.idx, tuple(p.rect), p.in_focus) == (0, (0.45, 0.45, 0.1, 0.1), False)


def test_masks_span_several_words(spark):
    """20 points: two words per mask, the sign bit of a word included."""
    focus, selected = [-32768, 0b1000], [1, 0]
    vals = [20, 20, 100, 100, 100, 100, *[10] * 40, *[0] * 40, *focus, *selected]
    got = A.af_decode(tags(spark, (LEGACY, vals))).collect()
    assert [p.idx for p in got if p.in_focus] == [15, 19] and [p.idx for p in got if p.selected] == [0]


@pytest.mark.parametrize("focus, selected, tier", [([2], [1], [2]), ([], [0, 2], [0, 2]), ([], [], [0, 1, 2])])
def test_preference(spark, focus, selected, tier):
    rows = [(1, i, i in focus, i in selected, (i / 10, 0.1, 0.1, 0.1)) for i in range(3)]
    df = spark.createDataFrame(
        rows, "image_id int, idx int, in_focus boolean, selected boolean, rect struct<x:double,y:double,w:double,h:double>")
    assert sorted(r.idx for r in A.prefer_tier(df).collect()) == tier
    (u,) = A.preferred_union(df).collect()
    assert tuple(u.af_rect) == pytest.approx((min(tier) / 10, 0.1, (max(tier) - min(tier)) / 10 + 0.1, 0.1))


def test_one_image_with_most_points(spark):
    rows = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 1L, id) as image_id", "id as idx", "id = 3 as in_focus", "id % 2 = 0 as selected")
    kept = A.prefer_tier(rows)
    assert kept.filter("image_id = 1").collect()[0].idx == 3 and kept.filter("image_id = 1").count() == 1
    assert kept.count() == 20_000


# --- containers ----------------------------------------------------------------------------------

def tiff(entries, order="<"):
    """``entries``: (tag, values) with 16-bit values."""
    mark = b"II" if order == "<" else b"MM"
    head = mark + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(entries))
    data_at, listed, data = 8 + 2 + 12 * len(entries) + 4, b"", b""
    for tag, vals in entries:
        body = struct.pack(f"{order}{len(vals)}h", *vals)
        if len(body) > 4:
            value = struct.pack(order + "I", data_at + len(data))
            data += body
        else:
            value = body.ljust(4, b"\0")
        listed += struct.pack(order + "HHI", tag, 3, len(vals)) + value
    return head + listed + b"\0" * 4 + data


def box(payload, kind=b"CMT3", size=None):
    return struct.pack(">I", len(payload) + 8 if size is None else size) + kind + payload


PAD = b"\x00\x00\x00\x18ftypcrx \x00\x00\x00\x01" + b"\xff\xd8\xc3\xa9"


def extract(spark, content):
    df = spark.createDataFrame([("p", bytearray(content))], "path string, content binary")
    return [(r.entry, r.tag, r.cnt, r.vals) for r in H.extract_af_tags(df).collect()]


@pytest.mark.parametrize("order", ["<", ">"])
def test_container(spark, order):
    inner = tiff([(1, [7]), (LEGACY, OLD), (PRECISE, POINT), (LEGACY, STUB)], order)
    got = extract(spark, PAD + box(inner) + b"tail" * 9)
    assert sorted(got) == [(1, LEGACY, len(OLD), OLD), (2, PRECISE, len(POINT), POINT)]


@pytest.mark.parametrize("decoy", [
    box(b"x" * 8, size=1 << 30), box(b"", size=8), box(b"x" * 4, size=7), b"CMT3CMT3", b"\xff\xff\xff\xffCMT3"])
def test_decoy_first(spark, decoy):
    got = extract(spark, PAD + decoy + box(tiff([(PRECISE, POINT)])) + b"z" * 20)
    assert got == [(0, PRECISE, len(POINT), POINT)]


@pytest.mark.parametrize("content", [
    b"", b"CMT3", PAD, PAD + b"x" * 40, PAD + box(tiff([(PRECISE, POINT)]))[:-5],
    PAD + box(b"II*\0") + b"x" * 20, PAD + box(tiff([(PRECISE, POINT)]).replace(b"II", b"IM", 1)) + b"x" * 20,
    PAD + box(b"II" + struct.pack("<HI", 43, 8) + b"\0" * 30) + b"x" * 20,
    PAD + box(b"II" + struct.pack("<HIH", 42, 8, 500) + b"\0" * 30) + b"x" * 20,
    PAD + box(b"II" + struct.pack("<HIH", 42, 8, 0) + b"\0" * 30) + b"x" * 20,
    PAD + box(b"II" + struct.pack("<HI", 42, 9000) + b"\0" * 30) + b"x" * 20,
])
def test_no_tags(spark, content):
    assert extract(spark, content) == []


def test_inline_and_out_of_bounds_values(spark):
    """Two values fit into the entry itself; an entry that points outside is passed over for the next one."""
    inner = bytearray(tiff([(OLDEST, [-1, 2]), (LEGACY, OLD), (LEGACY, POINT)]))
    inner[8 + 2 + 12 + 8:8 + 2 + 12 + 12] = struct.pack("<I", 60_000)
    got = extract(spark, PAD + box(bytes(inner)) + b"z" * 20)
    assert sorted(got) == [(0, OLDEST, 2, [-1, 2]), (2, LEGACY, len(POINT), POINT)]


def test_a_container_is_taken_apart_once(spark):
    df = spark.createDataFrame([("p", bytearray(PAD))], "path string, content binary")
    plan = H.extract_af_tags(df)._jdf.queryExecution().optimizedPlan().toString()
    # One search for the name, and no number of its own for each byte.
    assert plan.count("CMT3") == 1 and plan.count("conv(") == 1


def test_container_to_rectangle(spark):
    rows = [("a", bytearray(PAD + box(tiff([(LEGACY, OLD), (PRECISE, STUB)], ">")) + b"z" * 20)), ("b", bytearray(PAD))]
    tags_found = H.extract_af_tags(spark.createDataFrame(rows, "path string, content binary"))
    (row,) = A.af_rects(tags_found).collect()
    assert row.path == "a" and row.af_rect.w == pytest.approx(0.05)


@pytest.mark.parametrize("content, carved", [
    (b"junk\xff\xd8\xff\xe0one\xff\xd9 mid \xff\xd8\xff\xe1two\xff\xd9tail", b"\xff\xd8\xff\xe0one\xff\xd9 mid \xff\xd8\xff\xe1two\xff\xd9"),
    (b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xd9"),
    (b"\xff\xd9 before \xff\xd8\xff", None), (b"\xff\xd8\xff no end", None), (b"\xff\xd8", None), (b"", None),
    (b"\xc3\xa9\xff\xd8\xff\xc3\xa9\xff\xd9\xc3", b"\xff\xd8\xff\xc3\xa9\xff\xd9"),
])
def test_embedded_jpeg(spark, content, carved):
    df = spark.createDataFrame([(bytearray(content),)], "content binary")
    got = df.select(H.carve_embedded_jpeg(F.col("content")).alias("c")).first().c
    assert got == (None if carved is None else bytearray(carved))
