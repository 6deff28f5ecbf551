"""The forms of the Laplacian agree with each other and with a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from focuslake.operators import pixels as P
from focuslake.operators.udf import block_mean, full_window, grid_moments_udf, laplacian_udf, moments, regions_udf

MOMENT_NAMES = list(P.MOMENTS)


def loop_moments(g, x0, y0, x1, y1):
    n = sh = qh = sv = qv = 0
    for y in range(y0 + 1, y1 - 1):
        for x in range(x0 + 1, x1 - 1):
            h = 2 * g[y][x] - g[y][x - 1] - g[y][x + 1]
            v = 2 * g[y][x] - g[y - 1][x] - g[y + 1][x]
            n, sh, qh, sv, qv = n + 1, sh + h, qh + h * h, sv + v, qv + v * v
    return (n, sh, qh, sv, qv)


@pytest.fixture(scope="module")
def images():
    rng = random.Random(7)
    made = []
    for i, (w, h) in enumerate([(3, 3), (8, 8), (13, 7), (9, 21), (16, 16), (2, 9), (9, 2), (1, 1)]):
        made.append((i, w, h, [[rng.randrange(256) for _ in range(w)] for _ in range(h)]))
    return made


@pytest.fixture(scope="module")
def windows():
    return {0: (0, 0, 3, 3), 1: (2, 1, 8, 7), 2: (0, 0, 13, 7), 3: (3, 5, 7, 19), 4: (4, 4, 6, 12), 5: (0, 0, 2, 9), 6: (0, 0, 9, 2), 7: (0, 0, 1, 1)}


@pytest.fixture(scope="module")
def frame(spark, images):
    rows = [(i, w, h, [v for line in g for v in line]) for i, w, h, g in images]
    return spark.createDataFrame(rows, "image_id int, width int, height int, grid array<int>")


def by_image(df):
    return {r.image_id: tuple(r[k] for k in MOMENT_NAMES) for r in df.collect()}


def expected(images, windows):
    found = {i: loop_moments(g, *windows[i]) for i, _, _, g in images}
    return {i: m for i, m in found.items() if m[0] > 0}


def window_table(spark, windows):
    return spark.createDataFrame([(i, *w) for i, w in windows.items()], "image_id int, x0 int, y0 int, x1 int, y1 int")


@pytest.mark.parametrize("tile", [1, 2, 3, 4, 64])
def test_relational_whole(spark, images, frame, tile):
    whole = {i: (0, 0, w, h) for i, w, h, _ in images}
    got = P.directional_laplacian(P.pixels_from_arrays(frame), tile=tile)
    assert by_image(got) == expected(images, whole)


@pytest.mark.parametrize("tile", [2, 3, 64])
def test_relational_cropped(spark, images, frame, windows, tile):
    got = P.directional_laplacian(P.pixels_from_arrays(frame), windows=window_table(spark, windows), tile=tile)
    assert by_image(got) == expected(images, windows)
    cropped = P.crop_pixels(P.pixels_from_arrays(frame), window_table(spark, windows), tile=tile)
    assert by_image(P.directional_laplacian(cropped, tile=tile)) == expected(images, windows)


def test_array_form(spark, images, frame, windows):
    joined = frame.join(window_table(spark, windows), "image_id").withColumn("win", F.struct("x0", "y0", "x1", "y1"))
    got = joined.select("image_id", P.array_moments(F.col("grid"), F.col("width"), F.col("win")).alias("m"))
    assert by_image(got.filter("m is not null").select("image_id", "m.*")) == expected(images, windows)


def test_stacked_grids(spark, images, frame, windows):
    joined = frame.join(window_table(spark, windows), "image_id").withColumn("win", F.struct("x0", "y0", "x1", "y1"))
    cropped = joined.select("image_id", grid_moments_udf("grid", "width", "win").alias("m")).select("image_id", "m.*")
    assert by_image(cropped.filter("n is not null")) == expected(images, windows)
    whole = {i: (0, 0, w, h) for i, w, h, _ in images}
    full = full_window(F.col("width"), F.col("height"))
    got = frame.select("image_id", grid_moments_udf("grid", "width", full).alias("m")).select("image_id", "m.*")
    assert by_image(got.filter("n is not null")) == expected(images, whole)


def test_stacked_grids_with_nothing_to_do(spark):
    df = spark.createDataFrame(
        [(1, None, 3, (0, 0, 3, 3)), (2, [1] * 9, 3, None), (3, [], 3, (0, 0, 3, 3))],
        "image_id int, grid array<int>, width int, win struct<x0:int,y0:int,x1:int,y1:int>")
    rows = df.select(grid_moments_udf("grid", "width", "win").alias("m")).collect()
    assert all(r.m is None or r.m.n is None for r in rows)


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_buffer_form(spark, images, windows, channels):
    """Blue, green, red order, downscaled by 1 and 2."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for i, w, h, g in images:
        data = rng.integers(0, 256, (h, w, channels), np.uint8) if channels > 1 else np.array(g, np.uint8).reshape(h, w, 1)
        p = data.astype(int)
        luma = (p[:, :, 2] * 299 + p[:, :, 1] * 587 + p[:, :, 0] * 114) // 1000 if channels > 1 else p[:, :, 0]
        for k in (1, 2):
            small = [[int(luma[y:y + k, x:x + k].sum() // luma[y:y + k, x:x + k].size) for x in range(0, w, k)] for y in range(0, h, k)]
            m = loop_moments(small, 0, 0, len(small[0]), len(small))
            if m[0]:
                want[i * 10 + k] = m
            rows.append((i * 10 + k, k, (w, h, channels, bytearray(data.tobytes())), len(small[0]), len(small)))
    df = spark.createDataFrame(
        rows, "image_id int, k int, image struct<width:int,height:int,channels:int,data:binary>, w int, h int")
    m = laplacian_udf(F.col("image"), F.col("k"), full_window(F.col("w"), F.col("h")))
    got = df.select("image_id", m.alias("m")).select("image_id", "m.*").filter("n is not null")
    assert by_image(got) == want


def test_missing_image_gives_null(spark):
    df = spark.createDataFrame([(1, None)], "image_id int, image struct<width:int,height:int,channels:int,data:binary>")
    window = full_window(F.col("image.width"), F.col("image.height"))
    row = df.select(laplacian_udf(F.col("image"), F.lit(1), window).alias("m")).first()
    assert row.m is None or row.m.n is None


def test_gap_in_a_row_is_not_a_neighbour(spark):
    rows = [(1, y, x, 5) for y in range(3) for x in (0, 1, 3)]
    assert P.second_difference(spark.createDataFrame(rows, "image_id int, y int, x int, g int")).count() == 0


@pytest.mark.parametrize("w, h, side, block", [(1536, 1024, 1536, 1), (1537, 10, 1536, 2), (6960, 4640, 1536, 5), (1, 1, 400, 1)])
def test_downscale_factor(spark, w, h, side, block):
    assert spark.range(1).select(P.downscale_factor(F.lit(w), F.lit(h), side)).first()[0] == block


def test_downscale_matches_block_mean(spark, images, frame):
    got = P.downscale(P.pixels_from_arrays(frame), 3).collect()
    rows = {(r.image_id, r.y, r.x): r.g for r in got}
    want = {(i, y, x): int(v) for i, _, _, g in images for (y, x), v in np.ndenumerate(block_mean(np.array(g), 3))}
    assert rows == want


def test_moments_of_a_small_array():
    assert moments(np.ones((2, 5))) is None
    assert moments(np.array([[0, 0, 0], [0, 9, 0], [0, 0, 0]])) == (1, 18, 324, 18, 324)


def test_one_image_with_most_pixels_is_spread(spark):
    """The stencil is partitioned by tile, so one large image fills many groups of bounded size."""
    big = spark.range(200 * 200).selectExpr("1 as image_id", "int(id div 200) as y", "int(id % 200) as x", "int(id % 251) as g")
    tiles = P.with_tiles(big).groupBy("image_id", "ty", "tx").count().collect()
    assert len(tiles) >= 16 and max(r["count"] for r in tiles) <= 66 * 66
    assert P.second_difference(big).count() == 198 * 198


@pytest.mark.parametrize("tile", [1, 3, 5, 64])
def test_gaps(spark, tile):
    """Missing pixels, nulls and negative levels, against a plain loop."""
    rng = random.Random(11)
    levels = {(y, x): rng.randrange(-300, 300) for y in range(11) for x in range(14) if rng.random() < 0.9}
    rows = [(1, y, x, g) for (y, x), g in levels.items()] + [(1, 0, 20, None), (2, 3, 3, 1), (3, 0, 0, None)]
    pixels = spark.createDataFrame(rows, "image_id int, y int, x int, g int").repartition(3)
    want = {}
    for (y, x), g in levels.items():
        sides = [levels.get(p) for p in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x))]
        if None not in sides:
            want[y, x] = (2 * g - sides[0] - sides[1], 2 * g - sides[2] - sides[3])
    got = {(r.y, r.x): (r.lh, r.lv) for r in P.second_difference(pixels, tile=tile).collect()}
    assert got == want and len(want) > 20


def test_all_regions_of_an_image_at_once(spark):
    """Sums over any window from running sums, equal to the moments of each window cut out; blocks of one and more pixels."""
    rng = np.random.default_rng(12)
    rows = []
    for i, (w, h) in enumerate([(40, 30), (3, 3), (2, 9), (17, 64)]):
        windows = [(0, 0, w, h), (0, 0, 0, 0), (1, 1, 2, 2)]
        for _ in range(12):
            x0, y0 = int(rng.integers(0, w)), int(rng.integers(0, h))
            windows.append((x0, y0, int(rng.integers(x0, w + 1)), int(rng.integers(y0, h + 1))))
        rows.append((i, (w, h, 1, rng.integers(0, 256, w * h, np.uint8).tobytes()), windows))
    rows += [(9, None, [(0, 0, 1, 1)]), (10, rows[0][1], None), (11, rows[0][1], [])]
    df = spark.createDataFrame(rows, "i int, image struct<width: int, height: int, channels: int, data: binary>, windows array<struct<x0: int, y0: int, x1: int, y1: int>>")
    for block in (1, 3):
        got = {r.i: r.m for r in df.select("i", regions_udf(F.col("image"), F.lit(block), F.col("windows")).alias("m")).collect()}
        assert got[9] is None and got[10] is None and got[11] == []
        for i, image, windows in rows[:4]:
            g = block_mean(np.frombuffer(image[3], np.uint8).reshape(image[1], image[0]).astype(int), block)
            for (x0, y0, x1, y1), m in zip(windows, got[i], strict=True):
                want = moments(g[y0:y1, x0:x1]) if y1 > y0 and x1 > x0 else None
                assert (tuple(m) if m.n else None) == want
