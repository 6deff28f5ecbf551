"""Image files, detectors, and the stream that must equal the batch."""

import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from focuslake.functions import constants as C
from focuslake.functions.geometry import RECT
from focuslake.operators.udf import detect_in_batches, detect_with, gray_image
from focuslake.plans.focus import analyze_images, shrunk
from focuslake.sources.images import read_images
from focuslake.streaming.analysis import analyze_stream, progress, rescan, stored_results, stream_files, stream_images

PARTS = ", ".join(f"{n} {RECT}" for n in ("animal_eye", "animal_head", "animal_body", "human_eye", "human_face", "af_rect"))
PICKED = f"path string, path_taken string, region string, label string, det_conf float, rect {RECT}, box {RECT}"


def png(pixels):
    h, w, _ = pixels.shape

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def luma(p):
    p = p.astype(int)
    return (p[:, :, 0] * 299 + p[:, :, 1] * 587 + p[:, :, 2] * 114) // 1000


@pytest.fixture(scope="module")
def photos(tmp_path_factory):
    root = tmp_path_factory.mktemp("photos")
    rng = np.random.default_rng(11)
    made = {f"{i}.png": rng.integers(0, 256, (6 + i, 8 + i, 3), np.uint8) for i in range(9)}
    for name, pixels in made.items():
        (root / name).write_bytes(png(pixels))
    (root / "bad.png").write_bytes(b"not an image")
    return root, made


def name_of(path):
    return path.rsplit("/", 1)[1]


def test_decoding(spark, photos):
    root, made = photos
    rows = {name_of(r.path): r.image for r in read_images(spark, str(root)).collect()}
    assert rows["bad.png"] is None and set(rows) == set(made) | {"bad.png"}
    for name, pixels in made.items():
        image = rows[name]
        assert (gray_image(image.width, image.height, image.channels, bytes(image.data)) == luma(pixels)).all()


def test_shrinking(spark, photos):
    root, made = photos
    for r in shrunk(read_images(spark, str(root)), max_side=8).collect():
        if name_of(r.path) == "bad.png":
            assert r.image is None or r.image.width is None
            continue
        h, w, _ = made[name_of(r.path)].shape
        k = -(-max(h, w) // 8)
        assert (r.image.width, r.image.height, r.image.channels) == (-(-w // k), -(-h // k), 1)


def picks(images):
    """Every image whole, as an unlabelled body."""
    unit = F.struct(*[F.lit(v).alias(k) for k, v in zip("xywh", (0.0, 0.0, 1.0, 1.0))]).cast(RECT)
    return images.select(
        "path", F.lit("fallback").alias("path_taken"), F.lit(C.ANIMAL_BODY).alias("region"), F.lit("cat").alias("label"),
        F.lit(None).cast("float").alias("det_conf"), unit.alias("rect"), F.lit(None).cast(RECT).alias("box"))


def analyze(images):
    return analyze_images(images, picks(images))


def plain_result(pixels):
    g = luma(pixels)
    c = 2 * g[1:-1, 1:-1]
    h, v = c - g[1:-1, :-2] - g[1:-1, 2:], c - g[:-2, 1:-1] - g[2:, 1:-1]
    return min(np.sqrt(h.var() * v.var()) / 700, 1.0)


def test_whole_analysis(spark, photos):
    root, made = photos
    rows = {name_of(r.path): r for r in analyze(read_images(spark, str(root))).collect()}
    bad = rows.pop("bad.png")
    assert (bad.status, bad.score, bad.region, bad.blur_type, bad.size_conf, bad.label, bad.rect) == (
        C.NOT_ANALYZED, 0.0, C.FULL_IMAGE, C.UNKNOWN_BLUR, 0.0, None, None)
    for name, r in rows.items():
        assert r.score == pytest.approx(plain_result(made[name])) and r.label == "cat" and r.region == C.ANIMAL_BODY


def test_stream_equals_batch(spark, photos, tmp_path):
    root, _ = photos
    sink, checkpoint = str(tmp_path / "sink"), str(tmp_path / "checkpoint")
    query = analyze_stream(stream_images(spark, str(root), 4), analyze, sink, checkpoint)
    query.awaitTermination()
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(sizes) == 3 and progress(spark, sink, stored_results(spark, sink)) == 1.0
    batch = {name_of(r.path): (r.status, r.score, r.blur_type) for r in analyze(read_images(spark, str(root))).collect()}
    stream = {name_of(r.path): (r.status, r.score, r.blur_type) for r in stored_results(spark, sink).collect()}
    assert stream == batch


def test_stream_goes_on_where_it_stopped(spark, photos, tmp_path):
    _, made = photos
    root, sink, checkpoint = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "checkpoint")
    root.mkdir()

    def run():
        query = analyze_stream(stream_images(spark, str(root), 100), analyze, sink, checkpoint)
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    (root / "0.png").write_bytes(png(made["0.png"]))
    assert run() > 0 and run() == 0
    (root / "1.png").write_bytes(png(made["1.png"]))
    assert run() > 0
    assert sorted(name_of(r.path) for r in stored_results(spark, sink).collect()) == ["0.png", "1.png"]

    listing = spark.createDataFrame([(f"file://{root}/{n}.png",) for n in range(3)], "path string")
    merged, left = rescan(listing, stored_results(spark, sink))
    assert [name_of(r.path) for r in left.collect()] == ["2.png"]
    assert {name_of(r.path): r.status == C.NOT_ANALYZED for r in merged.collect()} == {"0.png": False, "1.png": False, "2.png": True}


def test_changed_and_chosen_files_are_left(spark):
    known = "path string, size long, mtime timestamp_ntz, status string"
    at = datetime(2024, 1, 1)
    results = spark.createDataFrame([("same", 1, at, "Sharp"), ("grown", 1, at, "Sharp"), ("touched", 1, at, "Sharp"), ("chosen", 1, at, "Sharp")], known)
    listing = spark.createDataFrame(
        [("same", 1, at), ("grown", 2, at), ("touched", 1, datetime(2024, 1, 2)), ("chosen", 1, at), ("new", 1, at)],
        "path string, size long, mtime timestamp_ntz")
    merged, left = rescan(listing, results, again=spark.createDataFrame([("chosen",)], "path string"))
    assert {r.path for r in left.collect()} == {"grown", "touched", "chosen", "new"}
    assert {r.path: r.status for r in merged.collect()} == {
        "same": "Sharp", **dict.fromkeys(("grown", "touched", "chosen", "new"), C.NOT_ANALYZED)}


def test_later_results_win(spark, tmp_path):
    for run, n, day, score in (("a", 7, 1, 0.1), ("a", 10, 2, 0.2), ("b", 0, 3, 0.3)):
        rows = spark.createDataFrame([("p", score, datetime(2024, 1, day))], "path string, score double, stored_at timestamp")
        rows.write.parquet(f"{tmp_path}/s/run={run}/batch_id={n}")
    assert [tuple(r) for r in stored_results(spark, f"{tmp_path}/s").collect()] == [("p", 0.3)]


def test_two_checkpoints_share_a_sink(spark, tmp_path):
    """Each has a batch 0; also more batches than Spark remembers progress of."""
    sink, n = str(tmp_path / "sink"), 104
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for k in range(n):
        (tmp_path / "a" / f"{k}.txt").write_text("x")
    (tmp_path / "b" / "x.txt").write_text("y")
    for name in "ab":
        stream = stream_files(spark, str(tmp_path / name), 1)
        analyze_stream(stream, lambda b: b.select("path").coalesce(1), sink, str(tmp_path / f"check-{name}")).awaitTermination()
    assert stored_results(spark, sink).count() == n + 1
    found = stored_results(spark, sink).select("path")
    assert progress(spark, sink, found.union(found.selectExpr("concat(path, '2')"))) == 0.5


def test_stream_of_files(spark, photos, tmp_path):
    root, made = photos
    files = stream_files(spark, str(root), 3, "*.png")
    query = analyze_stream(files, lambda b: b.select("path", "length"), str(tmp_path / "s"), str(tmp_path / "c"))
    query.awaitTermination()
    assert stored_results(spark, str(tmp_path / "s")).count() == len(made) + 1


def test_no_model_finds_nothing(spark, photos):
    found = detect_with(read_images(spark, str(photos[0])), lambda: None)
    assert found.count() == 0 and found.columns == ["path", "ord", "label", "confidence", "box", "eye_kps", "nose"]


def test_detector(spark, photos):
    root, made = photos

    def two_boxes():
        def detect(g):
            h, w = g.shape
            return [
                ("cat", 0.9, (0, 0, 1 / w, 1 / h), [(0.1, 0.2), (0.3, 0.2)], (0.2, 0.3)),
                ("dog", 0.2, (0.5, 0.5, 0.5, 0.5), [], None)]

        return detect

    rows = detect_with(read_images(spark, str(root)), two_boxes).collect()
    assert len(rows) == 2 * len(made)
    for r in rows:
        w = made[name_of(r.path)].shape[1]
        if r.ord == 0:
            assert (r.label, r.box.w, [tuple(p) for p in r.eye_kps], tuple(r.nose)) == ("cat", 1 / w, [(0.1, 0.2), (0.3, 0.2)], (0.2, 0.3))
        else:
            assert (r.label, r.nose, r.eye_kps) == ("dog", None, [])


def test_batches_equal_the_row_loop(spark, photos):
    """A model of a fixed size over images of many sizes; one that cannot be decoded has nothing."""
    root, made = photos

    def whole_mean():
        return lambda g: [("mean", float(g.sum()) / 1e6, (0.0, 0.0, 1.0, 1.0), [], None)]

    def means():
        def predict(squares):
            found = []
            for s in squares:
                ys, xs = np.nonzero(s)
                found.append([[0, (s * 255).sum() / 1e6, 0, 0, xs.max() + 1, ys.max() + 1]])
            return found

        return predict

    images = read_images(spark, str(root))
    one = {name_of(r.path): r for r in detect_with(images, whole_mean).collect()}
    many = {name_of(r.path): r for r in detect_in_batches(images, means, ["mean"], side=128, batch=3).collect()}
    assert set(one) == set(many) == set(made)
    for name, r in many.items():
        assert (r.ord, r.label, r.eye_kps, r.nose) == (0, "mean", [], None) and abs(r.confidence - one[name].confidence) < 1e-5
        assert abs(r.box.w - 1) < 1e-6 and abs(r.box.h - 1) < 1e-6
    half = {name_of(r.path): r for r in detect_in_batches(images, means, [], side=4, batch=3).collect()}
    assert set(half) == set(made) and {r.label for r in half.values()} == {"unknown"}


@pytest.mark.parametrize("kind", ["rows", "batches"])
def test_a_model_is_built_once_per_worker(spark, photos, tmp_path, kind):
    root, made = photos
    built = str(tmp_path)

    def load():
        import os
        import uuid

        with open(f"{built}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass
        return (lambda g: [("x", 0.5, (0, 0, 1, 1), [], None)]) if kind == "rows" else (lambda squares: [[[0, 0.5, 0, 0, 1, 1]] for _ in squares])

    images = read_images(spark, str(root)).repartition(24)
    found = detect_with(images, load) if kind == "rows" else detect_in_batches(images, load, ["x"], side=64, batch=1)
    assert found.count() == found.count() == len(made)
    pids = [p.name.split("-")[0] for p in tmp_path.iterdir() if p.is_file()]
    assert 0 < len(pids) == len(set(pids))
