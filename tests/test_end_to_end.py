"""A small card from listing to sidecars, as in the README."""

import numpy as np
from pyspark.sql import functions as F

from focuslake.functions import constants as C
from focuslake.functions.files import file_stem
from focuslake.functions.geometry import RECT
from focuslake.operators.afpoints import af_rects
from focuslake.operators.catalog import apply_results, browse, catalog_columns, status_summary
from focuslake.operators.detections import best_detection, confidence_gate, top_detections
from focuslake.operators.regions import assemble_regions, pick_path
from focuslake.plans.focus import analyze_images
from focuslake.sources.headers import extract_af_tags, read_bytes
from focuslake.sources.images import read_images
from focuslake.sources.listing import scan_catalog
from focuslake.sources.sidecars import sidecar_table, write_sidecars, write_summary
from test_focus_points import LEGACY, OLD, PAD, PRECISE, STUB, box, tiff
from test_images import luma, png

POINT = "struct<x:double,y:double>"


def test_card(spark, tmp_path):
    rng = np.random.default_rng(5)
    card = tmp_path / "card"
    card.mkdir()
    raw = PAD + box(tiff([(LEGACY, OLD), (PRECISE, STUB)])) + b"tail" * 10
    made = {n: rng.integers(0, 256, (60, 80, 3), np.uint8) for n in ("IMG_1", "_MG_2", "IMG_3")}
    for name, pixels in made.items():
        (card / f"{name}.CR3").write_bytes(raw if name != "IMG_3" else b"nothing")
        if not name.startswith("_"):  # Spark's image source would not see it
            (card / f"{name}.png").write_bytes(png(pixels))
    (card / "IMG_4.CR3").write_bytes(raw)
    path = {n: f"{card}/{n}.CR3" for n in (*made, "IMG_4")}

    catalog = catalog_columns(scan_catalog(spark, str(card)))
    assert {r.name for r in catalog.collect()} == {"IMG_1.CR3", "_MG_2.CR3", "IMG_3.CR3", "IMG_4.CR3"}
    af = af_rects(extract_af_tags(read_bytes(catalog)))
    assert {r.path for r in af.collect()} == {path["IMG_1"], path["_MG_2"], path["IMG_4"]}

    detections = spark.createDataFrame(
        [(path["IMG_3"], 0, "person", 0.99, (0.1, 0.1, 0.8, 0.8), [], None), (path["IMG_3"], 1, "robin", 0.4, (0.2, 0.2, 0.5, 0.5), [], None),
         (path["IMG_3"], 2, "cat", 0.34, (0.0, 0.0, 1.0, 1.0), [], None)],
        f"path string, ord int, label string, confidence float, box {RECT}, eye_kps array<{POINT}>, nose {POINT}")
    best = best_detection(top_detections(confidence_gate(detections), image="path"), "path")
    animals = spark.createDataFrame([], f"path string, eye {RECT}, head {RECT}, body {RECT}, label string")
    humans = spark.createDataFrame([], f"path string, eye {RECT}, face {RECT}")
    picked = pick_path(assemble_regions(catalog.select("path"), animals, humans, af, "path"), best, "path")

    stems = picked.withColumn("stem", file_stem(F.col("path")))
    previews = read_images(spark, str(card)).withColumn("stem", file_stem(F.col("path")))
    scored = analyze_images(previews, stems, "stem")
    results = catalog.select("path").withColumn("stem", file_stem(F.col("path"))).join(scored, "stem").drop("stem").cache()
    got = {r.path: r for r in results.collect()}
    assert len(got) == 4

    # Detector path: the animal wins over the surer person; its head is the top 30 % of the box.
    bird = got[path["IMG_3"]]
    assert (bird.region, bird.label, bird.size_conf) == (C.DETECTOR_HEAD, "Robin", 1.0)
    g = luma(made["IMG_3"])[12:21, 16:56]
    c = 2 * g[1:-1, 1:-1]
    h, v = c - g[1:-1, :-2] - g[1:-1, 2:], c - g[:-2, 1:-1] - g[2:, 1:-1]
    assert abs(bird.score - min(np.sqrt(h.var() * v.var()) / 400, 1.0)) < 1e-9

    # Fallback path: the camera's focus point, twice its size.
    point = got[path["IMG_1"]]
    assert point.region == C.AF_POINT and abs(point.rect.w - 0.1) < 1e-9 and point.label is None and point.status != C.NOT_ANALYZED
    # No preview: the values of a file that was never analysed.
    for n in ("_MG_2", "IMG_4"):
        r = got[path[n]]
        assert (r.status, r.score, r.region, r.blur_type, r.rect) == (C.NOT_ANALYZED, 0.0, C.FULL_IMAGE, C.UNKNOWN_BLUR, None)

    merged = apply_results(catalog, results)
    assert status_summary(merged).first().total == 4
    assert [r.name for r in browse(merged, "img_", "Unanalyzed").collect()] == ["IMG_4.CR3"]
    outcome = str(tmp_path / "outcome")
    write_sidecars(sidecar_table(results.select("path", "region", "label"))).write.parquet(outcome)
    assert write_summary(spark.read.parquet(outcome)).first().message == "1 XMP file(s) written, 3 skipped"
    assert "Wildlife|Birds|Robin" in (card / "IMG_3.xmp").read_text(encoding="utf-8")
