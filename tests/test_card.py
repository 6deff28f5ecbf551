"""Previews, cards scored folder by folder, results as they land, progress."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from focuslake.functions import constants as C
from focuslake.functions.geometry import RECT
from focuslake.plans import focus
from focuslake.sources.catalog_walk import read_catalog, stream_catalog
from focuslake.sources.images import read_images
from focuslake.sources.previews import LEVELS, place_digits, preview_name, preview_place, write_previews
from focuslake.streaming import current as L
from focuslake.streaming.analysis import all_results, analyze_stream, batch_counts, counts_folder, progress, score_arrivals
from test_images import png

PICK = f"path string, rect {RECT}, region string, label string, det_conf float, path_taken string, box {RECT}"


@pytest.fixture
def card(tmp_path):
    """Twelve images, most with names that Spark's sources pass over; equal stems; files that are no images."""
    rng = np.random.default_rng(8)
    root = tmp_path / "card"
    (root / "sub").mkdir(parents=True)
    names = [f"_MG_{i}.png" for i in range(8)] + ["a.PNG", "sub/_MG_1.png", "sub/a.png", "b.png"]
    for n in names:
        (root / n).write_bytes(png(rng.integers(0, 256, (30, 40, 3), np.uint8)))
    (root / "_MG_99.png").write_bytes(b"no image")
    (root / "_MG_98.CR3").write_bytes(b"nothing inside")
    return root, names


def picks(spark, paths):
    return spark.createDataFrame([(p, (0.1, 0.1, 0.5, 0.5) if i % 2 else None, "Animal Body" if i % 2 else "Full Image", None, None, "fallback", None)
                                  for i, p in enumerate(sorted(paths))], PICK)


def values(df):
    return {r.path: (r.status, r.region, round(r.score, 9), r.blur_type, round(r.size_conf, 9)) for r in df.collect()}


@pytest.fixture
def scored(spark, card, tmp_path):
    """What the images give when they are read under names that Spark sees."""
    root, _ = card
    files = read_catalog(spark, str(root), raw=False)
    paths = [r.path for r in files.collect()]
    write_previews(files, str(tmp_path / "p")).write.parquet(str(tmp_path / "table"))
    previews = spark.read.parquet(str(tmp_path / "table"))
    whole = read_images(spark, str(tmp_path / "p"))
    name = F.substring_index("path", "/", -1)
    picked = picks(spark, paths).join(previews.select("path", F.substring_index("preview", "/", -1).alias("name")), "path", "left")
    return paths, previews, values(focus.analyze_images(whole.withColumn("name", name).drop("path"), picked, "name", result="path"))


def test_previews_of_all_kinds(spark, scored, card):
    root, names = card
    paths, previews, want = scored
    found = {r.path: r.preview for r in previews.collect()}
    assert len(found) == len(names) + 2 and found[f"{root}/_MG_98.CR3"] is None
    assert all(found[p].endswith(preview_place(p)) for p in paths if found[p])
    assert sum(v[0] != C.NOT_ANALYZED for v in want.values()) == len(names)


def test_places(spark):
    place = preview_place("/x/_MG_1.JPEG")
    assert place.rsplit("/", 1)[1] == preview_name("/x/_MG_1.JPEG") and place.endswith("-_MG_1.jpg") and place.count("/") == LEVELS
    row = spark.createDataFrame([(f"/root/p/{place}",), (None,)], "p string").select(place_digits(F.col("p")).alias("d")).collect()
    assert [r.d for r in row] == [place[:2 * LEVELS].replace("/", ""), None]


@pytest.mark.parametrize("most", [1, 3, 100_000])
def test_folder_by_folder(spark, scored, tmp_path, most):
    paths, previews, want = scored
    picked = picks(spark, paths)
    assert values(focus.analyze_card(picked, previews, str(tmp_path / "p"), most=most, folder=str(tmp_path / "out"))) == want
    assert len(list((tmp_path / "out").glob("results-*"))) == len(focus.shards(
        {r.d: r.n for r in previews.where("preview is not null").groupBy(place_digits(F.col("preview")).alias("d")).agg(F.count("*").alias("n")).collect()}, most))


def test_repeated_picks_and_missing_previews(spark, scored, tmp_path):
    paths, previews, want = scored
    picked = picks(spark, paths)
    both = picked.union(picked.where(F.col("path") == paths[0]))
    assert focus.analyze_card(both, previews, str(tmp_path / "p"), most=1, folder=str(tmp_path / "a")).count() == len(paths) + 1
    none = focus.analyze_card(picked, previews.limit(0), str(tmp_path / "p"), folder=str(tmp_path / "b"))
    assert {v[0] for v in values(none).values()} == {C.NOT_ANALYZED} and none.count() == len(paths)
    assert focus.analyze_card(picked.limit(0), previews, str(tmp_path / "p"), folder=str(tmp_path / "c")).count() == 0


def test_shards_are_bounded():
    counts = {"000": 5, "001": 1, "0ff": 2, "abc": 25, "f00": 3, "f01": 2}
    assert focus.shards(counts, 8) == [(["0"], 0, 1), *[(["abc"], i, 4) for i in range(4)], (["f"], 0, 1)]
    assert focus.shards(counts, 5) == [(["000"], 0, 1), (["001", "0f"], 0, 1), *[(["abc"], i, 5) for i in range(5)], (["f"], 0, 1)]
    assert focus.shards(counts, 100) == [([""], 0, 1)] and focus.shards({}, 5) == []
    many = {f"{i:03x}": i % 50 for i in range(4096)}
    for most in (10, 60, 1000, 10**6):
        found = focus.shards(many, most)
        for prefixes, part, parts in found:
            held = sum(n for k, n in many.items() if k.startswith(tuple(prefixes)))
            assert held <= most * parts and (parts == 1 or len(prefixes) == 1)
        assert sum(sum(n for k, n in many.items() if k.startswith(tuple(p))) for p, part, _ in found if not part) == sum(many.values())


def test_no_pixel_is_shuffled(spark, scored, tmp_path):
    paths, previews, _ = scored
    picked = picks(spark, paths).withColumn("_name", F.concat("path", F.lit("x")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = focus.score_shard(picked, read_images(spark, str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange") == plan.count("BroadcastExchange") == 1


def watch(spark, root, tmp_path, current=True):
    time.sleep(0.4)
    files = stream_catalog(spark, str(root), settle="0.3")
    analyze = score_arrivals(lambda batch: picks(spark, []).unionByName(batch.selectExpr(
        "path", "cast(null as struct<x:double,y:double,w:double,h:double>) as rect", "'Full Image' as region", "cast(null as string) as label",
        "cast(null as float) as det_conf", "'fallback' as path_taken", "cast(null as struct<x:double,y:double,w:double,h:double>) as box")),
        str(tmp_path / "stream-previews"))
    analyze_stream(files, analyze, str(tmp_path / "sink"), str(tmp_path / "checkpoint"), str(tmp_path / "current") if current else None).awaitTermination()


def test_stream_scores_every_name_once(spark, card, tmp_path):
    """Progress is 0 before the first batch; it goes by the listing, also when files are gone; a restart goes on."""
    root, names = card
    sink = str(tmp_path / "sink")

    def listing():
        return read_catalog(spark, str(root), raw=False)

    assert progress(spark, sink, listing()) == 0.0 and batch_counts(spark, sink).count() == 0
    watch(spark, root, tmp_path)
    assert progress(spark, sink, listing()) == 1.0
    (root / "_MG_50.png").write_bytes((root / "b.png").read_bytes())
    (root / "sub" / "_MG_51.png").write_bytes((root / "b.png").read_bytes())
    (root / "b.png").unlink()
    total = len(names) + 2 + 2 - 1
    assert progress(spark, sink, listing()) == pytest.approx((total - 2) / total)
    watch(spark, root, tmp_path)
    assert progress(spark, sink, listing()) == 1.0 and progress(spark, sink, listing().limit(0)) == 1.0
    stored = all_results(spark, sink)
    assert stored.count() == len(names) + 4 == stored.select("path").distinct().count()
    counted = batch_counts(spark, sink).collect()
    assert sum(r.files for r in counted) == len(names) + 4 and sum(r.scored for r in counted) == len(names) + 2
    # Only files that are gone in the sink: nothing of the listing is done.
    assert progress(spark, sink, spark.createDataFrame([("/other",)], "path string")) == 0.0
    now = L.current_results(spark, str(tmp_path / "current"))
    assert now.count() == len(names) + 4 and "Window" not in now._jdf.queryExecution().executedPlan().toString()


def test_counts_are_kept_apart(spark, tmp_path):
    assert counts_folder("/x/sink/") == "/x/sink-counts"


RESULT = "path string, score double, stored_at int, run string, batch_id int"


def test_latest_result_of_every_file(spark, tmp_path):
    folder = str(tmp_path / "current")

    def batch(n, rows):
        df = spark.createDataFrame([(p, float(s), n, "r", n) for p, s in rows], RESULT)
        df.write.parquet(str(tmp_path / f"batch-{n}"))
        return spark.read.parquet(str(tmp_path / f"batch-{n}"))

    def now():
        return {r.path: r.score for r in L.current_results(spark, folder).collect()}

    L.upsert(batch(0, [(f"f{i}", i) for i in range(200)]), folder, "r-0", buckets=16)
    assert now() == {f"f{i}": i for i in range(200)}
    second = batch(1, [("f3", 33), ("f3", 33), ("new", 1)])
    untouched = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "current").rglob("*.parquet")}
    L.upsert(second, folder, "r-1", buckets=16)
    want = {f"f{i}": float(i) for i in range(200)} | {"f3": 33.0, "new": 1.0}
    assert now() == want and L.current_results(spark, folder).count() == 201
    kept = {str(p) for p in (tmp_path / "current").rglob("*.parquet")} & set(untouched)
    assert len(kept) >= 14
    # Again, also after a loss while the folders were replaced, and after a loss before that.
    L.upsert(second, folder, "r-1", buckets=16)
    assert now() == want
    for p in (tmp_path / "current").iterdir():
        if p.name.startswith("bucket="):
            touched = {r.bucket for r in second.select(F.pmod(F.xxhash64("path"), F.lit(16)).alias("bucket")).collect()}
            if int(p.name.split("=")[1]) in touched:
                for f in p.iterdir():
                    f.unlink()
    L.upsert(second, folder, "r-1", buckets=16)
    assert now() == want
    # An older result that comes late does not win.
    late = spark.createDataFrame([("f3", 0.5, 0, "q", 0)], RESULT)
    L.upsert(late, folder, "q-0", buckets=16)
    assert now() == want
