"""Listings on disk, browsing, results, decode cascades."""

import pytest
from pyspark.sql import functions as F

from focuslake.functions import constants as C
from focuslake.functions.files import file_ext, file_stem, is_raw_name
from focuslake.functions.labels import sidecar_path
from focuslake.operators import attempts as T, catalog as K
from focuslake.sources.headers import carve_embedded_jpeg, jpeg_in, read_bytes
from focuslake.sources.listing import open_filesystem, scan_binary_listing, scan_catalog, scan_many_roots, visible_entries, walk
from focuslake.sources.previews import preview_place, write_previews


@pytest.fixture(scope="module")
def card(tmp_path_factory):
    root = tmp_path_factory.mktemp("card")
    files = {
        "DCIM/100/IMG_0001.CR3": b"one", "DCIM/100/IMG_0002.cr3": b"", "DCIM/101/_MG_0003.CR3": b"three",
        "DCIM/101/IMG_0004.jpg": b"x", "b.Nef": b"nefnef", ".hid/x.CR3": b"x", "DCIM/.IMG_0005.CR3": b"x",
        "DCIM/100/deep/er/c.3FR": b"y", "DCIM/100/cr3": b"z",
    }
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root


KEPT = {"IMG_0001.CR3": 3, "IMG_0002.cr3": 0, "_MG_0003.CR3": 5, "b.Nef": 6, "c.3FR": 1}


@pytest.mark.parametrize("prefix", ["", "file://", "file:"])
@pytest.mark.parametrize("parts", [1, 3, 64])
def test_scan(spark, card, prefix, parts):
    rows = scan_catalog(spark, f"{prefix}{card}", parts).collect()
    assert {r.path.rsplit("/", 1)[1]: r.size for r in rows} == KEPT and len(rows) == len(KEPT)
    assert all(r.path.startswith(f"{prefix}{card}/") and r.mtime is not None for r in rows)


def test_levels_are_listed_by_tasks(spark, tmp_path):
    """A crowded branch below many folders; each folder listed once."""
    for k in range(70):
        (tmp_path / "c" / f"f{k}").mkdir(parents=True)
        (tmp_path / "c" / f"f{k}" / "a b#1%20.cr3").write_bytes(b"x")
    found = walk(spark, str(tmp_path), ["cr3"], 8, str(tmp_path / ".levels"))
    assert sorted(r.path for r in found.collect()) == sorted(f"{tmp_path}/c/f{k}/a b#1%20.cr3" for k in range(70))
    assert len(list((tmp_path / ".levels").iterdir())) == 3
    assert len(list((tmp_path / ".levels" / "level-2").glob("part-*.parquet"))) > 4


def test_links_to_folders_are_not_followed(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.cr3").write_bytes(b"x")
    (tmp_path / "d" / "up").symlink_to(tmp_path)
    (tmp_path / "d" / "b.cr3").symlink_to(tmp_path / "d" / "a.cr3")
    assert sorted(r.path for r in scan_catalog(spark, str(tmp_path)).collect()) == [f"{tmp_path}/d/{n}.cr3" for n in "ab"]


def test_errors_other_than_missing_are_raised(tmp_path, monkeypatch):
    assert list(visible_entries(str(tmp_path / "missing"))) == []
    (tmp_path / "file").write_bytes(b"x")
    assert list(visible_entries(str(tmp_path / "file"))) == []

    def slow(path):
        raise TimeoutError(path)

    monkeypatch.setattr("os.scandir", slow)
    with pytest.raises(TimeoutError):
        list(visible_entries(str(tmp_path)))


def test_keys_are_taken_literally():
    for key in ("a b#1%20.cr3", "x?y.cr3"):
        filesystem, path, prefix = open_filesystem(f"mock://host/dir/{key}")
        assert path.endswith(f"dir/{key}") and prefix + path == f"mock://host/dir/{key}"
        assert open_filesystem(f"mock://host/{key}")[0] is filesystem


def test_link_to_nowhere_is_listed(spark, tmp_path):
    (tmp_path / "a.cr3").symlink_to(tmp_path / "missing")
    (tmp_path / "b.cr3").write_bytes(b"xy")
    rows = {r.path.rsplit("/", 1)[1]: (r.size, r.mtime is None) for r in scan_catalog(spark, str(tmp_path)).collect()}
    assert rows == {"a.cr3": (None, True), "b.cr3": (2, False)}


def test_scan_of_nothing(spark, tmp_path):
    assert scan_catalog(spark, str(tmp_path)).count() == 0
    assert scan_catalog(spark, str(tmp_path / "missing")).count() == 0


def test_roots_are_not_merged(spark, card):
    assert scan_many_roots(spark, str(card), str(card)).count() == 2 * len(KEPT)


def test_spark_listing_misses_underscores_and_empty_files(spark, card):
    names = {r.path.rsplit("/", 1)[1] for r in scan_binary_listing(spark, str(card)).collect()}
    assert names == set(KEPT) - {"_MG_0003.CR3", "IMG_0002.cr3"}


def test_root_may_be_hidden(spark, tmp_path):
    root = tmp_path / ".cards"
    (root / ".trash").mkdir(parents=True)
    (root / "a.cr3").write_bytes(b"x")
    (root / ".trash" / "b.cr3").write_bytes(b"x")
    for listing in (scan_catalog(spark, str(root)), scan_binary_listing(spark, str(root))):
        assert [r.path.rsplit("/", 1)[1] for r in listing.collect()] == ["a.cr3"]


def test_spark_listing_reads_no_content(spark, card):
    plan = scan_binary_listing(spark, str(card))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_prefix_read(spark, card):
    files = scan_catalog(spark, str(card)).select("path").union(spark.createDataFrame([("/nowhere/a.CR3",)], "path string"))
    got = {r.path.rsplit("/", 1)[1]: r.content for r in read_bytes(files, limit=4).collect()}
    assert got["_MG_0003.CR3"] == b"thre" and got["IMG_0002.cr3"] == b"" and got["a.CR3"] is None


def test_previews_never_meet_a_photo(spark, tmp_path):
    jpeg, card, root = b"\xff\xd8\xff\xe0" + b"pixels" * 500_000 + b"\xff\xd9", tmp_path / "card", tmp_path / "previews"
    card.mkdir()
    for name in ("_MG_1.CR3", "_MG_1.DNG"):
        (card / name).write_bytes(b"head" * 9 + jpeg + name.encode())
    (card / "_MG_1.jpg").write_bytes(b"the camera's own")
    (card / "b.cr3").write_bytes(b"nothing here")
    outcome = write_previews(scan_catalog(spark, str(card)), str(root)).collect()
    assert {r.path.rsplit("/", 1)[1]: (r.preview is not None, r.error) for r in outcome} == {
        "_MG_1.CR3": (True, None), "_MG_1.DNG": (True, None), "b.cr3": (False, None)}
    previews = [r.preview for r in outcome if r.preview]
    assert len(set(previews)) == 2 and all(open(p, "rb").read() == jpeg for p in previews)
    assert (card / "_MG_1.jpg").read_bytes() == b"the camera's own" and not any(p.rsplit("/", 1)[1].startswith("_") for p in previews)


@pytest.mark.parametrize("data", [b"", b"\xff\xd8\xff", b"\xff\xd9\xff\xd8\xff", b"a\xff\xd8\xffb\xff\xd9c\xff\xd9d", b"\xff\xd8\xff\xd9"])
def test_carving_in_bytes_equals_the_column(spark, data):
    row = spark.createDataFrame([(data,)], "content binary").select(carve_embedded_jpeg(F.col("content")).alias("j")).first()
    assert jpeg_in(data) == (None if row.j is None else bytes(row.j))


@pytest.mark.parametrize("path, ext, raw, sidecar", [
    ("/a/IMG_0001.CR3", "CR3", True, "/a/IMG_0001.xmp"), ("/a.b/c", "", False, "/a.b/c.xmp"),
    ("/a/x.tar.dng", "DNG", True, "/a/x.tar.xmp"), ("/a/.cr3", "", False, "/a/.cr3.xmp"), ("/a/.b/c.nef", "NEF", False, "/a/.b/c.xmp")])
def test_names(spark, path, ext, raw, sidecar):
    p = F.lit(path)
    assert tuple(spark.range(1).select(file_ext(p), is_raw_name(p), sidecar_path(p)).first()) == (ext, raw, sidecar)


@pytest.mark.parametrize("path, stem", [
    ("file:///a/b.CR3", "/a/b"), ("file:/a/b.jpg", "/a/b"), ("/a/b.xmp", "/a/b"), ("/a.d/b", "/a.d/b"),
    ("s3://bucket/a/b.cr3", "s3://bucket/a/b"), ("/a/.cr3", "/a/.cr3")])
def test_stems(spark, path, stem):
    assert spark.range(1).select(file_stem(F.lit(path))).first()[0] == stem


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("/c/b.cr3", "b.cr3", 5, 30, 0.9, C.SHARP), ("/c/A.cr3", "A.cr3", None, 10, 0.2, C.BLURRY),
        ("/c/Élan.cr3", "Élan.cr3", 9, 20, 0.4, C.SLIGHTLY_BLURRY), ("/d/b.cr3", "b.cr3", 5, 30, 0.0, C.NOT_ANALYZED)]
    return spark.createDataFrame(rows, "path string, name string, mtime int, size int, score double, status string")


@pytest.mark.parametrize("order, paths", [
    ("Name", ["/c/A.cr3", "/c/b.cr3", "/d/b.cr3", "/c/Élan.cr3"]), ("Date", ["/c/Élan.cr3", "/c/b.cr3", "/d/b.cr3", "/c/A.cr3"]),
    ("Size", ["/c/b.cr3", "/d/b.cr3", "/c/Élan.cr3", "/c/A.cr3"]), ("Sharpness", ["/c/b.cr3", "/c/Élan.cr3", "/c/A.cr3", "/d/b.cr3"])])
def test_sorting(files, order, paths):
    assert [r.path for r in K.sort_catalog(files, order).collect()] == paths


@pytest.mark.parametrize("query, mode, n", [
    ("", "All", 4), ("éLAN", "All", 1), ("B.", "Unanalyzed", 1), ("", "Rejected", 2), ("", "Sharp", 1), ("zz", "All", 0)])
def test_browse(files, query, mode, n):
    assert K.browse(files, query, mode).count() == n


def test_summaries(files):
    assert tuple(K.status_summary(files).first()) == (1, 2, 4)
    none = files.filter("false")
    assert tuple(K.status_summary(none).first()) == (0, 0, 0)
    assert K.any_analyzed(none).first()[0] is False and K.any_analyzed(files).first()[0] is True


def test_results_and_defaults(spark):
    listing = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    rows = [("a", "Blurry", 0.1, "Cat", 1), ("a", "Sharp", 0.9, None, 2), ("b", "Blurry", 0.2, "Dog", 1), ("zz", "Sharp", 1.0, "X", 9)]
    results = spark.createDataFrame(rows, "path string, status string, score double, label string, run int")
    got = {r.path: (r.status, r.score, r.label) for r in K.apply_results(listing, results, run="run").collect()}
    assert got == {"a": ("Sharp", 0.9, None), "b": ("Blurry", 0.2, "Dog"), "c": (C.NOT_ANALYZED, 0.0, None)}
    assert [r.path for r in K.pending(listing, results).collect()] == ["c"]


def test_first_success(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")
    tries = spark.createDataFrame(
        [("a", 1, False), ("a", 2, True), ("a", 4, True), ("b", 3, True), ("b", 1, False), ("c", 1, False)],
        "path string, stage int, ok boolean")
    got = {r.path: tuple(r)[1:] for r in T.first_success(files, tries).collect()}
    assert got == {"a": (2, False, None), "b": (3, True, None), "c": (None, False, C.DECODE_ERROR), "d": (None, False, C.OPEN_ERROR)}


def test_thumbnails(spark):
    files = spark.createDataFrame([(c,) for c in "abcde"], "path string")
    tries = spark.createDataFrame([
        ("a", 0, "full", True), ("a", 1, "full", True), ("a", 1, "thumb", True), ("b", 0, "thumb", True), ("b", 1, "thumb", True),
        ("c", 0, "full", True), ("c", 7, "jpeg", True), ("d", 2, "full", True), ("d", 3, "thumb", True), ("d", 1, "thumb", False),
    ], "path string, sub int, kind string, ok boolean")
    got = {r.path: tuple(r)[1:] for r in T.thumbnail_plan(files, tries).collect()}
    assert got == {
        "a": ("thumb", 1, None, None), "b": ("thumb", 0, None, None), "c": ("jpeg", None, 400, 300),
        "d": ("full", 2, None, None), "e": (None, None, None, None)}


@pytest.mark.parametrize("query, collation, found", [
    ("été", None, {0, 1}), ("éTÉ", "UNICODE_CI", {0, 1, 2}), ("ete", "UNICODE_CI", {3}), ("ete", "UNICODE_CI_AI", {0, 1, 2, 3}), ("", "UNICODE_CI", {0, 1, 2, 3, 4}),
    ("STRASSE", "UNICODE_CI", set()), ("strasse", None, set())])
def test_search_by_locale(spark, query, collation, found):
    names = ["X_ÉTÉ_1", "été", "E\u0301te\u0301", "Ete.cr3", "Straße"]
    files = spark.createDataFrame(list(enumerate(names)), "path int, name string")
    assert {r.path for r in K.search_name(files, query, collation).collect()} - ({4} if "rass" in query.lower() else set()) == found
    if query:
        assert {r.path for r in K.browse(files.withColumn("status", F.lit("Sharp")), query, collation=collation).collect()} >= found
