"""Keywords, sidecar text and files, and nested metadata."""

import os
import xml.dom.minidom
import xml.parsers.expat

import pytest
from pyspark.sql import functions as F

from focuslake.functions import constants as C, labels as L
from focuslake.operators.metadata import flatten_metadata, search_metadata
from focuslake.sources import sidecars as S
from focuslake.sources.listing import walk


@pytest.mark.parametrize("region, label, group", [
    (C.ANIMAL_HEAD, "Robin", "Birds"), (C.DETECTOR_BODY, "Red Fox", "Mammals"), (C.DETECTOR_EYES, "Bird", "Mammals"),
    (C.DETECTOR_EYES, "Parrot", "Mammals"), (C.DETECTOR_HEAD, "Bowl", "Birds"), (C.DETECTOR_HEAD, "Microwave", "Birds"),
    (C.DETECTOR_HEAD, "Person", "Mammals"), (C.AF_AND_SUBJECT, "Robin", "Wildlife"), (C.FULL_IMAGE, "Robin", "Wildlife"),
    (C.HUMAN_FACE, "Robin", "Wildlife"), (C.ANIMAL_EYES, None, "Mammals"), (None, "Robin", "Wildlife"),
    (C.ANIMAL_BODY, "WHITE-TAILED deer", "Birds")])
def test_group(spark, region, label, group):
    got = L.species_group(F.lit(region).cast("string"), F.lit(label).cast("string"))
    assert spark.range(1).select(got).first()[0] == group


def test_own_bird_terms(spark):
    got = L.species_group(F.lit(C.ANIMAL_HEAD), F.lit("Bird"), [*C.BIRD_TERMS, "bird"])
    assert spark.range(1).select(got).first()[0] == "Birds"


def test_lists():
    assert len(C.RAW_EXTENSIONS) == len(set(C.RAW_EXTENSIONS)) == 24
    assert len(C.ANIMALS) == len(set(C.ANIMALS)) == 54
    assert L.bird_subset() == [a for a in C.ANIMALS if a in C.BIRDS] and len(C.BIRDS) == 29
    assert len(C.CLASS_LABELS) == len(set(C.CLASS_LABELS)) == 80 and len(C.BIRD_TERMS) == len(set(C.BIRD_TERMS)) == 88


def test_class_labels(spark):
    df = spark.createDataFrame([(0,), (79,), (80,), (-1,), (None,)], "i int")
    assert [r[0] for r in df.select(L.class_label(F.col("i"))).collect()] == ["person", "toothbrush", "unknown", "unknown", "unknown"]


def test_document(spark):
    text = spark.range(1).select(L.build_xmp(F.lit('Bat & <"Co\'s">'), F.lit("Mammals"))).first()[0]
    parsed = xml.dom.minidom.parseString(text)
    items = [n.firstChild.data for n in parsed.getElementsByTagName("rdf:li")]
    assert items == ['Bat & <"Co\'s">', 'Wildlife|Mammals|Bat & <"Co\'s">']
    assert 'Wildlife > Mammals > Bat & <"Co\'s"> -->' in text and not text.endswith("\n")
    assert "<rdf:li>Bat &amp; &lt;&quot;Co&apos;s&quot;&gt;</rdf:li>" in text


def test_hyphens_break_the_comment(spark):
    label = F.lit("White -- tailed")
    text, broken = spark.range(1).select(L.build_xmp(label, F.lit("Birds")), L.breaks_comment(label)).first()
    assert broken and "Wildlife > Birds > White -- tailed -->" in text
    with pytest.raises(xml.parsers.expat.ExpatError):
        xml.dom.minidom.parseString(text)


def test_refresh_leaves_unlabelled_rows_alone(spark):
    files = spark.createDataFrame(
        [("/a/1.CR3", "Cat", False), ("/a/2.CR3", "Cat", True), ("/a/3.CR3", None, True), ("/a/4.CR3", None, False)],
        "path string, label string, xmp_written boolean")
    listed = spark.createDataFrame([("file:///a/1.xmp",), ("file:/a/4.xmp",)], "path string")
    got = {r.path: r.xmp_written for r in S.refresh_written(files, listed).collect()}
    assert got == {"/a/1.CR3": True, "/a/2.CR3": False, "/a/3.CR3": True, "/a/4.CR3": False}
    fresh = {r.path: r.xmp_written for r in S.refresh_written(files.drop("xmp_written"), listed).collect()}
    assert fresh == {"/a/1.CR3": True, "/a/2.CR3": False, "/a/3.CR3": False, "/a/4.CR3": False}


def test_files(spark, tmp_path):
    root = str(tmp_path)
    rows = [(f"{root}/a.CR3", C.ANIMAL_HEAD, "Robin"), (f"{root}/sub/b.CR3", C.ANIMAL_HEAD, "Fox"), (f"{root}/c.CR3", C.FULL_IMAGE, None),
            (f"{root}/d.CR3", C.FULL_IMAGE, ""), ("/proc/none/e.CR3", C.FULL_IMAGE, "Fox"), (f"{root}/old.CR3", C.FULL_IMAGE, "")]
    open(f"{root}/old.xmp", "w").close()
    files = spark.createDataFrame(rows, "path string, region string, label string")
    table = S.sidecar_table(files)
    outcome = S.write_sidecars(table).cache()
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.error) for r in outcome.collect()}
    assert got["a.CR3"] == got["b.CR3"] == ("written", None) and got["c.CR3"] == ("skipped", None)
    assert got["d.CR3"] == ("error", "d.CR3: " + C.NO_LABEL_ERROR)
    assert got["e.CR3"][0] == "error" and got["e.CR3"][1].startswith("e.CR3: Failed to write XMP file: ")
    assert tuple(S.write_summary(outcome).first()) == (2, 1, 3, "2 XMP file(s) written, 1 skipped, 3 error(s)")

    want = {r.path: r.xmp for r in table.collect()}
    assert open(f"{root}/sub/b.xmp", encoding="utf-8").read() == want[f"{root}/sub/b.CR3"]
    S.write_sidecars(table).collect()  # again: same files, nothing left over
    assert sorted(os.listdir(root)) == ["a.xmp", "old.xmp", "sub"] and os.listdir(f"{root}/sub") == ["b.xmp"]

    listed = walk(spark, root, ["xmp"])
    flags = {r.path.rsplit("/", 1)[1]: r.xmp_written for r in S.sidecar_exists(files, listed).collect()}
    # A sidecar from before counts, even where writing failed now.
    assert flags == {"a.CR3": True, "b.CR3": True, "c.CR3": False, "d.CR3": False, "e.CR3": False, "old.CR3": True}


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "path string, status string, error string")
    assert tuple(S.write_summary(empty).first()) == (0, 0, 0, "0 XMP file(s) written")


def flat(spark, doc):
    df = spark.createDataFrame([("p", doc)], "path string, doc string")
    return {r.key: r.value for r in flatten_metadata(df, key="path").withColumnRenamed("path", "file").collect()}


@pytest.mark.parametrize("doc, rows", [
    ('{"a":1}', {"a": "1"}), ("{}", {}), ("[1,2]", {}), ("not json", {}), (None, {}), ('"text"', {}),
    ('{"a":{"b":{"c":{"d":{"e":{"f":"deep"}}}}},"g":{"h":{}}}', {"a > b > c > d > e > f": "deep"}),
    ('{"l":[{"x":1},2],"n":null,"t":true,"s":"{\\"no\\":1}"}', {"l": '[{"x":1},2]', "n": "<null>", "t": "true", "s": '{"no":1}'}),
    ('{"a":{"b":1},"a > b":2}', {"a > b": "1"}), ('{"a > b":2,"a":{"b":1}}', {"a > b": "1"}),
    ('{"a":{"b > c":1,"b":{"c":2}},"a > b":{"c":3}}', {"a > b > c": "2"}),
])
def test_flatten(spark, doc, rows):
    assert flat(spark, doc) == rows


def test_flatten_is_deep(spark):
    depth = 40
    doc = '{"k":' * depth + "1" + "}" * depth
    assert flat(spark, doc) == {" > ".join(["k"] * depth): "1"}


def test_search_metadata(spark):
    rows = [("p", "Lens > Model", "RF 100"), ("p", "Body", "lensless"), ("p", "ISO", "100"), ("o", "Lens", None)]
    df = spark.createDataFrame(rows, "path string, key string, value string")
    assert [(r.path, r.key) for r in search_metadata(df, "LENS").collect()] == [("o", "Lens"), ("p", "Body"), ("p", "Lens > Model")]
    assert search_metadata(df, "").count() == 4


def sidecar_rows(spark, root, n=6):
    rows = [(f"{root}/{i}.CR3", C.ANIMAL_HEAD, ["Fox", None, ""][i % 3]) for i in range(n)]
    return S.sidecar_table(spark.createDataFrame(rows, "path string, region string, label string"))


def test_sink(spark, tmp_path):
    done = S.save_sidecars(sidecar_rows(spark, tmp_path / "files"), str(tmp_path / "summary"), tasks=3)
    assert tuple(done.first()) == (2, 2, 2, "2 XMP file(s) written, 2 skipped, 2 error(s)")
    assert sorted(os.listdir(tmp_path / "files")) == ["0.xmp", "3.xmp"]
    stored = spark.read.schema(S.SUMMARY).json(f"{tmp_path}/summary/summary.json").first()
    assert stored.examples == [f"{i}.CR3: {C.NO_LABEL_ERROR}" for i in (2, 5)]
    # Again: counts are those of the last run. Nothing to write is a summary too.
    assert S.save_sidecars(sidecar_rows(spark, tmp_path / "files"), str(tmp_path / "summary")).first().written == 2
    assert tuple(S.save_sidecars(sidecar_rows(spark, tmp_path / "files", 0), str(tmp_path / "none")).first())[:3] == (0, 0, 0)


def test_a_task_that_runs_again_counts_once(spark, tmp_path):
    batches = sidecar_rows(spark, tmp_path / "files").toArrow().to_batches(max_chunksize=2)
    writer = S.SidecarWriter(str(tmp_path / "summary"))

    def broken():
        yield batches[0]
        raise TimeoutError("lost")

    with pytest.raises(TimeoutError):
        writer.write(broken())
    message = writer.write(iter(batches))
    writer.commit([message, None])
    assert tuple(S.read_summary(spark, str(tmp_path / "summary")).first())[:3] == (2, 2, 2)
    assert sorted(os.listdir(tmp_path / "files")) == ["0.xmp", "3.xmp"]


def test_only_tables_of_sidecars_are_taken(spark, tmp_path):
    spark.dataSource.register(S.Sidecars)
    with pytest.raises(Exception, match="folder for the summary"):
        sidecar_rows(spark, tmp_path).write.format("sidecars").mode("append").save()
    with pytest.raises(Exception, match="missing"):
        spark.range(1).write.format("sidecars").option("summary", str(tmp_path)).mode("append").save()
