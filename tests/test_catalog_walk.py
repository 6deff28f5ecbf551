"""The listing as a data source: batches, pushed filters, streams."""

import os
import time

import pytest
from pyspark.sql import functions as F

from focuslake.sources import catalog_walk as W, files
from focuslake.sources.files import read_head
from focuslake.sources.headers import read_bytes
from focuslake.sources.listing import scan_catalog, walk
from focuslake.sources.previews import write_previews


@pytest.fixture
def card(tmp_path):
    root = tmp_path / "card"
    made = {"a.CR3": 5, "DCIM/100/_MG_1.CR3": 9, "DCIM/100/b.cr3": 0, "DCIM/101/deep/er/c.NEF": 70, "DCIM/101/d.jpg": 3, ".hid/x.CR3": 1,
            "DCIM/.y.CR3": 1, "DCIM/100/noext": 2, "DCIM/100/.": None, "DCIM/102/ünï #1%20.3fr": 4}
    for name, size in made.items():
        if size is not None:
            path = root / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(b"0123456789"[:1] * size)
    (root / "gone.cr3").symlink_to(root / "missing")
    (root / "DCIM" / "up").symlink_to(root)
    return str(root)


@pytest.mark.parametrize("splits", [1, 3, 64])
@pytest.mark.parametrize("prefix", ["", "file://"])
def test_equals_walk(spark, card, splits, prefix):
    got = W.read_catalog(spark, prefix + card, raw=False, splits=splits).select("path", "size", "mtime")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, walk(spark, prefix + card).collect()), key=repr)
    raw = W.read_catalog(spark, prefix + card, splits=splits).select("path", "size")
    assert sorted(map(tuple, raw.collect()), key=repr) == sorted((r.path, r.size) for r in scan_catalog(spark, prefix + card).collect())


def test_each_folder_is_in_one_branch(card):
    for splits in (1, 2, 4, 100):
        seen = [e.location for b in W.branches(card, splits) for e in W.files_of(b)]
        assert len(seen) == len(set(seen)) == 8


def test_content_equals_read_bytes(spark, card):
    for content, limit in ((4, 4), ("all", None)):
        got = W.read_catalog(spark, card, content).select("path", "content", F.col("error").isNull().alias("fine"))
        want = read_bytes(scan_catalog(spark, card), limit).select("path", "content", F.col("error").isNull().alias("fine"))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        assert got.where("not fine").count() == 1


CASES = ["ext = 'CR3'", "ext in ('CR3', 'NEF')", "size > 4", "size >= 5 and size <= 9", "size < 3", "name like '_MG%'", "name like '%.cr3'", "path like '%101%'",
         "size is not null", "size is null", "mtime > timestamp'2001-01-01'", "mtime <= timestamp'2001-01-01'", "ext = 'CR3' or size = 3", "size + 1 = 6",
         "name in ('a.CR3', null)", "not ext = 'CR3'", "ext <=> 'NEF'", "size = null"]


@pytest.mark.parametrize("case", CASES)
def test_filters(spark, card, case):
    all_files = spark.createDataFrame(W.read_catalog(spark, card, raw=False).collect(), W.SCHEMA)
    got = W.read_catalog(spark, card, raw=False).where(case).select("path")
    assert sorted(got.collect()) == sorted(all_files.where(case).select("path").collect())


def test_filters_reach_the_listing(spark, card, monkeypatch):
    found = W.read_catalog(spark, card, "all").where("size > 4")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = found._jdf.queryExecution().explainString(mode)
    pushed = next(x for x in plan.splitlines() if x.startswith("PushedFilters"))
    assert "GreaterThan(size,4)" in pushed and "In(ext" in pushed and "Filter (" not in plan
    reader = W.BatchReader(W.Options(card, "all", 64, 0))
    list(reader.pushFilters([W.D.GreaterThan(("size",), 10)]))
    opened = []
    monkeypatch.setattr(W, "read_head", lambda path, limit: opened.append(path) or (b"", None))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1 and len(opened) == 1


def test_options_are_checked(spark, card):
    with pytest.raises(Exception, match="content is none"):
        W.read_catalog(spark, card, "some").count()
    assert W.read_catalog(spark, card + "/missing").count() == 0


def test_only_hopeless_errors_give_no_content(spark, card, monkeypatch):
    assert read_head(f"{card}/missing", 4)[0] is None and "missing" in read_head(f"{card}/missing", 4)[1]
    assert read_head(card, 4)[0] is None and read_head(f"{card}/a.CR3", 2) == (b"00", None)

    class Slow:
        def open_input_stream(self, path):
            raise TimeoutError("no answer")

    monkeypatch.setattr(files, "open_filesystem", lambda location: (Slow(), location, ""))
    with pytest.raises(TimeoutError):
        read_head(f"{card}/a.CR3", 4)


def test_missing_files_are_named(spark, tmp_path):
    rows = write_previews(spark.createDataFrame([(f"{tmp_path}/none.cr3",)], "path string"), str(tmp_path / "p")).collect()
    assert rows[0].preview is None and "none.cr3" in rows[0].error


def run(spark, root, out, checkpoint, content="none"):
    time.sleep(0.3)
    files = W.stream_catalog(spark, root, content, settle="0.2")
    files.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return sorted(r.name for r in spark.read.parquet(out).collect()) if os.path.isdir(out) and any(n.endswith(".parquet") for n in os.listdir(out)) else []


def test_stream_reads_every_file_once(spark, card, tmp_path):
    """Names with underscores, empty files, a restart, a copy with an old time, a folder that comes later, and a file written again."""
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    first = ["_MG_1.CR3", "a.CR3", "b.cr3", "c.NEF", "d.jpg", "noext", "ünï #1%20.3fr"]
    assert run(spark, card, out, checkpoint, "3") == sorted(first)
    assert run(spark, card, out, checkpoint, "3") == sorted(first)
    os.makedirs(f"{card}/new/folder")
    for name, at in ((f"{card}/new/folder/_MG_2.CR3", 1e9), (f"{card}/e.CR3", None)):
        with open(name, "wb") as f:
            f.write(b"xyz!")
        if at:
            os.utime(name, (at, at))
    assert run(spark, card, out, checkpoint, "3") == sorted([*first, "_MG_2.CR3", "e.CR3"])
    with open(f"{card}/e.CR3", "ab") as f:
        f.write(b"more")
    assert run(spark, card, out, checkpoint, "3") == sorted([*first, "_MG_2.CR3", "e.CR3", "e.CR3"])
    assert bytes(spark.read.parquet(out).where("name = '_MG_2.CR3'").first().content) == b"xyz"
