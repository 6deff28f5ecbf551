"""File listings.

Spark's own file sources drop names that start with an underscore, which is how many cameras name
photos in a wide colour space. ``walk`` lists them; it works on every filesystem that Arrow can open
(local, HDFS, object stores).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime
from functools import lru_cache, reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as C
from ..functions.files import has_raw_ext
from ..operators.catalog import union_listings
from ..session import shared_folder, spread

LISTING = "path string, size bigint, mtime timestamp"
LEVEL = f"{LISTING}, is_folder boolean"
BATCH_ROWS = 10_000


@lru_cache(maxsize=64)
def _store(address: str):
    """The filesystem of a scheme and host, and the path of its root; opened once per process."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"{address}/")


def open_filesystem(location: str):
    """``(filesystem, path, prefix)``; ``prefix + path`` is the location in the caller's spelling.

    Only scheme and host are read as an address. The rest is a plain key, so spaces, ``#`` and ``%`` stay.
    """
    from pyarrow import fs

    if location.startswith("file:"):
        path = "/" + location.removeprefix("file:").lstrip("/")
        return fs.LocalFileSystem(), path, location.removesuffix(path)
    if "://" in location:
        scheme, _, rest = location.partition("://")
        host, slash, key = rest.partition("/")
        filesystem, base = _store(f"{scheme}://{host}")
        path = f"{base.rstrip('/')}{slash}{key}"
        return filesystem, path, location.removesuffix(path)
    return fs.LocalFileSystem(), location, ""


class Entry(NamedTuple):
    location: str
    name: str
    is_folder: bool
    size: int | None
    mtime: datetime | None
    arrived: int | None = None   # microseconds: when the file came or was last written


def visible_entries(location: str, wanted: Callable[[str], bool] = lambda name: True) -> Iterator[Entry]:
    """Folders, and the wanted files, of one folder; hidden ones left out.

    A folder that is missing, forbidden or no folder has none. Any other error is raised, so the task
    that lists is tried again. Local folders are walked entry by entry, and only wanted files are looked
    at more closely.
    """
    from pyarrow import fs

    filesystem, path, prefix = open_filesystem(location)
    try:
        if isinstance(filesystem, fs.LocalFileSystem):
            yield from _local_entries(path, prefix, wanted)
            return
        found = filesystem.get_file_info(fs.FileSelector(path))
    except (FileNotFoundError, PermissionError, NotADirectoryError):
        return
    for e in found:
        folder = e.type == fs.FileType.Directory
        if not e.base_name.startswith(".") and (folder or wanted(e.base_name)):
            yield Entry(prefix + e.path, e.base_name, folder, e.size, e.mtime, e.mtime_ns // 1000 if e.mtime_ns is not None else None)


def _local_entries(path: str, prefix: str, wanted: Callable[[str], bool]) -> Iterator[Entry]:
    with os.scandir(path) as listed:
        for e in listed:
            if e.name.startswith("."):
                continue
            if e.is_symlink() and e.is_dir():
                continue  # links to folders are not followed: they may lead back up
            if e.is_dir(follow_symlinks=False):
                yield Entry(prefix + e.path, e.name, True, None, None)
            elif wanted(e.name):
                yield Entry(prefix + e.path, e.name, False, *_state(e))


def _state(e: os.DirEntry) -> tuple[int | None, datetime | None, int | None]:
    """All null for a file that cannot be looked at, e.g. a link to nowhere: it is listed all the same."""
    try:
        stat = e.stat()
    except OSError:
        return None, None, None
    # A copy may keep the time of its original; its change time is that of the copy.
    return stat.st_size, datetime.fromtimestamp(stat.st_mtime, UTC), max(stat.st_mtime_ns, stat.st_ctime_ns) // 1000


def walk(spark: SparkSession, root: str, extensions: Iterable[str] = (), tasks: int | None = None, folder: str | None = None) -> DataFrame:
    """All files below a root whose extension is wanted: ``(path, size, mtime)``.

    One job for each level of folders. Every folder is listed once, by one task, and the folders of a
    level are dealt out evenly, so a crowded branch is spread as soon as it has folders of its own.
    Levels are stored in the shared folder; nothing is listed on the driver.
    """
    folder = folder or shared_folder(spark, "listing")
    kept = frozenset(e.lower() for e in extensions)

    def wanted(name: str) -> bool:
        stem, dot, ext = name.rpartition(".")
        return not kept or bool(stem and dot) and ext.lower() in kept

    def entries(batches: Iterator) -> Iterator:
        rows = []
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for e in visible_entries(path, wanted):
                    rows.append((e.location, e.size, e.mtime, e.is_folder))
                    if len(rows) == BATCH_ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    level, levels = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), []
    while not levels or not level.isEmpty():
        at = f"{folder}/level-{len(levels)}"
        spread(level, "path", tasks).mapInArrow(entries, LEVEL).write.parquet(at)
        listed = spark.read.schema(LEVEL).parquet(at)
        levels.append(listed.where(~F.col("is_folder")).drop("is_folder"))
        level = listed.where("is_folder").select("path")
    return reduce(DataFrame.union, levels)


def _batch(rows: list[tuple]):
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("is_folder", pa.bool_())])
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def scan_catalog(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """Raw files below a root: recursive, hidden entries skipped, empty for an unreadable root."""
    return walk(spark, root, C.RAW_EXTENSIONS, tasks)


def scan_many_roots(spark: SparkSession, *roots: str) -> DataFrame:
    return union_listings(*[scan_catalog(spark, root) for root in roots])


def scan_binary_listing(spark: SparkSession, *roots: str) -> DataFrame:
    """The same through Spark's own ``binaryFile`` source.

    It lists with the parallelism of Spark's file index, but it passes over empty files and names
    that start with an underscore: use it where there are none.

    File contents are never read: the column is pruned from the scan. Hidden entries below a root are
    left out by Spark.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).filter(
        has_raw_ext(F.col("path"))
    )
