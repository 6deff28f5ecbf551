"""The listing as a data source, for batches and for streams.

    register_sources(spark)
    spark.read.format("catalog_walk").option("content", "2097152").load("/mnt/cards").where("ext in ('CR3', 'NEF') and size > 0")
    spark.readStream.format("catalog_walk").load("/mnt/cards")

Rows are ``(path, name, ext, size, mtime)``, with ``ext`` in upper case, and ``content, error`` where content is asked
for. Hidden entries are left out, names that begin with an underscore are not. Options:

    content   "none" (default), "all", or the number of bytes to read from the beginning of every file
    splits    folders to find on the driver before tasks take over (64): each folder known then is one task
    settle    streams: seconds that a file must have been there before it is read (2); more than clocks differ

The driver lists folders from the top until ``splits`` are known; every task walks down from its own. A branch that holds most files stays
one task: ``walk`` deals such a tree out level by level. Filters on name, path, extension, size and time are applied to entries before any content is read.

A stream's offset is a time. A micro-batch holds the files that arrived since the last one: by their change
time on local disks (a copy may keep the time of its original) and their modification time elsewhere. Tasks list the folders again for each
batch, and nothing is remembered but the time, so a stream that goes on after a stop reads every file once. One that is
written again arrives again.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from ..functions import constants as C
from .files import read_head
from .listing import BATCH_ROWS, Entry, visible_entries

FORMAT = "catalog_walk"
SCHEMA = "path string, name string, ext string, size bigint, mtime timestamp"
CONTENT = "content binary, error string"
BATCH_BYTES = 64 * 1024 * 1024
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register_sources(spark: SparkSession) -> SparkSession:
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(CatalogWalk)
    return spark


def extension(name: str) -> str:
    stem, dot, ext = name.rpartition(".")
    return ext.upper() if stem and dot else ""


@dataclass(frozen=True)
class Options:
    root: str
    content: str
    splits: int
    settle: float

    @classmethod
    def of(cls, options) -> Options:
        if not options.get("path"):
            raise ValueError("catalog_walk needs a folder")
        content = options.get("content", "none").lower()
        if content not in ("none", "all") and not content.isdigit():
            raise ValueError(f"content is none, all or a number of bytes, not {content}")
        return cls(options["path"], content, int(options.get("splits", 64)), float(options.get("settle", 2)))

    @property
    def limit(self) -> int | None:
        return int(self.content) if self.content.isdigit() else None


@dataclass
class Branch(D.InputPartition):
    """A folder, with all below it or by itself."""

    folder: str
    deep: bool


def branches(root: str, splits: int) -> list[Branch]:
    flat, below = [], deque([root.rstrip("/") or "/"])
    while below and len(flat) + len(below) < max(splits, 2):
        folder = below.popleft()
        flat.append(Branch(folder, False))
        below.extend(e.location for e in visible_entries(folder, lambda name: False) if e.is_folder)
    return flat + [Branch(folder, True) for folder in below]


def files_of(branch: Branch) -> Iterator[Entry]:
    below = [branch.folder]
    while below:
        for e in visible_entries(below.pop()):
            if not e.is_folder:
                yield e
            elif branch.deep:
                below.append(e.location)


# --- filters --------------------------------------------------------------------------------------

COLUMNS: dict[str, Callable[[Entry], object]] = {
    "path": lambda e: e.location, "name": lambda e: e.name, "ext": lambda e: extension(e.name), "size": lambda e: e.size, "mtime": lambda e: e.mtime}

COMPARISONS: dict[type, Callable[[object, object], bool]] = {
    D.EqualTo: lambda a, b: a == b, D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b,
    D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b, D.In: lambda a, b: a in b,
    D.StringStartsWith: lambda a, b: a.startswith(b), D.StringEndsWith: lambda a, b: a.endswith(b), D.StringContains: lambda a, b: b in a}


@dataclass(frozen=True)
class Condition:
    column: str
    kind: type
    value: object = None

    def holds(self, e: Entry) -> bool:
        found = COLUMNS[self.column](e)
        return found is not None and (self.kind is D.IsNotNull or COMPARISONS[self.kind](found, self.value))


def _in_utc(value):
    return value.replace(tzinfo=UTC) if isinstance(value, datetime) and value.tzinfo is None else value


def condition(f: D.Filter) -> Condition | None:
    """None for a filter that Spark has to apply itself."""
    if len(f.attribute if hasattr(f, "attribute") else ()) != 1 or f.attribute[0] not in COLUMNS:
        return None
    column = f.attribute[0]
    if type(f) is D.IsNotNull:
        return Condition(column, D.IsNotNull)
    if type(f) not in COMPARISONS or getattr(f, "value", None) is None:
        return None
    value = frozenset(_in_utc(v) for v in f.value if v is not None) if type(f) is D.In else _in_utc(f.value)
    return Condition(column, type(f), value)


# --- reading --------------------------------------------------------------------------------------

def batches(found: Iterator[Entry], options: Options) -> Iterator:
    """Arrow batches of bounded size; files are opened one after another."""
    import pyarrow as pa

    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary(), pa.string()]
    names = ["path", "name", "ext", "size", "mtime", "content", "error"]
    wanted = 5 if options.content == "none" else 7

    def full(rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names[:wanted])

    rows, held = [], 0
    for e in found:
        row = (e.location, e.name, extension(e.name), e.size, e.mtime)
        if wanted == 7:
            data, error = read_head(e.location, options.limit)
            row += (data, error)
            held += len(data or b"")
        rows.append(row)
        if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
            yield full(rows)
            rows, held = [], 0
    if rows:
        yield full(rows)


class BatchReader(D.DataSourceReader):
    def __init__(self, options: Options):
        self.options = options
        self.conditions: list[Condition] = []

    def pushFilters(self, filters):
        for f in filters:
            c = condition(f)
            if c:
                self.conditions.append(c)
            else:
                yield f

    def partitions(self):
        return branches(self.options.root, self.options.splits)

    def read(self, partition: Branch):
        kept = (e for e in files_of(partition) if all(c.holds(e) for c in self.conditions))
        return batches(kept, self.options)


@dataclass
class Arrivals(Branch):
    """Files of a branch that came after ``since`` and no later than ``until``, in microseconds."""

    since: int
    until: int


class StreamReader(D.DataSourceStreamReader):
    def __init__(self, options: Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"time": 0}

    def latestOffset(self) -> dict:
        # A file that is there since before this time is listed whenever the batch is read.
        return {"time": int((time.time() - self.options.settle) * 1e6)}

    def partitions(self, start: dict, end: dict):
        if end["time"] <= start["time"]:
            return []
        return [Arrivals(b.folder, b.deep, start["time"], end["time"]) for b in branches(self.options.root, self.options.splits)]

    def read(self, partition: Arrivals):
        came = (e for e in files_of(partition) if e.arrived is not None and partition.since < e.arrived <= partition.until)
        return batches(came, self.options)


class CatalogWalk(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA if Options.of(self.options).content == "none" else f"{SCHEMA}, {CONTENT}"

    def reader(self, schema) -> BatchReader:
        return BatchReader(Options.of(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Options.of(self.options))


# --- the usual calls ------------------------------------------------------------------------------

def read_catalog(spark: SparkSession, root: str, content: int | str = "none", raw: bool = True, **options) -> DataFrame:
    """Raw files below a root, or all files."""
    files = register_sources(spark).read.format(FORMAT).options(content=str(content), **options).load(root)
    return files.where(files["ext"].isin(*(e.upper() for e in C.RAW_EXTENSIONS))) if raw else files


def stream_catalog(spark: SparkSession, root: str, content: int | str = "none", **options) -> DataFrame:
    """Files below a root as they arrive."""
    return register_sources(spark).readStream.format(FORMAT).options(content=str(content), **options).load(root)
