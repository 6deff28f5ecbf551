"""File headers, embedded JPEG data and the camera's focus-point tags."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions.binding import bind
from ..session import spread
from .files import read_head

BATCH_BYTES = 64 * 1024 * 1024


def read_bytes(files: DataFrame, limit: int | None = C.HEADER_BYTES, tasks: int | None = None) -> DataFrame:
    """``(path, content, error)``: the first ``limit`` bytes of every file, or all of it.

    Content is null, and ``error`` says why, for files that are missing or forbidden; other errors fail the task, which is run again.
    Only the prefix is fetched, which for raw files is a small part of the whole. Paths are dealt out
    evenly first, so a folder with very many files keeps no task busy alone. Batches are cut by size
    so that a task holds a bounded amount of content.
    """

    def fetch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        for batch in batches:
            rows, held = [], 0
            for path in batch.column("path").to_pylist():
                data, error = read_head(path, limit)
                rows.append((path, data, error))
                held += len(data or b"")
                if held >= BATCH_BYTES:
                    yield pa.record_batch(list(zip(*rows)), schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch(list(zip(*rows)), schema=schema)

    return spread(files.select("path"), "path", tasks).mapInArrow(fetch, "path string, content binary, error string")


def latin1(content: Column) -> Column:
    """One character per byte: Spark's text functions then count bytes."""
    return F.decode(content, "ISO-8859-1")


def carve(value: Column, text: Column, first: str, last: str) -> Column:
    """Part of ``value`` from the first ``first`` to the end of the last ``last``, null if not enclosed.

    ``text`` is ``value`` as a string with the same positions.
    """
    start = F.instr(text, F.lit(first))
    # The last occurrence is the first one in the reversed text.
    back = F.instr(F.reverse(text), F.lit(last[::-1]))
    end = F.length(text) - back + 1
    begins = end - len(last) + 1
    return F.when((start > 0) & (back > 0) & (begins >= start), F.substring(value, start, end - start + 1))


def carve_between(text: Column, first: str, last: str) -> Column:
    return carve(text, text, first, last)


def carve_embedded_jpeg(content: Column) -> Column:
    """From the first JPEG start marker to the last end marker."""
    found = carve(content, latin1(content), "ÿØÿ", "ÿÙ")
    return F.when(F.length(content) > 3, found)


def jpeg_in(data: bytes) -> bytes | None:
    """``carve_embedded_jpeg`` over bytes, for tasks that hold the file."""
    first, last = data.find(b"\xff\xd8\xff"), data.rfind(b"\xff\xd9")
    return data[first:last + 2] if len(data) > 3 and 0 <= first <= last else None


def _bytes(data: Column) -> Column:
    """The values of all bytes, taken apart in one go; null without any."""
    return F.when(F.length(data) > 0, F.transform(F.split(latin1(data), ""), lambda c: F.ascii(c).cast("bigint")))


def _unsigned(values: Column, at: Column | int, size: int, little: Column) -> Column:
    """Unsigned integer at a 0-based place of an array of bytes."""

    def number(shifts) -> Column:
        parts = [F.get(values, F.lit(at + i) if isinstance(at, int) else at + i) * (1 << 8 * k) for i, k in enumerate(shifts)]
        return reduce(lambda x, y: x + y, parts)

    return F.when(little, number(range(size))).otherwise(number(reversed(range(size))))


def find_box(content: Column, kind: str = "CMT3") -> Column:
    """Payload of the first valid container box of a kind, null without one.

    Four bytes before the name hold the box size, which must cover a payload and fit the data;
    otherwise the search goes on. The text is walked once, from name to name.
    """
    total = F.length(content)
    start = F.struct(F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("payload"))

    def look(acc: Column, piece: Column) -> Column:
        return bind(acc["pos"] + F.length(piece), lambda at: bind(box_size(at), lambda size: step(acc, at, size)))

    def box_size(at: Column) -> Column:
        return F.when(at >= 4, F.conv(F.hex(F.substring(content, at - 3, F.lit(4))), 16, 10).cast("bigint"))

    def step(acc: Column, at: Column, size: Column) -> Column:
        valid = (at < total - 8) & (size > 8) & (at - 4 + size <= total)
        payload = F.when(valid, F.substring(content, at + 5, (size - 8).cast("int")))
        return F.struct((at + 4).alias("pos"), F.coalesce(acc["payload"], payload).alias("payload"))

    def walk(pieces: Column) -> Column:
        # The last piece is followed by no name.
        return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, look)["payload"]

    return F.when(total > 16, bind(F.split(latin1(content), kind), walk))


def directory_tags(box: Column, little: Column) -> Column:
    """``array<struct<entry, tag, cnt, vals>>``: the first readable entry of each focus-point tag.

    Values are read as 16-bit integers whatever type the entry declares. Only the directory and the values of the
    chosen entries are taken apart, whatever the size of the box.
    """
    total = F.length(box)

    def part(at: Column, size: Column) -> Column:
        return _bytes(F.substring(box, (at + 1).cast("int"), size.cast("int")))

    def listed(directory: Column, first: Column, whole: Column) -> Column:
        def described(i: Column) -> Column:
            return F.struct(i.alias("entry"), _unsigned(directory, i * 12, 2, little).cast("int").alias("tag"),
                            _unsigned(directory, i * 12 + 4, 4, little).alias("cnt"))

        def placed(e: Column) -> Column:
            start = F.when(e["cnt"] * 2 > 4, _unsigned(directory, e["entry"] * 12 + 8, 4, little)).otherwise(first + e["entry"] * 12 + 10)
            return F.struct(e["entry"], e["tag"], e["cnt"], start.alias("start"))

        numbers = F.filter(F.sequence(F.lit(0), whole - 1), lambda i: _unsigned(directory, i * 12, 2, little).isin(*C.AF_TAGS))
        return F.filter(F.transform(F.transform(numbers, described), placed), lambda e: e["start"] + e["cnt"] * 2 <= total)

    def first_of(found: Column, tag: int) -> Column:
        return F.get(F.filter(found, lambda e: e["tag"] == tag), F.lit(0))

    def pick(found: Column) -> Column:
        return F.filter(F.array(*[first_of(found, t) for t in C.AF_TAGS]), lambda e: e.isNotNull())

    def with_values(e: Column) -> Column:
        def signed(values: Column, k: Column) -> Column:
            return (_unsigned(values, k * 2, 2, little).bitwiseXOR(F.lit(32768)) - 32768).cast("int")

        def read(values: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), e["cnt"].cast("int") - 1), lambda k: signed(values, k))

        vals = F.when(e["cnt"] > 0, bind(part(e["start"], e["cnt"] * 2), read)).otherwise(F.array().cast("array<int>"))
        return F.struct(e["entry"], e["tag"], e["cnt"].cast("int").alias("cnt"), vals.alias("vals"))

    def walk(d: Column) -> Column:
        # Entries that the box cuts off are not read.
        whole = F.least(d["entries"], F.floor((total - d["first"] - 2) / 12)).cast("int")
        found = F.when(whole > 0, bind(part(d["first"] + 2, d["entries"] * 12), lambda directory: listed(directory, d["first"], whole)))
        chosen = F.transform(bind(found, pick), with_values)
        none = F.array().cast("array<struct<entry: int, tag: int, cnt: int, vals: array<int>>>")
        return F.when((d["entries"] > 0) & (d["entries"] < 500), F.coalesce(chosen, none))

    def heading(head: Column) -> Column:
        sound = F.hex(F.substring(box, 1, 2)).isin("4949", "4D4D") & (_unsigned(head, 2, 2, little) == 42)
        return F.when((total > 8) & sound, _unsigned(head, 4, 4, little))

    def entries(first: Column) -> Column:
        size = bind(part(first, F.lit(2)), lambda two: _unsigned(two, 0, 2, little))
        return F.struct(first.alias("first"), F.when(first + 2 < total, size).alias("entries"))

    return bind(bind(bind(_bytes(F.substring(box, 1, 8)), heading), entries), walk)


def tag_array(content: Column) -> Column:
    """The focus-point tags of a header in order of preference, null without any."""

    def tags(box: Column) -> Column:
        return bind(F.hex(F.substring(box, 1, 1)) == "49", lambda little: directory_tags(box, little))

    return bind(find_box(content), tags)


def extract_af_tags(headers: DataFrame, key: str = "path") -> DataFrame:
    """``(path, entry, tag, cnt, vals)`` from ``(path, content)``; every step stays inside its row."""

    found = headers.select(key, tag_array(F.col("content")).alias("_tags"))
    # The outer form keeps Spark from testing the array in a filter of its own, which would parse twice.
    return found.select(key, F.inline_outer("_tags")).filter(F.col("tag").isNotNull())
