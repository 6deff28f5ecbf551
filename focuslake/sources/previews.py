"""Previews: the images to score, apart from the photos, in folders that can be read one by one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ..session import spread
from .files import read_head, store_file
from .headers import jpeg_in

# Folders above a preview, each named by one hexadecimal digit: 4,096 folders at the bottom.
LEVELS = 3
IMAGES = {"jpg": "jpg", "jpeg": "jpg", "png": "png"}


def preview_name(path: str) -> str:
    """A name no other file has, and that Spark's image source sees."""
    stem, _, ext = path.rpartition("/")[2].rpartition(".")
    return f"{hashlib.sha256(path.encode()).hexdigest()[:20]}-{stem}.{IMAGES.get(ext.lower(), 'jpg')}"


def preview_place(path: str) -> str:
    """The preview's path below the root of all previews."""
    name = preview_name(path)
    return "/".join([*name[:LEVELS], name])


def place_digits(preview: Column) -> Column:
    """The names of the folders above a preview on end."""
    return F.array_join(F.slice(F.split(preview, "/"), -LEVELS - 1, LEVELS), "")


def write_previews(files: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """Writes a preview of every file below ``root``: ``(path, preview, error)`` for all files.

    The preview of a raw file is the JPEG inside; a JPEG or PNG file is copied as it is, since Spark's image source passes
    over names that begin with an underscore. A file is read, cut and its preview written by one task, so no content leaves it.
    Names are digests of the whole path: previews never meet a photo, and those of files of one stem do not meet each other.
    Their first digits name the folders above. ``preview`` is null where there is nothing to write or writing failed.
    Nothing happens until the result is read.
    """
    root = root.rstrip("/")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("preview", pa.string()), ("error", pa.string())])
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                data, error = read_head(path, None)
                if data is not None and path.rpartition(".")[2].lower() not in IMAGES:
                    data = jpeg_in(data)
                target = f"{root}/{preview_place(path)}" if data else None
                error = store_file(target, data) if target else error
                rows.append((path, None if error else target, error))
            if rows:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return spread(files.select("path"), "path", tasks).mapInArrow(write, "path string, preview string, error string")
