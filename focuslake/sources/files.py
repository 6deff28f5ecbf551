"""Single files: read from the beginning, and written one per row by the tasks that hold the rows."""

from __future__ import annotations

import errno
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..session import spread
from .listing import open_filesystem


# Reading such a file again would end the same way.
HOPELESS = {errno.ENOENT, errno.EACCES, errno.EPERM, errno.ENOTDIR, errno.EISDIR, errno.ELOOP, errno.ENAMETOOLONG}


def read_head(location: str, limit: int | None) -> tuple[bytes | None, str | None]:
    """The first ``limit`` bytes of a file, or all of it, or the reason why there are none.

    Only a file that is missing or forbidden has no content. Any other error is raised, so that the task runs again.
    """
    filesystem, path, _ = open_filesystem(location)
    try:
        with filesystem.open_input_stream(path) as stream:
            return stream.read(limit), None
    except OSError as e:
        if isinstance(e, (FileNotFoundError, PermissionError)) or e.errno in HOPELESS:
            return None, str(e)
        # Opening a folder has no error number of its own.
        if type(e) is OSError and e.errno is None and not filesystem.get_file_info(path).is_file:
            return None, str(e)
        raise


def store_file(location: str, data: bytes) -> str | None:
    """Writes to a temporary name and renames, so repeating it is harmless. Returns an error text."""
    filesystem, path, _ = open_filesystem(location)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"

    def write() -> None:
        with filesystem.open_output_stream(draft) as out:
            out.write(data)

    try:
        try:
            write()
        except FileNotFoundError:
            filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
            write()
        filesystem.move(draft, path)
    except OSError as e:
        return str(e)
    return None


def write_files(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Writes ``(path, content)`` and returns ``(path, error)``; nothing happens until it is read."""

    def store(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("error", pa.string())])
        for batch in batches:
            done = [(r["path"], store_file(r["path"], r["content"])) for r in batch.to_pylist()]
            if done:
                yield pa.record_batch(list(zip(*done)), schema=schema)

    return spread(rows.select("path", "content"), "path", tasks).mapInArrow(store, "path string, error string")
