"""New and changed files of a stream of listings, by the state kept of every file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "size bigint, mtime timestamp"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastState(StatefulProcessor):
    """Keeps size and time of one file and passes a row on where they differ from the last ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows))
        # Of several listings in one micro-batch the latest counts, and of two of one time the larger file.
        last = seen.sort_values(["mtime", "size"], na_position="first").iloc[-1]
        size = None if pd.isna(last["size"]) else int(last["size"])
        mtime = None if pd.isna(last["mtime"]) else last["mtime"].to_pydatetime()
        known = self.state.get() if self.state.exists() else None
        if known is None or _differs(known[0], size) or _differs(known[1], mtime):
            self.state.update((size, mtime))
            yield pd.DataFrame({"path": [key[0]], "size": pd.array([size], "Int64"), "mtime": pd.to_datetime([mtime])})

    def close(self) -> None:
        pass


def _differs(a, b) -> bool:
    return not (pd.isna(a) and pd.isna(b)) and (pd.isna(a) != pd.isna(b) or _plain(a) != _plain(b))


def _plain(v):
    return pd.Timestamp(v).tz_localize(None) if hasattr(v, "year") else int(v)


def changed_files(files: DataFrame, key: str = "path") -> DataFrame:
    """``(path, size, mtime)`` of the files of a stream ``(path, size, mtime, ..)`` that are new or have changed since they came last.

    A listing may be sent as often as one likes: every file is passed on once for each state it is seen in. One row of state is kept for
    a file, partitioned by its path, for as long as the checkpoint lives. Rows without a path are left out.
    """
    files.sparkSession.conf.set(STORE, ROCKSDB)
    states = files.where(F.col(key).isNotNull()).select(F.col(key).alias("path"), F.col("size").cast("bigint"), F.col("mtime").cast("timestamp"))
    found = states.groupBy("path").transformWithStateInPandas(LastState(), "path string, size bigint, mtime timestamp", "Append", "None")
    return found.withColumnRenamed("path", key)
