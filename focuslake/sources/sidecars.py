"""Sidecar table and sidecar files."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, datasource as D, functions as F

from ..functions import constants as C
from ..functions.files import file_name, plain_path
from ..functions.labels import build_xmp, sidecar_path, species_group
from ..session import spread
from .files import store_file

WRITTEN, SKIPPED, ERROR = "written", "skipped", "error"


def sidecar_table(files: DataFrame) -> DataFrame:
    """``(path, sidecar_path, xmp, status, error)`` from ``(path, region, label)``.

    A missing label is skipped, an empty one is an error; both leave ``xmp`` null. ``status`` is
    what writing the row comes to if the storage accepts it.
    """
    label = F.col("label")
    usable = label.isNotNull() & (label != "")
    group = species_group(F.col("region"), label)
    status = F.when(label.isNull(), SKIPPED).when(usable, WRITTEN).otherwise(ERROR)
    message = F.concat(file_name(F.col("path")), F.lit(": " + C.NO_LABEL_ERROR))
    return files.select(
        "path",
        sidecar_path(F.col("path")).alias("sidecar_path"),
        F.when(usable, build_xmp(label, group)).alias("xmp"),
        status.alias("status"),
        F.when(status == ERROR, message).alias("error"),
    )


def store_sidecar(row: dict) -> tuple[str, str | None]:
    """Writes one row of ``sidecar_table`` if there is something to write: its status and error afterwards."""
    if row["xmp"] is None:
        return row["status"], row["error"]
    failure = store_file(row["sidecar_path"], row["xmp"].encode("utf-8"))
    if failure:
        name = row["path"].rsplit("/", 1)[-1]
        return ERROR, f"{name}: Failed to write XMP file: {failure}"
    return row["status"], row["error"]


def write_sidecars(table: DataFrame, tasks: int | None = None) -> DataFrame:
    """Writes the rows of ``sidecar_table`` and returns ``(path, status, error)``.

    Every file is written to a temporary name and renamed, so a task that runs twice leaves the same
    result. The status is computed while writing: store it before counting it. Where counts are all that is
    wanted, ``save_sidecars`` needs no table.
    """

    def store(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("status", pa.string()), ("error", pa.string())])
        for batch in batches:
            rows = [(r["path"], *store_sidecar(r)) for r in batch.to_pylist()]
            if rows:
                yield pa.record_batch(list(zip(*rows)), schema=schema)

    return spread(table.select(*TABLE), "path", tasks).mapInArrow(store, "path string, status string, error string")


# --- sidecars as a sink ---------------------------------------------------------------------------

TABLE = ["path", "sidecar_path", "xmp", "status", "error"]
SUMMARY = "written bigint, skipped bigint, errors bigint, examples array<string>"
EXAMPLES = 100       # error texts kept in a summary


@dataclass
class Stored(D.WriterCommitMessage):
    """What one task did."""

    counts: Counter = field(default_factory=Counter)
    examples: list[str] = field(default_factory=list)


class SidecarWriter(D.DataSourceArrowWriter):
    """Files are renamed into place by the tasks; what they come to is added up when all are done.

    Only the messages of attempts that succeeded reach ``commit``, so a file counts once however often its task ran. A
    job that fails leaves no summary, and sidecars that are whole: running it again replaces them.
    """

    def __init__(self, summary: str):
        self.summary = summary

    def write(self, iterator) -> Stored:
        done = Stored()
        for batch in iterator:
            for row in batch.to_pylist():
                status, error = store_sidecar(row)
                done.counts[status] += 1
                if error and len(done.examples) < EXAMPLES:
                    done.examples.append(error)
        return done

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        counts = sum((m.counts for m in done), Counter())
        examples = sorted(e for m in done for e in m.examples)[:EXAMPLES]
        row = {"written": counts[WRITTEN], "skipped": counts[SKIPPED], "errors": counts[ERROR], "examples": examples}
        failure = store_file(f"{self.summary}/summary.json", json.dumps(row).encode())
        if failure:
            raise OSError(failure)

    def abort(self, messages) -> None:
        pass


class Sidecars(D.DataSource):
    """``sidecar_table(..).write.format("sidecars").option("summary", folder).mode("append").save()``"""

    @classmethod
    def name(cls) -> str:
        return "sidecars"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in TABLE)

    def writer(self, schema, overwrite: bool) -> SidecarWriter:
        if overwrite or not self.options.get("summary"):
            raise ValueError("sidecars are appended, with a folder for the summary")
        missing = set(TABLE) - set(schema.fieldNames())
        if missing:
            raise ValueError(f"not a table of sidecars: {sorted(missing)} missing")
        return SidecarWriter(self.options["summary"].rstrip("/"))


def save_sidecars(table: DataFrame, summary: str, tasks: int | None = None) -> DataFrame:
    """Writes the rows of ``sidecar_table`` and returns ``write_summary``'s row, kept in the folder ``summary``."""
    spark = table.sparkSession
    spark.dataSource.register(Sidecars)
    spread(table.select(*TABLE), "path", tasks).write.format("sidecars").option("summary", summary).mode("append").save()
    return read_summary(spark, summary)


def read_summary(spark: SparkSession, summary: str) -> DataFrame:
    return with_message(spark.read.schema(SUMMARY).json(f"{summary}/summary.json").drop("examples"))


def write_summary(outcome: DataFrame) -> DataFrame:
    """``(written, skipped, errors, message)`` over ``(path, status, error)``."""

    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return with_message(
        outcome.agg(count(WRITTEN).alias("written"), count(SKIPPED).alias("skipped"), count(ERROR).alias("errors")))


def with_message(counts: DataFrame) -> DataFrame:
    """Adds what the user is told."""

    def part(c: str, text: str) -> Column:
        return F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))

    written = F.concat(F.col("written").cast("string"), F.lit(" XMP file(s) written"))
    return counts.withColumn(
        "message", F.concat_ws(", ", written, part("skipped", " skipped"), part("errors", " error(s)"))
    )


def sidecar_exists(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Adds ``xmp_written``: a file with the sidecar's path is in the listing ``(path)``, old or new."""
    there = sidecars.select(plain_path(F.col("path")).alias("_sidecar")).distinct().withColumn("_there", F.lit(True))
    wanted = files.withColumn("_sidecar", plain_path(sidecar_path(F.col("path"))))
    joined = wanted.join(there, "_sidecar", "left")
    return joined.withColumn("xmp_written", F.coalesce(F.col("_there"), F.lit(False))).drop("_sidecar", "_there")


def refresh_written(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``sidecar_exists`` for labelled rows only; the others keep the ``xmp_written`` they had."""
    before = F.col("xmp_written") if "xmp_written" in files.columns else F.lit(False)
    known = files.withColumn("_before", F.coalesce(before, F.lit(False))).drop("xmp_written")
    seen = sidecar_exists(known, sidecars)
    now = F.when(F.col("label").isNotNull(), F.col("xmp_written")).otherwise(F.col("_before"))
    return seen.withColumn("xmp_written", now).drop("_before")
