"""Analysing files as they arrive."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import constants as C
from ..operators.catalog import apply_results, latest_results, pending
from ..plans.focus import analyze_card
from ..sources.images import DECODABLE, decoded
from ..sources.previews import write_previews
from .current import read_or_none, upsert

IMAGE_SOURCE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, root: str, per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    """New files below a folder, at most ``per_batch`` in a micro-batch.

    Spark's file source does not see names that start with an underscore.
    """
    reader = _limited(spark.readStream.format("binaryFile").schema(BINARY_FILE), per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def _limited(reader, per_batch: int | None):
    reader = reader.option("recursiveFileLookup", True)
    return reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader


def stream_images(spark: SparkSession, root: str, per_batch: int | None = None) -> DataFrame:
    """``(path, image)`` of new JPEG and PNG files; ``image`` is null where decoding failed."""
    reader = _limited(spark.readStream.format("image").schema(f"image {IMAGE_SOURCE}"), per_batch)
    loaded = reader.option("pathGlobFilter", DECODABLE).load(root)
    return loaded.select(F.col("image.origin").alias("path"), decoded(F.col("image")).alias("image"))


def analyze_stream(
    files: DataFrame, analyze: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, current: str | None = None, **trigger
) -> StreamingQuery:
    """Applies a batch analysis to every micro-batch and appends the results below ``sink``.

    Each batch owns the folder ``run=<id>/batch_id=<n>`` and overwrites it, so a batch that is run again
    leaves no copies. The id is that of the checkpoint: a stream that goes on keeps it, one with a new
    checkpoint, whose batches count from 0 again, gets another. The number of results of each batch is observed while they are
    written and kept for ``batch_counts``. ``current`` names a folder where the latest result of every file is kept up to
    date, see ``upsert``. ``trigger`` is passed on, ``availableNow=True`` by default.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        place = f"run={run}/batch_id={batch_id}"
        results = analyze(batch).withColumn("stored_at", F.current_timestamp())
        seen = Observation()
        results.observe(seen, *_counts(results)).write.mode("overwrite").parquet(f"{sink}/{place}")
        counts = spark.createDataFrame([(seen.get["files"], seen.get["scored"])], COUNTS)
        counts.coalesce(1).write.mode("overwrite").parquet(f"{counts_folder(sink)}/{place}")
        if current:
            mine = spark.read.parquet(f"{sink}/{place}").withColumns({"run": F.lit(run), "batch_id": F.lit(batch_id)})
            upsert(mine, current, f"{run}-{batch_id}")

    return (
        files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


COUNTS = "files bigint, scored bigint"


def _counts(results: DataFrame) -> list[Column]:
    scored = F.count_if(F.col("status") != C.NOT_ANALYZED) if "status" in results.columns else F.count(F.lit(1))
    return [F.count(F.lit(1)).alias("files"), scored.alias("scored")]


def counts_folder(sink: str) -> str:
    return f"{sink.rstrip('/')}-counts"


def batch_counts(spark: SparkSession, sink: str) -> DataFrame:
    """``(run, batch_id, files, scored)`` as observed when each batch was stored; no result is read."""
    return read_or_none(spark, counts_folder(sink)) or spark.createDataFrame([], f"{COUNTS}, run string, batch_id int")


def score_arrivals(pick: Callable[[DataFrame], DataFrame], previews: str, **options) -> Callable[[DataFrame], DataFrame]:
    """An analysis for ``analyze_stream`` over files ``(path, ..)``, whatever their names begin with.

    ``pick`` gives the regions of a batch's files as ``pick_path`` does. The previews of each batch go to a folder of their own.
    """

    def analyze(batch: DataFrame) -> DataFrame:
        place = f"{previews.rstrip('/')}/{uuid.uuid4().hex}"
        write_previews(batch, f"{place}/images").write.parquet(f"{place}/table")
        table = batch.sparkSession.read.parquet(f"{place}/table")
        return analyze_card(pick(table), table, f"{place}/images", folder=f"{place}/scored", **options)

    return analyze


def all_results(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink)


def stored_results(spark: SparkSession, sink: str, key: str = "path") -> DataFrame:
    """One result per file, the one stored last for a file that was analysed more than once."""
    last = latest_results(all_results(spark, sink), ["stored_at", "batch_id", "run"], key)
    return last.drop("stored_at", "batch_id", "run")


def progress(spark: SparkSession, sink: str, listing: DataFrame, key: str = "path") -> float:
    """Share of the files of a listing that have a result in the sink, whichever run stored it.

    0 before the first batch; files that are gone do not count. For a glance at a running stream, ``batch_counts`` is cheaper.
    """
    files, done = listing.select(key).distinct(), read_or_none(spark, sink)
    total = files.count()
    if not total or done is None:
        return 0.0 if total else 1.0
    return files.join(done.select(key), key, "left_semi").count() / total


def rescan(
    catalog: DataFrame, results: DataFrame, key: str = "path", again: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """A new listing with the results that are still valid, and the files left to analyse.

    Results that carry ``size`` and ``mtime`` hold for that state of the file only; ``again`` names
    files to be analysed anew in any case.
    """
    if again is not None:
        results = results.join(again.select(key).distinct(), key, "left_anti")
    same = [c for c in ("size", "mtime") if c in results.columns and c in catalog.columns]
    if same:
        state = catalog.select(key, *[F.col(c).alias(f"_{c}") for c in same])
        unchanged = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
        valid = results.join(state, key).where(reduce(lambda a, b: a & b, unchanged))
        results = valid.drop(*same, *[f"_{c}" for c in same])
    return apply_results(catalog, results, key), pending(catalog, results, key)
