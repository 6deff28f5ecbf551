"""The latest result of every file, kept up to date as batches land."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.catalog import latest_results

BUCKETS = 64


def read_or_none(spark: SparkSession, folder: str) -> DataFrame | None:
    """A stored table, or None before anything is stored."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def upsert(results: DataFrame, folder: str, batch: str, key: str = "path", order: str = "stored_at", buckets: int = BUCKETS) -> None:
    """Merges a stored batch of results into ``folder``, one row per file: the last by ``order``.

    Files are dealt out to ``buckets`` folders by a hash of the key, and only those that the batch touches are read and
    written again, each by one task. They are first stored apart, under the batch's name, and replaced only then. A batch that is run again, after
    a loss at any point, replaces them by the same rows. The number of buckets holds for the life of the folder; a larger one
    keeps what a small batch rewrites small.
    """
    spark, staged = results.sparkSession, f"{folder.rstrip('/')}-staged/{batch}"
    if read_or_none(spark, f"{staged}/done") is None:
        new = results.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        old = read_or_none(spark, folder)
        both = new if old is None else new.unionByName(old.where(F.col("bucket").isin(touched)), allowMissingColumns=True)
        latest = latest_results(both, order, key)
        latest.repartition("bucket").write.mode("overwrite").parquet(f"{staged}/rows")
        # Written last: the rows are whole.
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{staged}/done")
    rows = spark.read.parquet(f"{staged}/rows").repartition("bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def current_results(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file, as stored: nothing is compared when results are read."""
    return spark.read.parquet(folder).drop("bucket")
