"""Session settings and the folder that all executors can see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE sizes and splits shuffle partitions at run time, so the same plan holds at any scale.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the call site of every column costs more than building the column.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(name: str = "focuslake", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can see")
        base = tempfile.mkdtemp(prefix="focuslake-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def spread(rows: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """Rows dealt out evenly by key, for work whose cost per row has nothing to do with its bytes.

    Naming the number of tasks keeps Spark from merging partitions that look small. The default is
    the session's number of shuffle partitions.
    """
    return rows.repartition(tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
