"""Folders for files that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch while a table is staged: the default (10,000) makes batches of tens of MB where rows hold texts.
STAGED_BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session without the setting gets a folder of its own machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="vaxframe-")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/vaxframe/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most STAGED_BATCH_ROWS rows for the jobs that start inside."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(STAGED_BATCH_ROWS, int(before)) if int(before) > 0 else STAGED_BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def stage(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write once, read back: cuts the lineage where several branches start from ``df``."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
