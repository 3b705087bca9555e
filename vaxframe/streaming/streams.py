"""Streaming forms of the message service.

Every function takes a streaming DataFrame and returns a started-and-finished
run's result path or frame only through files: nothing is collected.  Batches
are written to a folder named by the batch id with overwrite, so a batch that
runs again after a failure leaves the same files.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upsert
from ..sources.scratch import new_path
from .registry import Registry, merge_parts, reduce_batch  # noqa: F401


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table (file or folder of files) as a stream, with the schema of its files."""
    table = f"{folder}/{name}"
    stream = spark.readStream.schema(spark.read.parquet(table).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(table)
    return stream.option("pathGlobFilter", name).parquet(folder)  # a stream needs a folder; the filter leaves the one file


def run_available(stream: DataFrame, name: str, batch: Callable[[DataFrame, int], None], mode: str = "append",
                  checkpoint: str | None = None) -> None:
    """Runs ``batch`` over all data there is now, then stops.

    With a fixed ``checkpoint`` folder the next run goes on where this one ended.
    """
    spark = stream.sparkSession
    handle = (stream.writeStream.outputMode(mode).trigger(availableNow=True)
              .option("checkpointLocation", checkpoint or new_path(spark, f"{name}-checkpoint")).foreachBatch(batch).start())
    handle.awaitTermination()


def run_to_files(stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Appends the stream to parquet files and reads them back."""
    spark = stream.sparkSession
    path = path or new_path(spark, name)
    handle = (stream.writeStream.outputMode("append").trigger(availableNow=True).format("parquet")
              .option("checkpointLocation", checkpoint or new_path(spark, f"{name}-checkpoint")).option("path", path).start())
    handle.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def batch_writer(path: str, job: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes ``job(batch)`` to the folder of the batch."""

    def write(df: DataFrame, batch_id: int) -> None:
        job(df).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def ingest(messages: DataFrame, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies a batch job (parse, validate, ...) to every micro-batch and returns all its rows."""
    spark = messages.sparkSession
    path = new_path(spark, "ingest")
    run_available(messages, "ingest", batch_writer(path, job))
    return spark.read.parquet(path)


def dedup(events: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """First event per ``key`` within ``delay``; older keys leave the state."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def lookup(events: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Stream-static left join with a keyed table."""
    return events.join(table, on, "left")


def counts(events: DataFrame, ts: str, width: str, slide: str | None, *keys: str) -> DataFrame:
    """Events per tumbling (or sliding) window and key."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, *keys: str) -> DataFrame:
    """Events per session: a session of a key ends after ``gap`` without events."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))


#: Event time of the row that closes the windows still open; far from any event.
FAR = "timestamp '9000-01-01 00:00:00'"


def closed_windows(events: DataFrame, ts: str, delay: str, build: Callable[[DataFrame], DataFrame], name: str,
                   path: str | None = None, checkpoint: str | None = None, close: bool = True) -> DataFrame:
    """Windowed aggregates in append mode: a window is written once, when the watermark has passed its end, and leaves the state.

    ``build`` makes the aggregates from the events with their watermark (several may be united).  ``close`` ends
    the stream: a last batch of one row far in the future closes what is open.  Without it the next run with the
    same ``path`` and ``checkpoint`` goes on.
    """
    spark = events.sparkSession
    path, checkpoint = path or new_path(spark, name), checkpoint or new_path(spark, f"{name}-checkpoint")
    folder = f"{checkpoint}-end"
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    ended = events.unionByName(spark.readStream.schema(events.schema).parquet(folder))
    result = build(ended.withWatermark(ts, delay))
    rows = run_to_files(result, name, path, checkpoint)
    if close:
        spark.range(1).select(*[(F.expr(FAR) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]).write.mode("append").parquet(folder)
        rows = run_to_files(result, name, path, checkpoint)
    return rows


def upsert_stream(messages: DataFrame, accepted: Callable[[DataFrame], DataFrame], keys: list[str] | None = None,
                  groups: dict | None = None, order: list[str] | None = None, path: str | None = None,
                  checkpoint: str | None = None, buckets: int = 16) -> Registry:
    """The registry after streaming all messages through ``accepted`` (a batch job); the same paths go on with it."""
    spark = messages.sparkSession
    registry = Registry(spark, path or new_path(spark, "registry"), keys or ["org_id", "mrn"], groups or upsert.PATIENT_GROUPS,
                        order or ["received_date", "msg_id"], "received_date", buckets)
    run_available(messages, "upsert", lambda df, batch_id: registry.apply(accepted(df), batch_id), checkpoint=checkpoint)
    return registry


def watermark_of(spark: SparkSession, checkpoint: str, batch_id: int) -> int:
    """The watermark (ms) that the engine wrote down for a batch before it ran it."""
    lines = spark.read.text(f"{checkpoint}/offsets/{batch_id}").collect()  # a few lines; the second one holds the watermark
    return next(json.loads(r.value)["batchWatermarkMs"] for r in lines if r.value.startswith("{") and "batchWatermarkMs" in r.value)


class LateSplit:
    """Splits a stream at its own watermark: a row is late when its window was closed before the row's batch.

    These are the rows that an aggregation over the window with the same watermark drops.  Both sides are written by
    batch id, so a batch that runs again leaves the same files.
    """

    def __init__(self, spark: SparkSession, ts: str, delay: str, width: str, path: str | None = None, checkpoint: str | None = None):
        self.spark, self.ts, self.delay, self.width = spark, ts, delay, width
        self.path, self.checkpoint = path or new_path(spark, "late"), checkpoint or new_path(spark, "late-checkpoint")

    def run(self, events: DataFrame) -> None:
        """Takes in what there is now."""
        def write(df: DataFrame, batch_id: int) -> None:
            mark = watermark_of(self.spark, self.checkpoint, batch_id)
            tagged = df.withColumn("is_late", F.window(self.ts, self.width).end <= F.timestamp_millis(F.lit(mark)))
            tagged.write.mode("overwrite").partitionBy("is_late").parquet(f"{self.path}/batch_id={batch_id}")

        run_available(events.withWatermark(self.ts, self.delay), "late", write, checkpoint=self.checkpoint)

    def _side(self, late: bool) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows.where(F.col("is_late").cast("boolean") == F.lit(late)).drop("is_late", "batch_id")

    def on_time(self) -> DataFrame:
        return self._side(False)

    def late(self) -> DataFrame:
        """The side table."""
        return self._side(True)


def last_known(events: DataFrame, key: str, received: str, value: str) -> DataFrame:
    """Value of the last arrival per key, whatever the age of the event."""
    return events.groupBy(key).agg(F.expr(f"max_by({value}, struct({received}, event_id)) as {value}"),
                                   F.max(received).alias("last_received"))
