"""Streams: tumbling, sliding and session windows with watermarks, deduplication, merging into a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.load import TableLoad, load_table


def windowed_counts(df: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, end, the keys, n: counts by window. The same on batches and streams; `late` is the watermark of a stream."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if late and df.isStreaming:
        df = df.withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def session_counts(df: DataFrame, ts: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """start, end, the keys, n: a session ends after a gap without rows."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if late and df.isStreaming:
        df = df.withWatermark(ts, late)
    return df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def deduplicated(df: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """First rows by key; of a stream, within the watermark."""
    if not df.isStreaming:
        return df.dropDuplicates(keys)
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """A folder's parquet files as a stream."""
    r = spark.readStream.schema(spark.read.option("pathGlobFilter", pattern or "*").parquet(path).schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.parquet(path)


def drain(df: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result as a table, written below the checkpoint's folder.

    Of complete results the last one counts; appended batches lie side by side, and one that runs again replaces itself.
    """
    spark, out = df.sparkSession, f"{checkpoint}/result"
    done: list[int] = []

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/__batch={batch_id}")
        done.append(batch_id)

    df.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(out).select(*[F.col(f"`{c}`") for c in df.columns])


def merge_stream(df: DataFrame, path: str, spec: TableLoad, checkpoint: str, every: str | None = None, seen: Callable[[int], bool] | None = None) -> StreamingQuery:
    """Merges every batch into the table at path. A batch that is run again changes nothing: merge is by key.

    `every` is the trigger's interval; without it, all that is there is loaded and the stream ends. `seen` tells
    of a batch id whether it was loaded before.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        if seen is None or not seen(batch_id):
            load_table(rows, path, spec)

    w = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def progress(q: StreamingQuery) -> dict:
    """Batch, rows and rates of a running stream."""
    p = q.lastProgress
    return {} if p is None else {k: p[k] for k in ("batchId", "numInputRows", "inputRowsPerSecond", "processedRowsPerSecond")}
