"""Structured Streaming: file sources, hourly roll-ups, change replay, dedupe windows, queue workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.operators import ranges

#: Late events count as long as they are not older than the retention.
RETENTION = "30 days"
DEDUPE_SECONDS = 45


def source(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream, with the schema of what is there now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def hourly(events: DataFrame, keys: list[str], ts: str = "ts", delay: str = RETENTION) -> DataFrame:
    """Counts by hour; with the watermark a state older than the retention is dropped."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if events.isStreaming else events
    return e.groupBy(F.window(ts, "1 hour").alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), *keys, "n")


def deduped(events: DataFrame, keys: list[str], ts: str = "ts", seconds: int = DEDUPE_SECONDS) -> DataFrame:
    """One event of each key within the window, by event time."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{seconds} seconds").dropDuplicatesWithinWatermark(keys)


def accepted(events: DataFrame, key: str, ts: str = "ts", seconds: int = DEDUPE_SECONDS, order: str = "event_id") -> DataFrame:
    """Batch form, exact: an event counts if the last accepted one of its key is at least that long ago."""
    return ranges.chain(events, key, ts, seconds, order)


def once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Run a stream over what is there and stop."""
    stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def fold(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> None:
    """At-least-once worker: step(batch, number) for each micro-batch; a repeated number must overwrite its own output."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_table(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A step that keeps the latest row of each key under path, a version folder for each batch."""
    from ctxloom.operators.store import latest

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, key, order)
        if number:
            new = latest(spark.read.parquet(f"{path}/v{number - 1}").unionByName(new), key, order)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return step
