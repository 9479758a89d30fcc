"""Incremental ingestion and monitoring with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files; ts as a timestamp in the session's zone."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window start, event_type, n, total by tumbling windows; works on a stream and on a table."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    counted = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n by session windows."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    counted = marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without repeats of their keys: a batch that is read again adds nothing."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def run_available(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> None:
    """Process what there is now into Parquet and stop; a later call goes on where this one ended."""
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").option("path", path).start()
    query.awaitTermination()


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Process what there is now into a table in memory; for small, aggregated results."""
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).format("memory").queryName(name).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process what there is now into a new table in the shared folder and read it back; rows go from tasks to files, none through the driver."""
    folder = f"{shared_folder(stream.sparkSession)}/quire-{name}-{uuid.uuid4().hex}"
    run_available(stream, f"{folder}/log", f"{folder}/rows")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
