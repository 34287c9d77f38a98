"""Structured Streaming forms of the time-series operators: the same results as the batch forms on bounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How late an event may come.
LATE = "1 day"


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """(start, n, errors) per window; state is dropped once the watermark has passed it."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = events.withWatermark("ts", LATE).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.select(F.col("w.start").alias("start"), "n", "errors")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    g = events.withWatermark("ts", LATE).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), "n")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and returns the result table."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Calls apply(batch, id) for each micro-batch of what is there now; the checkpoint makes it resume."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
