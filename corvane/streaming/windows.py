"""Structured Streaming over event tables: an extension, for feeds of scored utterances that keep arriving."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.tables import save


def stream_of(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream, in the schema that the files have."""
    there = spark.read.parquet(path)
    stream = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", files_at_once)
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(f.rstrip("/").endswith(f"/{name}") for f in there.inputFiles()):  # a stream reads folders: this one's other files are left out
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by kind in tumbling windows; rows that come later than the watermark allows are dropped by it."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_end(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """What a stream over existing files gives in all, collected by a Parquet or memory sink and read back."""
    spark = stream.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    running = stream.writeStream.outputMode(mode).format("memory").queryName(table).trigger(availableNow=True).start()
    running.awaitTermination()
    return save(spark.table(table), name)


def streaming_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by kind of event from a stream; the sink gets a row for each window, kind and update."""
    counts = windowed_counts(stream_of(spark, f"{sf_dir}/events.parquet"))
    out = run_to_end(counts, "complete", "event_windows")
    return out.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {"streaming_event_windows": streaming_event_windows}
SQL = {"streaming_event_windows": "select cast(ts as date) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all"}
