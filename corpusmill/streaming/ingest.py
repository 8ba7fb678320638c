"""Structured Streaming: new files only, duplicates across them, windows of event time with late data."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions import text as tx


def new_files(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    """A stream of the Parquet files that come to a folder; ``per_trigger`` bounds what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_available(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there now and stops; the next run goes on where this one ended."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


def stop_when(query: StreamingQuery, path: str, every: float = 5.0, timeout: float | None = None) -> bool:
    """Waits for a stream, and stops it after its batch once a stop file is there; whether that was the reason it ended."""
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    end = None if timeout is None else time.monotonic() + timeout
    while query.isActive and (end is None or time.monotonic() < end):
        if files.exists(place):
            query.stop()
            return True
        query.awaitTermination(every)
    return False


def distinct_texts(stream: DataFrame) -> DataFrame:
    """First copies by normal form, over the stream's whole life: state grows by a key of 16 bytes per kept document."""
    return stream.withColumn("_key", F.unhex(F.md5(tx.normal_form("text")))).dropDuplicates(["_key"]).drop("_key")


def distinct_within(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """First copies within a watermark: state is bounded by the delay."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def counted_windows(events: DataFrame, at: str, delay: str, length: str, slide: str | None = None, *keys: str) -> DataFrame:
    """Counts and totals by window of event time; rows later than the delay are left out."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), *keys, "n", "total")


def counted_sessions(events: DataFrame, at: str, delay: str, gap: str, key: str) -> DataFrame:
    """Sessions of a key: gaps part them."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), key, "n")
