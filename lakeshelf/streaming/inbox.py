"""Streams of arriving files: quiet-gap sessions, first sightings, and a table that follows the newest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sessions(stream: DataFrame, key: str, at: str, gap: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """(key, begin, end, n) of a key's events without a longer gap; state ends with the watermark."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    window = F.session_window(at, gap)
    return rows.groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def counts_per(stream: DataFrame, at: str, key: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), key, "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that has arrived since the last run, then stop: the periodic trigger of a timer."""
    return stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
