"""Outcomes as a stream: snapshots by event time, first texts within a watermark, resumable file scans.

The batch operators have no stream in their model; these are the same facts read as they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, text_hash

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, schema: str = EVENTS, files: int = 16) -> DataFrame:
    """Parquet files of a folder as they appear, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def snapshots(events: DataFrame, width: str = "1 day", late: str = "2 days", at: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Count, mean and best of each window and operator; rows later than the watermark are left out."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))  # watermarks need a time zone; the session's is taken
    return timed.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("best")).select(F.col("w.start").alias("start"), by, "n", "mean", "best")


def first_texts(records: DataFrame, late: str = "1 hour", at: str = "ts", text: str = "text") -> DataFrame:
    """The first record of each stripped text within the watermark."""
    return records.withColumn("text_hash", text_hash(strip(F.coalesce(text, F.lit(""))))).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(["text_hash"])


def write_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """All that is there now, once, with progress kept in ``checkpoint``: run again, it goes on where it was."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
