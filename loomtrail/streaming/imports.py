"""Structured streaming: transcripts as they arrive, and sessions of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON lines of a folder, each object as a variant."""
    lines = spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.withColumn("value", F.try_parse_json("line")).where("value IS NOT NULL")


def import_new(lines: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs ``ingest(batch, number)`` for what is new; a batch that is repeated after a failure has its number again."""
    writer = lines.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sessions(events: DataFrame, stamp: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each key by session: a session ends when nothing comes for ``gap``; later events than the watermark
    are dropped from streams."""
    grouped = events.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late).groupBy(key, F.session_window(stamp, gap).alias("session"))
    return grouped.agg(F.count("*").alias("events")).select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "events")


def tool_counts(events: DataFrame, stamp: str = "ts", tool: str = "event_type", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Calls of each tool in windows of event time."""
    grouped = events.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late).groupBy(F.window(stamp, width).alias("w"), tool)
    return grouped.agg(F.count("*").alias("calls")).select(F.col("w.start").alias("start"), tool, "calls")
