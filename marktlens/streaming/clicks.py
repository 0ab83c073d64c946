"""Click streams: ingest from log files, running figures, counts by time, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame) -> DataFrame:
    """letter_id and time of lines `ISO time, tab, letter id`; lines that aren't such are dropped."""
    parts = F.split("value", "\t")
    rows = lines.select(F.get(parts, F.lit(0)).alias("t"), F.get(parts, F.lit(1)).alias("i"), F.size(parts).alias("n"))
    rows = rows.filter("n = 2").select(F.trim("i").try_cast("long").alias("letter_id"), F.try_to_timestamp(F.trim("t")).alias("time"))
    return rows.filter("letter_id is not null and time is not null")


def click_stream(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files in a folder as they arrive. The checkpoint of the query that reads it takes the place of a
    byte offset, and makes its sink exact."""
    return parse_lines(spark.readStream.text(path))


def append(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends to a Parquet table; once: works off what is there and ends."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start(path)


def by_window(clicks: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Clicks by letter and time window; those later than `late` are left out."""
    return clicks.withWatermark("time", late).groupBy(F.window("time", width, slide), "letter_id").agg(F.count("*").alias("clicks"))


def sessions(clicks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return clicks.withWatermark("time", late).groupBy(F.session_window("time", gap).alias("session"), "letter_id").agg(F.count("*").alias("clicks"))


def unseen(messages: DataFrame, days: int = 7) -> DataFrame:
    """Messages (mailbox_id, uid, time) seen for the first time within so many days."""
    return messages.withWatermark("time", f"{days} days").dropDuplicatesWithinWatermark(["mailbox_id", "uid"])
