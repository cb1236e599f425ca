"""Line-wise JSON that lands while it is read: an extension, as the batch readers cover finished files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landed_json(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream over the line-wise JSON files of a folder; new files are picked up as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.jsonl").json(path)


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "10 minutes", late: str = "30 minutes", slide: str | None = None) -> DataFrame:
    """Counts per tumbling or sliding window; events later than the watermark are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def sessions(events: DataFrame, time: str, by: list[str], gap: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts per session: events of a key without a gap between them."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def append_scores(scores: DataFrame, path: str, checkpoint: str):
    """Start appending a stream of scores to a table, once over what has landed."""
    return scores.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
