"""Frame feeds as streams.

Operators without state (corrections by a static table, projection, YOLO text,
visibility) apply to streams as they are.  Growing enclosing boxes of tracks are
an aggregate over event-time windows with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def label_feed(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """A stream of box rows from JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def windowed_track_boxes(boxes: DataFrame, time_col: str, window: str, lateness: str, by: list[str]) -> DataFrame:
    """Enclosing box of each group and window; state of a window is dropped
    once the watermark has passed it."""
    at = F.window(time_col, window)
    out = boxes.withWatermark(time_col, lateness).groupBy(at.alias("at"), *by).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("boxes")
    )
    return out.select(F.col("at.start").alias("start"), F.col("at.end").alias("end"), *by, "x1", "y1", "x2", "y2", "boxes")
