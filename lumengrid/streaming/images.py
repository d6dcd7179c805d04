"""Image operators on streams, and windowed event aggregates with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.runtime import map_images


def stream_images(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """Image tables (parquet) arriving in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def filtered(images: DataFrame, kernel) -> DataFrame:
    """A kernel on every arriving image: stateless, so it works on streams as it stands."""
    return map_images(images, kernel)


def running_histogram(images: DataFrame, bins: int, lo: float, hi: float) -> DataFrame:
    """Counts by bin over everything seen so far; the state is one row a bin."""
    v = F.explode("img").alias("v")
    b = F.least(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return images.select(v).where(F.col("v").between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def event_grid(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Event values by user and time window; rows later than the watermark are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.sum("value").alias("v"), F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "v", "n")


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to parquet, exactly once by the checkpoint; ends when the input is used up."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event values by user and session: rows nearer than the gap belong together."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.sum("value").alias("v"), F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "v", "n")
