"""Readers and writers of image tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def embedding_images(spark: SparkSession, sf_dir: str, side: int = 8) -> DataFrame:
    """The embeddings as square images: image_id, label, shape, img."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("image_id"), "label", F.array(F.lit(side), F.lit(side)).alias("shape"), F.col("embedding").cast("array<double>").alias("img"))


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event values per user as 1-D images, zero where nothing happened, over the whole days from the first event to the last."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ends = e.select(F.date_trunc("day", F.min("ts")).alias("first"), (F.datediff(F.max("ts"), F.min("ts")) + 1).alias("days")).first()
    hours = 24 * (ends["days"] or 0)
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(ends["first"]))) / 3600).cast("int")
    sums = e.where("ts is not null").groupBy(F.col("user_id").alias("image_id"), hour.alias("t")).agg(F.sum("value").alias("v"))
    # A user has one entry an hour at most, so the collected list is bounded by the range; each entry brings the zeros before it.
    m = sums.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("m"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    before = F.concat(F.array(F.lit(-1)), F.transform(F.slice("m", F.lit(1), F.size("m") - 1), lambda e: e["t"]))
    filled = F.flatten(F.zip_with("m", before, lambda e, t: F.concat(zeros(e["t"] - t - 1), F.array(e["v"]))))
    return m.select("image_id", F.array(F.lit(hours)).alias("shape"), F.concat(filled, zeros(hours - 1 - F.element_at("m", F.lit(-1))["t"])).alias("img"))


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total order price per day: one signal as rows (t, v), t counted by occurrence."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table of images written by ``write_images``."""
    return spark.read.parquet(path)


def write_images(images: DataFrame, path: str, mode: str = "errorifexists") -> None:
    images.write.mode(mode).parquet(path)


def read_raw_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as rows (path, modificationTime, length, content), for decoders of one's own."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
