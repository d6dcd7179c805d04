"""Views of pixel tables (crops, blocks, windows), slices by a function, and whole-image summaries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import entr, rel_entr
from .histograms import histogramdd
from .regions import map_array
from .runtime import map_images


def crop(px: DataFrame, widths: tuple[tuple[int, int], tuple[int, int]], shape: tuple[int, int]) -> DataFrame:
    """Cuts (before, after) pixels off each axis and counts from the new corner; a filter, no shuffle."""
    (top, bottom), (left, right) = widths
    inside = F.col("y").between(top, shape[0] - bottom - 1) & F.col("x").between(left, shape[1] - right - 1)
    return px.where(inside).withColumn("y", F.col("y") - top).withColumn("x", F.col("x") - left)


def view_as_blocks(px: DataFrame, block: tuple[int, int]) -> DataFrame:
    """Pixels with their block (by, bx) and place in it (y, x)."""
    out = px
    for axis, n in zip("yx", block):
        out = out.withColumn(f"b{axis}", F.floor(F.col(axis) / n).cast("int")).withColumn(axis, F.pmod(F.col(axis), F.lit(n)).cast("int"))
    return out


def view_as_windows(px: DataFrame, window: tuple[int, int], shape: tuple[int, int], step: int = 1) -> DataFrame:
    """Every full window (wy, wx) that covers a pixel, with the pixel's place in it; rows are made where the pixel is."""
    out = px
    for axis, n, size in zip("yx", window, shape):
        v = F.col(axis)
        first = F.ceil(F.greatest(v - (n - 1), F.lit(0)) / step)
        last = F.floor(F.least(v, F.lit(size - n)) / step)
        starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        out = out.withColumn(f"w{axis}", F.explode(starts)).withColumn(axis, (v - F.col(f"w{axis}") * step).cast("int")).withColumn(f"w{axis}", F.col(f"w{axis}").cast("int"))
    return out


def apply_along_axis(images: DataFrame, function: Callable[[np.ndarray], np.ndarray], axis: int) -> DataFrame:
    """A function of one slice, over every slice along an axis; a scalar result drops the axis, an array replaces it."""
    return map_images(images, lambda x: np.apply_along_axis(function, axis + 1 if axis >= 0 else axis, x))


def is_low_contrast(px: DataFrame, fraction: float = 0.05, lower: float = 1, upper: float = 99, span: float = 1.0, value: str = "v") -> DataFrame:
    """Per image: whether the percentiles' distance is below a fraction of the value range ``span``."""
    p = F.percentile(value, F.array(F.lit(lower / 100), F.lit(upper / 100)))
    return px.groupBy("image_id").agg(p.alias("_p")).select("image_id", ((F.col("_p")[1] - F.col("_p")[0]) / span < fraction).alias("low_contrast"))


def intensity_range(px: DataFrame, value: str = "v") -> DataFrame:
    return px.groupBy("image_id").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def entropy(df: DataFrame, keys: list[str], pk: Column, qk: Column | None = None, base: float | None = None) -> DataFrame:
    """Entropy of each group's values taken as a distribution, or its divergence from that of ``qk``.

    Sums are aggregated first and joined back by key, so a large group isn't held in one task.
    """
    rows = df.select(*keys, pk.cast("double").alias("_p"), (F.lit(1.0) if qk is None else qk.cast("double")).alias("_q"))
    total = rows.groupBy(*keys).agg(F.sum("_p").alias("_sp"), F.sum("_q").alias("_sq"))
    p, q = F.col("_p") / F.col("_sp"), F.col("_q") / F.col("_sq")
    term = entr(p) if qk is None else rel_entr(p, q)
    scale = 1.0 if base is None else float(np.log(base))
    return rows.join(total, keys).groupBy(*keys).agg((F.sum(term) / scale).alias("entropy"))


def histogram2d(df: DataFrame, x: tuple[str, int, float, float], y: tuple[str, int, float, float], keys: list[str] = []) -> DataFrame:
    """Counts over two columns, each given as (name, bins, lo, hi)."""
    return histogramdd(df, {x[0]: x[1:], y[0]: y[1:]}, keys)


class ArrayMap:
    """A value-to-value mapping that can be indexed, changed, and applied to pixels."""

    def __init__(self, values, targets):
        self.pairs = dict(zip(values, targets, strict=True))

    def __len__(self) -> int:
        return max(self.pairs, default=-1) + 1

    def __getitem__(self, value):
        return self.pairs.get(value, 0)

    def __setitem__(self, value, target) -> None:
        self.pairs[value] = target

    def __call__(self, px: DataFrame, value: str = "v") -> DataFrame:
        return map_array(px, self.table(px.sparkSession), value)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(int(k), float(v)) for k, v in self.pairs.items()], "in_val long, out_val double")
