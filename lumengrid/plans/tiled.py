"""Queries over images kept as tiles; their twins are those of the whole images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters, morphology
from ..operators import grid, peaks, tile_regions
from ..operators.runtime import map_images, pixels
from ..operators.tiles import tile_pixels
from ..sources.images import embedding_images
from . import extras, further  # noqa: F401  (their twins are used here)
from . import twins as T
from .catalog import ORACLE_SQL, register, rounded

#: Doesn't divide the images' side, so tiles at their edges are smaller.
SIDE = 3


def _images(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_images(spark, sf).select("image_id", "shape", "img")


def _out(tiles: DataFrame) -> DataFrame:
    return tile_pixels(tiles).withColumn("v", F.round("v", 6) + F.lit(0.0))


def _zero_one(condition):
    return F.transform("img", lambda v: F.when(condition(v), 1.0).otherwise(0.0))


def on_tiles(name: str, run, sql: str) -> None:
    """A query that cuts every image into tiles, runs on those and returns its pixels."""
    register(name, lambda spark, sf: _out(run(grid.split(_images(spark, sf), SIDE))), sql)


def _filter_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Three filters, one exchange each, on tiles read by range from raw files."""
    tiles = grid.read_rasters(grid.write_rasters(_images(spark, sf)), SIDE)
    for kernel in (lambda x: filters.uniform_filter(x, 3), lambda x: filters.maximum_filter(x, 3), filters.laplace):
        tiles = grid.stencil(tiles, kernel, 1, SIDE)
    return _out(tiles)


_LAPLACE = [(-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1), (0, 0, -4)]
register("tiled_filter_chain", _filter_chain, T.pixels(T.step("px", "a", T.BOX), T.step("a", "b", T.ONE, "max(q.v)"), T.step("b", "c", _LAPLACE)))
on_tiles("tiled_wide_filter", lambda t: grid.stencil(t, lambda x: filters.uniform_filter(x, 7), 3, SIDE, "mirror"), T.linear([(a, b, 1 / 49) for a in range(-3, 4) for b in range(-3, 4)], "mirror"))

on_tiles("tiled_reconstruction", lambda t: grid.reconstruct(t.withColumn("mask", F.col("img")).withColumn("img", F.transform("img", lambda v: v - 0.1)), SIDE), ORACLE_SQL["grey_reconstruction"])
on_tiles("tiled_binary_propagation", lambda t: grid.propagate(t.withColumn("mask", _zero_one(lambda v: v > 0)).withColumn("img", _zero_one(lambda v: v > 0.2)), SIDE), ORACLE_SQL["binary_propagation"])
on_tiles("tiled_binary_fill_holes", lambda t: grid.fill_holes(t.withColumn("img", _zero_one(lambda v: v > 0)), SIDE), ORACLE_SQL["binary_fill_holes"])
on_tiles("tiled_hysteresis", lambda t: grid.hysteresis(t, SIDE, 0.0, 0.2), ORACLE_SQL["apply_hysteresis_threshold"])

on_tiles("tiled_rotate", lambda t: grid.rotate(t, SIDE, 30, False, 1), ORACLE_SQL["rotate"])
on_tiles("tiled_affine_transform", lambda t: grid.affine_transform(t, SIDE, [[1, 0.1], [0.1, 1]], 0, None, 1), ORACLE_SQL["affine_transform"])
on_tiles("tiled_warp", lambda t: grid.warp(t, SIDE, np.array([[1, 0, 0.5], [0, 1, -0.5], [0, 0, 1]])), ORACLE_SQL["warp"])
on_tiles("tiled_map_coordinates", lambda t: grid.gather(t, SIDE, lambda y, x, rows, cols: (0.9 * y, 0.9 * x), None, 3, "mirror"), ORACLE_SQL["map_coordinates"])
on_tiles("tiled_spline_filter", lambda t: grid.spline_filter(t, SIDE), ORACLE_SQL["spline_filter"])

register("tiled_peak_local_max", lambda spark, sf: peaks.peak_local_max(grid.split(_images(spark, sf), SIDE), SIDE).select("image_id", "y", "x"), ORACLE_SQL["peak_local_max"])
register(
    "ensure_spacing",
    lambda spark, sf: peaks.ensure_spacing(pixels(_images(spark, sf), digits=None).where("v > 0"), 3, 2).select("image_id", "y", "x"),
    f"""WITH RECURSIVE {T.PX}, p AS MATERIALIZED (SELECT image_id, y, x, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS k FROM px WHERE v > 0),
r AS (SELECT DISTINCT image_id, 0::BIGINT AS k, []::STRUCT(y INT, x INT)[] AS kept FROM px
      UNION ALL SELECT r.image_id, r.k + 1, CASE WHEN len(list_filter(r.kept, lambda t: (t.y - p.y) * (t.y - p.y) + (t.x - p.x) * (t.x - p.x) < 9)) = 0 THEN list_append(r.kept, {{'y': p.y, 'x': p.x}}) ELSE r.kept END
      FROM r JOIN p ON p.image_id = r.image_id AND p.k = r.k + 1)
SELECT image_id, t.y, t.x FROM (SELECT image_id, unnest(arg_max(kept, k)) AS t FROM r GROUP BY image_id)""",
)


def _region_shapes(spark: SparkSession, sf: str) -> DataFrame:
    labels = map_images(_images(spark, sf), lambda x: morphology.label(x > 0))
    return rounded(tile_regions.region_shapes(grid.split(labels, SIDE), SIDE))


register("tiled_region_shapes", _region_shapes, ORACLE_SQL["region_shapes"])
