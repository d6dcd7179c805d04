"""Tiles that exchange halos, frames, samples and carries equal the whole image."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.functions import filters, interpolate, morphology
from lumengrid.operators import grid

RNG = np.random.default_rng(5)
SCHEMA = "image_id long, shape array<int>, img array<double>"
PICTURES = [RNG.standard_normal((11, 13)), RNG.standard_normal((4, 9)), RNG.standard_normal((1, 7)), RNG.standard_normal((6, 1)), RNG.standard_normal((8, 8)), RNG.standard_normal((1, 1))]


def table(spark, images):
    rows = [(k, list(x.shape), x.ravel().tolist()) for k, x in enumerate(images)]
    return spark.createDataFrame(rows + [(90, None, None), (91, [2, 2], [1.0]), (92, [3], [1.0, 2.0, 3.0]), (None, [1, 1], [1.0])], SCHEMA).repartition(3)


def put(tiles):
    out = {}
    for r in tiles.collect():
        whole = out.setdefault(r.image_id, np.full((r.rows, r.cols), np.nan))
        h, w = r["shape"]
        whole[r.ty : r.ty + h, r.tx : r.tx + w] = np.reshape(r.img, (h, w))
    return out


def same(tiles, images, kernel):
    got = put(tiles)
    got.pop(None, None)
    assert set(got) == set(range(len(images)))
    for k, x in enumerate(images):
        want = np.asarray(kernel(x[None]), float)[0]
        assert got[k].shape == want.shape and np.allclose(got[k], want, rtol=1e-9, atol=1e-9), k


@pytest.mark.parametrize("side, size, mode", [(3, 3, "reflect"), (2, 9, "mirror"), (5, 5, "nearest"), (2, 9, "wrap"), (3, 3, "constant"), (2, 9, "reflect"), (2, 9, "constant")])
def test_stencils_of_any_reach_and_mode(spark, mode, side, size):
    kernel = lambda x: filters.uniform_filter(x, size, mode, 0.5) + x
    tiles = grid.split(table(spark, PICTURES), side)
    inner = lambda x: filters.uniform_filter(x, size, "nearest") + x  # noqa: E731  # the halo makes the window's own boundary moot
    same(grid.stencil(tiles, inner, size // 2, side, mode, 0.5), PICTURES, kernel)


def test_three_chained_filters_on_tiles_of_raw_files(spark):
    rasters = grid.write_rasters(table(spark, PICTURES))
    tiles = grid.read_rasters(rasters, 4)
    assert put(tiles)[0].tolist() == PICTURES[0].tolist()
    for kernel, halo in ((lambda x: filters.uniform_filter(x, 3), 1), (lambda x: filters.median_filter(x, 5), 2), (filters.laplace, 1)):
        tiles = grid.stencil(tiles, kernel, halo, 4)
    same(tiles, PICTURES, lambda x: filters.laplace(filters.median_filter(filters.uniform_filter(x, 3), 5)))


def test_tiles_of_a_pixel_table(spark):
    px = spark.createDataFrame([("a", 7, 5, y, x, float(y * 5 + x)) for y in range(7) for x in range(5) if (y + x) % 3] + [("a", 7, 5, 7, 0, 1.0), ("a", 7, 5, 0, -1, 1.0)], "image_id string, rows int, cols int, y int, x int, v double")
    got = put(grid.tiles_of_pixels(px, 3, fill=-1.0))["a"]
    assert all(got[y, x] == (y * 5 + x if (y + x) % 3 else -1.0) for y in range(7) for x in range(5))
    whole = np.where([[(y + x) % 3 for x in range(5)] for y in range(7)], np.arange(35.0).reshape(7, 5), -1.0)
    again = grid.stencil(grid.tiles_of_pixels(px, 3, fill=-1.0), lambda x: filters.maximum_filter(x, 3), 1, 3)
    assert np.array_equal(put(again)["a"], filters.maximum_filter(whole[None], 3)[0])


def snake(n):
    """One path through every tile, and back."""
    out = np.zeros((n, n))
    out[::2] = 1
    out[1::4, -1] = out[3::4, 0] = 1
    return out


@pytest.mark.parametrize("method, connectivity", [("dilation", 2), ("erosion", 1)])
def test_grey_reconstruction_across_tiles(spark, method, connectivity):
    masks = [snake(11), RNG.integers(0, 6, (13, 10)).astype(float), RNG.random((9, 14)), np.ones((5, 5))]
    if method == "erosion":
        masks = [-m for m in masks]
    turn = 1 if method == "dilation" else -1
    seeds = [np.where(RNG.random(m.shape) < 0.05, m, m - turn * RNG.integers(0, 5, m.shape)) for m in masks]
    seeds[0] = np.full((11, 11), turn * -9.0)
    seeds[0][0, 0] = masks[0][0, 0]
    seeds[3] = masks[3] + turn * 2.0  # above the mask: clipped
    rows = [(k, list(m.shape), s.ravel().tolist(), m.ravel().tolist()) for k, (s, m) in enumerate(zip(seeds, masks))]
    df = spark.createDataFrame(rows, "image_id long, shape array<int>, img array<double>, mask array<double>")
    own = grid.split(df.select("image_id", "shape", "img"), 3)
    over = grid.split(df.select("image_id", "shape", F.col("mask").alias("img")), 3).select(*grid.KEY, F.col("img").alias("mask"))
    got = put(grid.reconstruct(own.join(over, grid.KEY), 3, method, connectivity))
    foot = morphology.generate_binary_structure(2, connectivity)
    for k, (s, m) in enumerate(zip(seeds, masks)):
        clip = np.minimum(s, m) if method == "dilation" else np.maximum(s, m)
        assert np.array_equal(got[k], morphology.reconstruction(clip[None], m[None], method, foot)[0]), k


def test_binary_fixpoints_across_tiles(spark):
    ring = np.zeros((12, 12))
    ring[1, 1:11] = ring[10, 1:11] = ring[1:11, 1] = ring[1:11, 10] = 1
    inner = ring.copy()
    inner[5, 5] = 1
    images = [ring, inner, snake(9), (RNG.random((14, 15)) < 0.55).astype(float), np.zeros((4, 4)), np.ones((4, 4))]
    tiles = grid.split(table(spark, images), 4)
    same(grid.fill_holes(tiles, 4), images, lambda x: morphology.binary_fill_holes(x != 0))
    noisy = [RNG.random((14, 15)), RNG.random((3, 8))]
    same(grid.hysteresis(grid.split(table(spark, noisy), 4), 4, 0.45, 0.9), noisy, lambda x: morphology.hysteresis(x, 0.45, 0.9))
    seeds = grid.split(table(spark, noisy), 4).withColumn("mask", F.transform("img", lambda v: (v > 0.4).cast("double"))).withColumn("img", F.transform("img", lambda v: ((v > 0.9) | (v < 0.05)).cast("double")))
    same(grid.propagate(seeds, 4), noisy, lambda x: morphology.binary_propagation((x > 0.9) | (x < 0.05), mask=x > 0.4))


@pytest.mark.parametrize("order, mode", [(0, "grid-wrap"), (1, "constant"), (1, "mirror"), (1, "grid-constant"), (3, "nearest"), (3, "reflect")])
def test_gathers_across_tiles(spark, order, mode):
    images = PICTURES[:2] + PICTURES[4:5]
    tiles = grid.split(table(spark, images), 3)
    m = [[0.9, 0.2], [-0.3, 1.1]]
    same(grid.affine_transform(tiles, 3, m, (-1.37, 2.23), None, order, mode, 0.25), images, lambda x: interpolate.affine_transform(x, m, (-1.37, 2.23), None, order, mode, 0.25))


def test_turned_warped_and_empty_outputs(spark):
    images = PICTURES[:2]
    tiles = grid.split(table(spark, images), 4)
    same(grid.rotate(tiles, 4, 30), images, lambda x: interpolate.rotate(x, 30))
    same(grid.rotate(tiles, 4, -75, False, 1), images, lambda x: interpolate.rotate(x, -75, False, 1))
    back = np.array([[1, 0.2, 0.5], [0, 1, -0.5], [0.01, 0, 1]])
    same(grid.warp(tiles, 4, back, (9, 7)), images, lambda x: interpolate.warp(x, back, (9, 7)))
    spin = lambda p: np.stack([p[:, 0] + np.sin(p[:, 1]), p[:, 1] + np.cos(p[:, 0])], 1)
    same(grid.warp(tiles, 4, spin, None, 1, "edge"), images, lambda x: interpolate.warp(x, spin, None, 1, "edge"))
    for mode, want in (("constant", 7.0), ("grid-constant", 7.0)):
        far = grid.affine_transform(tiles, 4, [1, 1], (1000, 0), (6, 6), 1, mode, 7.0)
        assert all((x == want).all() for k, x in put(far).items() if k is not None)


@pytest.mark.parametrize("order, side, mode", [(3, 3, "mirror"), (2, 4, "grid-wrap"), (5, 2, "mirror"), (4, 5, "reflect")])
def test_spline_coefficients_across_tiles(spark, order, side, mode):
    images = [*PICTURES, RNG.standard_normal((2, 2))]
    same(grid.spline_filter(grid.split(table(spark, images), side), side, order, mode), images, lambda x: interpolate.spline_filter(x, order, mode))


def test_feeds_cover_every_window_once():
    for n, side, lo, hi in ((10, 3, 2, 2), (7, 2, 9, 9), (5, 5, 1, 0), (1, 4, 3, 3)):
        for mode in ("reflect", "mirror", "nearest", "wrap"):
            seen = {}
            for start in range(0, n, side):
                for tile, at, source in grid.feeds(n, side, lo, hi, mode, start):
                    for a, s in zip(at.tolist(), source.tolist()):
                        assert seen.setdefault((tile, a), start + s) == start + s
            for tile in range(0, n, side):
                size = min(side, n - tile) + lo + hi
                assert [seen[tile, a] for a in range(size)] == filters.boundary_at(np.arange(tile - lo, tile - lo + size), n, mode).tolist()
    assert math.isclose(sum(1 for _ in grid.feeds(10**7, 1000, 4, 4, "reflect", 5_000_000)), 3)
