import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.functions import vision
from lumengrid.operators import grid, peaks

RNG = np.random.default_rng(3)


def greedy(rows, spacing, p):
    """Brute force: strongest first, each against all that stay."""
    out = []
    for v, y, x in sorted(((-v, y, x) for y, x, v in rows)):
        if all(np.linalg.norm([y - a, x - b], p) >= spacing for a, b in out):
            out.append((y, x))
    return sorted(out)


@pytest.mark.parametrize("p, spacing", [(math.inf, 3), (2, 4.5)])
def test_spacing_equals_the_greedy_rule(spark, p, spacing):
    images = {}
    for k in range(3):
        at = {(int(y), int(x)) for y, x in RNG.integers(0, 18, (150, 2))}
        images[k] = [(y, x, float(RNG.integers(0, 6))) for y, x in at]  # many ties, crowded
    images[3] = [(0, x, float(x)) for x in range(12)]  # a ramp: each rejects the one before
    rows = [(k, y, x, v) for k, own in images.items() for y, x, v in own] + [(0, None, 1, 9.0), (1, 1, 1, None), (None, 3, 3, 1.0), images[0][0] and (0, *images[0][0])]
    got = peaks.ensure_spacing(spark.createDataFrame(rows, "image_id long, y int, x int, v double").repartition(4), spacing, p).collect()
    for k, own in images.items():
        assert sorted((r.y, r.x) for r in got if r.image_id == k) == greedy(own, spacing, p), k
    assert sum(r.image_id is None for r in got) == 1
    assert peaks.ensure_spacing(spark.createDataFrame([], "image_id long, y int, x int, v double"), 3).collect() == []


@pytest.mark.parametrize("p, block", [(2, 1 << 15), (math.inf, 250), (1, 30)])  # blocks that all fit, some that don't, almost none
def test_spacing_across_blocks(spark, p, block):
    images = {0: [(y, x, float(RNG.integers(0, 9))) for y, x in {(int(y), int(x)) for y, x in RNG.integers(-60, 90, (1200, 2))}]}
    images[1] = [(y, x, float(RNG.integers(0, 99))) for y in range(20, 50) for x in range(10, 45)]  # full, over the corner of four blocks
    images[2] = [(0, 2 * x, float(x)) for x in range(60)]  # a ramp through three blocks
    rows = [(k, y, x, v) for k, own in images.items() for y, x, v in own] + [(2, 0, 4, -1.0), (1, 31, 31, -1.0)]
    got = peaks.ensure_spacing(spark.createDataFrame(rows, "image_id long, y int, x int, v double").repartition(4), 3, p, block=block).collect()
    for k, own in images.items():
        assert sorted((r.y, r.x) for r in got if r.image_id == k) == greedy(own, 3, p), k


def test_spacing_takes_one_pass_where_images_fit_a_block(spark, monkeypatch):
    staged = []
    stage = grid.stage
    monkeypatch.setattr(grid, "stage", lambda df, *a: staged.append(1) or stage(df, *a))
    rows = [(k, y, x, float((7 * y + 3 * x + k) % 11)) for k in range(20) for y in range(8) for x in range(8)]
    got = peaks.ensure_spacing(spark.createDataFrame(rows, "image_id long, y int, x int, v double").repartition(3), 3, 2).collect()
    for k in range(20):
        assert sorted((r.y, r.x) for r in got if r.image_id == k) == greedy([r[1:] for r in rows if r[0] == k], 3, 2)
    assert len(staged) == 1


def test_spacing_of_other_types(spark):
    df = spark.createDataFrame([(1.5, 2.0, 3), (float("nan"), 1.0, 2), (float("nan"), 1.0, 1), (1.0, 2.0, 2), (-7.0, 0.5, 9)], "y double, x double, v long")
    for kind in ("long", "decimal(10, 2)", "float", "string"):
        got = peaks.ensure_spacing(df.withColumn("v", F.col("v").cast(kind)), 1.5, 2, keys=[]).collect()
        assert sorted(str((r.y, r.x)) for r in got) == ["(-7.0, 0.5)", "(1.5, 2.0)", "(nan, 1.0)"], kind


def test_peaks_of_tiles_are_those_of_the_whole_image(spark):
    flat = np.zeros((9, 9))
    flat[1:3, 1:3] = 10
    images = [RNG.random((20, 23)), RNG.integers(0, 4, (15, 15)).astype(float), flat, np.ones((6, 6)), -RNG.random((9, 12))]
    rows = [(k, list(x.shape), x.ravel().tolist()) for k, x in enumerate(images)]
    tiles = grid.split(spark.createDataFrame(rows, "image_id long, shape array<int>, img array<double>"), 6)
    cross = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]])
    for options in ({"min_distance": 3, "exclude_border": False, "p_norm": 2}, {"min_distance": 2, "num_peaks": 3, "threshold_rel": 0.5}, {"min_distance": 2, "footprint": cross, "exclude_border": 1, "threshold_abs": 0.1}):
        got = peaks.peak_local_max(tiles, 6, **options).collect()
        for k, x in enumerate(images):
            want = vision.peak_local_max(x[None], **options)[0].tolist()
            assert sorted([r.y, r.x] for r in got if r.image_id == k) == sorted(want), (options, k)
