import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.functions import color, filters, interpolate, morphology, signal, vision
from lumengrid.operators import shapes, views

RNG = np.random.default_rng(7)


def _pixels(spark, label, v):
    rows = [(1, y, x, int(label[y, x]), float(v[y, x])) for y in range(label.shape[0]) for x in range(label.shape[1]) if label[y, x]]
    return spark.createDataFrame(rows, "image_id long, y int, x int, label int, v double")


def test_region_moments_match_sums_over_pixels(spark):
    label, v = RNG.integers(0, 3, (6, 7)), RNG.random((6, 7)) + 0.5
    for weight in (None, F.col("v")):
        for r in shapes.region_moments(_pixels(spark, label, v), weight).collect():
            y, x = np.nonzero(label == r.label)
            w = np.ones(len(y)) if weight is None else v[y, x]
            cy, cx = (w * y).sum() / w.sum(), (w * x).sum() / w.sum()
            nu = np.zeros((4, 4))
            for i, j in shapes.ORDERS:
                mu = (w * (y - cy) ** i * (x - cx) ** j).sum()
                assert abs(r[f"mu_{i}_{j}"] - mu) < 1e-9
                nu[i, j] = mu / w.sum() ** (1 + (i + j) / 2)
            assert np.allclose([r[f"hu_{k}"] for k in range(7)], vision.moments_hu(nu), atol=1e-12)
    assert shapes.region_moments(_pixels(spark, label, v).limit(0)).count() == 0


def test_region_shapes_of_known_regions(spark):
    img = np.zeros((7, 9))
    img[1:6, 1:6] = 1
    img[3, 3] = 0  # a ring with one hole
    img[1, 7] = 2
    img[6, 8] = 2  # two lone pixels of one label
    rows = [(1, [7, 9], img.ravel().tolist()), (2, None, None), (3, [2, 2], [1.0]), (4, [2, 2], [0.0] * 4)]
    got = shapes.region_shapes(spark.createDataFrame(rows, "image_id long, shape array<int>, img array<double>")).orderBy("label").collect()
    assert [(r.image_id, r.label, r.area, r.filled_area, r.euler_number) for r in got] == [(1, 1, 24, 25, 0), (1, 2, 2, 2, 2)]
    assert got[0].convex_area == 25 and abs(got[0].solidity - 0.96) < 1e-12 and abs(got[0].feret_diameter_max - 41**0.5) < 1e-9


def test_views(spark):
    x = np.arange(20.0).reshape(4, 5)
    px = spark.createDataFrame([(1, y, k, float(x[y, k])) for y in range(4) for k in range(5)], "image_id long, y int, x int, v double")
    out = np.zeros((2, 3))
    for r in views.crop(px, ((1, 1), (2, 0)), (4, 5)).collect():
        out[r.y, r.x] = r.v
    assert (out == x[1:3, 2:]).all()
    want = np.lib.stride_tricks.sliding_window_view(x, (2, 3))[::2, ::2]
    got = np.full(want.shape, np.nan)
    for r in views.view_as_windows(px, (2, 3), (4, 5), 2).collect():
        got[r.wy, r.wx, r.y, r.x] = r.v
    assert (got == want).all()
    many = views.ArrayMap([1, 2], [5.0, 6.0])
    many[3] = 7.0
    ints = px.where("v < 5").withColumn("v", F.col("v").cast("long"))
    assert sorted(r.v for r in many(ints).collect()) == [0.0, 0.0, 5.0, 6.0, 7.0] and many[2] == 6.0 and many[9] == 0


def test_entropy_and_contrast(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", 5.0, 1.0)], "k string, p double, q double")
    plain = {r.k: r.entropy for r in views.entropy(df, ["k"], F.col("p"), base=2).collect()}
    other = {r.k: r.entropy for r in views.entropy(df, ["k"], F.col("p"), F.col("q")).collect()}
    assert abs(plain["a"] - (0.25 * 2 + 0.75 * np.log2(4 / 3))) < 1e-12 and plain["b"] == 0
    assert abs(other["a"] - (0.25 * np.log(0.5) + 0.75 * np.log(1.5))) < 1e-12
    px = spark.createDataFrame([(1, 0, k, k / 1000) for k in range(10)] + [(2, 0, k, k / 10) for k in range(10)], "image_id long, y int, x int, v double")
    assert {r.image_id: r.low_contrast for r in views.is_low_contrast(px).collect()} == {1: True, 2: False}


def test_kernels():
    x = RNG.random((2, 9, 8))
    mask = np.ones((9, 8), bool)
    assert np.allclose(filters.smooth_with_function_and_mask(x, filters.uniform_filter, mask), filters.uniform_filter(x))
    k = RNG.random((3, 3))
    assert np.allclose(signal.correlate2d(x, k, "same"), filters.correlate(x, k, "constant"))
    box = signal.LPIFilter2D(lambda r, c: (abs(r) + abs(c) == 0).astype(float))
    assert np.allclose(box(x), x) and np.allclose(box.inverse(x), x) and np.allclose(box.wiener(x, 0.25), x / 1.25)
    assert morphology.star(2).shape == (7, 7) and morphology.star(2)[0].sum() == 1 and morphology.ellipse(2, 1).shape == (3, 5)
    both = vision.compute_hessian_eigenvalues(x, 1.0, "val")
    assert (both[0] <= both[1]).all()
    assert [p.shape[1:] for p in vision.get_pyramid(RNG.random((1, 64, 64)))] == [(32, 32), (64, 64)]
    f = interpolate.RegularGridInterpolator(([0.0, 1, 3], [0.0, 2]), [[0, 2], [1, 3], [3, 5]])
    assert np.allclose(f([[0.5, 1.0], [2.0, 0.5]]), [1.5, 2.5])
    with pytest.raises(ValueError):
        interpolate.RegularGridInterpolator(([0, 0],), [1, 2])
    assert color.is_rgb_like((4, 4, 3)) and not color.is_rgb_like((4, 4)) and color.get_xyz_coords("d65", "2")[1] == 1.0
    assert set(vision.try_all_threshold(x)) >= {"li", "mean", "triangle"}
