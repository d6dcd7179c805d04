"""Values worked out by hand from the definitions, not from the code."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumengrid.functions import color, filters, morphology, vision
from lumengrid.operators import regions, runtime

N = np.nan


def test_shape_index_of_a_bump():
    square = np.zeros((1, 5, 5))
    square[0, 2, 2] = 4
    want = [[N, N, -0.5, N, N], [N, 0, N, 0, N], [-0.5, N, -1, N, -0.5], [N, 0, N, 0, N], [N, N, -0.5, N, N]]
    np.testing.assert_almost_equal(vision.shape_index(square, 0.1)[0], want, 6)


def test_peaks_on_a_plateau_and_beside_each_other():
    x = np.zeros((1, 5, 5))
    x[0, 1:3, 1:3] = 10
    assert len(vision.peak_local_max(x, 1)[0]) == 4
    assert vision.corner_peaks(x, 1)[0].tolist() == [[1, 1]]
    x = np.zeros((1, 7, 7))
    x[0, 3, 4], x[0, 3, 2] = 1, 1.5
    assert vision.peak_local_max(x, 1)[0].tolist() == [[3, 2], [3, 4]]  # at exactly the distance of 2 both stay
    assert vision.peak_local_max(x, 2)[0].tolist() == [[3, 2]]
    assert vision.peak_local_max(x, 1, num_peaks=1)[0].tolist() == [[3, 2]]
    assert len(vision.peak_local_max(np.ones((1, 6, 6)))[0]) == 0


def test_peaks_by_label():
    x = np.zeros((1, 9, 9))
    x[0, 2, 2], x[0, 2, 6], x[0, 6, 2], x[0, 6, 6], x[0, 4, 2] = 1, 2, 3, 4, 0.5
    lab = np.ones((1, 9, 9), int)
    lab[0, :, 5:] = 7
    assert vision.peak_local_max(x, 1, labels=lab)[0].tolist() == [[6, 2], [2, 2], [4, 2], [6, 6], [2, 6]]
    assert vision.peak_local_max(x, 1, labels=lab, num_peaks_per_label=1)[0].tolist() == [[6, 2], [6, 6]]
    assert vision.peak_local_max(x, 1, labels=lab, num_peaks=3)[0].tolist() == [[6, 6], [6, 2], [2, 6]]
    assert vision.peak_local_max(x, 1, labels=np.zeros((1, 9, 9), int))[0].tolist() == []


def test_spacing_by_norm():
    points = [[0, 0], [1, 1], [0, 2], [3, 0]]
    assert vision.ensure_spacing(points, 2) == [0, 2, 3]
    assert vision.ensure_spacing(points, 2, 1) == [0, 1, 2, 3]
    assert vision.ensure_spacing(points, 1.5, 2) == [0, 2, 3]
    assert vision.ensure_spacing(points, 2, closed=True) == [0, 3]
    assert vision.ensure_spacing(np.zeros((0, 2)), 2) == []


def test_sharpening_stays_in_range():
    x = np.zeros((2, 9, 9))
    x[0, 4, 4], x[1] = 0.5, np.where(np.arange(9) % 2, 1.0, -1.0)
    got = filters.unsharp_mask(x, 1.0, 5.0)
    assert got[0].min() == 0 and got[0].max() == 1 and got[1].min() == -1 and got[1].max() == 1
    assert np.allclose(filters.unsharp_mask(x, 1.0, 5.0, True), x + 5 * (x - filters.gaussian_filter(x, 1.0)))


def test_meijering_takes_the_greater_eigenvalue_against_the_least():
    x = np.random.default_rng(0).random((1, 8, 8))
    a, b, c = vision.hessian_matrix(1 - x, 1.0, "reflect")
    want = np.zeros((8, 8))
    for y, k in itertools.product(range(8), range(8)):
        e = np.linalg.eigvalsh([[a[0, y, k], b[0, y, k]], [b[0, y, k], c[0, y, k]]])
        want[y, k] = 1.5 * e[np.abs(e).argmax()]
    want = np.where(want < 0, want / want.min(), 0)
    assert np.allclose(vision.ridges(x, (1,), "meijering")[0], want)
    for kind in ("sato", "meijering", "frangi"):  # a constant has no ridges, at the edge neither
        assert np.allclose(vision.ridges(np.full((1, 6, 6), 0.7), (1, 2), kind), 0, atol=1e-6)


def test_clipped_histograms():
    assert vision.clip_histogram([10, 0, 0, 0], 4).tolist() == [4, 2, 2, 2]
    assert vision.clip_histogram([9, 3, 0, 0], 4).tolist() == [4, 4, 2, 2]
    assert vision.clip_histogram([3, 2, 2, 1], 4).tolist() == [3, 2, 2, 1]
    assert vision.clip_histogram([7, 0, 0, 0], 2).tolist() == [2, 2, 2, 2]  # 5 over: 1 each raises three bins to 1, which counts as nearly full
    assert vision.map_histogram(np.array([1, 0, 3]), 0, 100, 4).tolist() == [25, 25, 100]


def test_local_equalisation_of_two_levels():
    x = np.zeros((1, 16, 16))
    x[0, 4:12, 4:12] = 1
    out = vision.equalize_adapthist(x, 4, 0.5)
    assert out.min() == 0 and out.max() == 1 and (out[x == 1] > out[x == 0].max()).all()
    assert np.allclose(vision.equalize_adapthist(np.zeros((1, 8, 8))), vision.equalize_adapthist(np.zeros((1, 8, 8)))[0, 0, 0])


def test_daisy_normalisations():
    x = np.random.default_rng(0).random((1, 20, 20))
    off = vision.daisy(x, 4, 6, 2, 6, 8, "off")
    assert off.shape == (1, 2, 2, (2 * 6 + 1) * 8)
    assert np.allclose(vision.daisy(x, 4, 6, 2, 6, 8).sum(-1), 1) and np.allclose((vision.daisy(x, 4, 6, 2, 6, 8, "l2") ** 2).sum(-1), 1)
    assert np.allclose((vision.daisy(x, 4, 6, 2, 6, 8, "daisy").reshape(1, 2, 2, 13, 8) ** 2).sum(-1), 1)
    assert vision.daisy(x, 4, sigmas=[1, 2, 3], ring_radii=[3, 6], normalization="off").shape[-1] == (2 * 8 + 1) * 8
    # A ramp along x: all of the gradient points at angle 0, the middle of the orientations from -pi.
    ramp = np.tile(np.arange(20.0), (1, 20, 1))
    centre = vision.daisy(ramp, 4, 6, 2, 6, 8, "off")[0, 0, 0, :8]
    assert centre.argmax() == 4
    with pytest.raises(ValueError):
        vision.daisy(x, normalization="max")


def test_boundaries_between_pixels_and_around_objects():
    lab = np.zeros((1, 5, 5), int)
    lab[0, 2:, 2:] = 1
    assert morphology.find_boundaries(lab)[0].astype(int).tolist() == [[0, 0, 0, 0, 0], [0, 0, 1, 1, 1], [0, 1, 1, 1, 1], [0, 1, 1, 0, 0], [0, 1, 1, 0, 0]]
    assert morphology.find_boundaries(lab, mode="outer")[0].astype(int).tolist() == [[0, 0, 0, 0, 0], [0, 0, 1, 1, 1], [0, 1, 0, 0, 0], [0, 1, 0, 0, 0], [0, 1, 0, 0, 0]]
    assert morphology.find_boundaries(lab, mode="inner")[0].sum() == 5
    two = np.array([[[1, 1, 2, 2]]])
    assert morphology.find_boundaries(np.array([[[0, 0, 3, 3]]]), mode="subpixel")[0].astype(int).tolist() == [[0, 0, 0, 1, 0, 1, 0]]
    assert morphology.find_boundaries(two, mode="outer")[0].astype(int).tolist() == [[0, 1, 1, 0]]
    marked = vision.mark_boundaries(np.full((1, 5, 5), 0.25), lab, outline_color=(0, 0, 1))
    assert marked.shape == (1, 5, 5, 3) and marked[0, 1, 2].tolist() == [1, 1, 0] and marked[0, 3, 3].tolist() == [0.25] * 3 and marked[0, 0, 3].tolist() == [0, 0, 1]
    assert vision.mark_boundaries(np.full((1, 3, 4), 0.25), np.zeros((1, 3, 4), int), mode="subpixel").shape == (1, 5, 7, 3)


def table(spark, name, values):
    rows = [(1, y, x, float(v)) for y, line in enumerate(values) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, f"image_id long, y int, x int, {name} double")


def test_blocks_cut_by_the_edge_are_filled_with_zeros(spark):
    values = np.arange(40).reshape(5, 8)
    take = lambda block, agg, **kw: {(r.y, r.x): r.v for r in regions.block_reduce(table(spark, "v", values), block, agg, **kw).collect()}
    assert take((4, 5), F.avg) == {(0, 0): 14.0, (0, 1): 10.8, (1, 0): 8.5, (1, 1): 5.7}
    assert take((3, 3), F.sum) == {(0, 0): 81, (0, 1): 108, (0, 2): 87, (1, 0): 174, (1, 1): 192, (1, 2): 138}
    assert take((4, 5), F.max, cval=99.0)[1, 1] == 99 and take((5, 8), F.sum) == {(0, 0): 780}


def test_joint_labels_keep_the_background(spark):
    a, b = [[0, 0, 1, 1], [0, 2, 1, 1], [2, 2, 2, 1]], [[0, 1, 1, 0], [0, 1, 1, 0], [0, 1, 1, 1]]
    px = table(spark, "a", a).join(table(spark, "b", b), ["image_id", "y", "x"])
    got = np.zeros((3, 4), int)
    for r in regions.join_segmentations(px, "a", "b").collect():
        got[r.y, r.x] = r.joint
    assert got.tolist() == [[0, 1, 3, 2], [0, 5, 3, 2], [4, 5, 5, 3]]
    one = {(r.a, r.b): r.joint for r in regions.join_segmentations(table(spark, "a", [[1, 2]]).withColumn("b", F.lit(0)), "a", "b").collect()}
    assert one == {(1.0, 0): 1, (2.0, 0): 2}


def test_stains_may_be_negative(spark):
    row = spark.range(1).select(color.rgb2hed(color.triple(F.lit(0.1), F.lit(0.9), F.lit(0.4))).alias("s")).first().s
    density = np.log([0.1, 0.9, 0.4]) / np.log(1e-6)
    want = density @ np.linalg.inv(np.array(color.RGB_FROM_HED))
    assert np.allclose([row.a, row.b, row.c], want) and min(want) < 0


@pytest.mark.parametrize("place", [0, 1, 2])
@pytest.mark.parametrize("bad", [None, [1.0], [1.0] * 5])
def test_pairs_and_runs_with_one_bad_row(spark, place, bad):
    rows = [[k, [2, 2], [float(k)] * 4, [10.0 * k] * 4] for k in range(1, 4)]
    for column in (2, 3):
        some = [list(r) for r in rows]
        some[place][column] = bad
        df = spark.createDataFrame([tuple(r) for r in some], "image_id long, shape array<int>, img array<double>, other array<double>").coalesce(1)
        got = {r.image_id: r.img and r.img[0] for r in runtime.map_pairs(df, lambda a, b: a + b, ["image_id"]).collect()}
        assert got == {k: None if k == place + 1 else 11.0 * k for k in range(1, 4)}


def test_lengths_that_only_add_up_are_not_whole():
    shapes, images = pa.array([[2, 2]] * 3), pa.array([[1.0] * 3, [2.0] * 5, [3.0] * 4])
    assert [(c, s is None) for c, s in runtime.stacks(shapes, images)] == [(slice(0, 1), True), (slice(1, 2), True), (slice(2, 3), False)]
    assert [s is None for _, s in runtime.stacks(pa.array([None, [], [0, 3]], pa.list_(pa.int32())), pa.array([[], [1.0], []], pa.list_(pa.float64())))] == [True, True, False]


def test_li_leaves_out_what_is_not_finite():
    clean = np.random.default_rng(1).random((1, 6, 6))
    t = vision.threshold_li(clean)[0]
    dirty = clean.copy()
    dirty[0, 0, 0] = N
    rest = clean.ravel()[1:].reshape(1, 5, 7)
    assert np.isclose(vision.threshold_li(dirty)[0], vision.threshold_li(rest)[0])
    dirty[0, 0, 0] = np.inf
    assert np.isclose(vision.threshold_li(dirty)[0], vision.threshold_li(rest)[0])
    assert np.isnan(vision.threshold_li(np.full((1, 3, 3), N))[0]) and vision.threshold_li(np.full((1, 3, 3), 4.0))[0] == 4
    assert vision.threshold_li(np.array([[[np.inf, -np.inf]]]))[0] == 0
    assert abs(vision.threshold_li(clean, initial_guess=0.9)[0] - t) < 0.2 and abs(vision.threshold_li(clean, initial_guess=np.median)[0] - t) < 0.2
    with pytest.raises(ValueError):
        vision.threshold_li(clean, initial_guess=7.0)


def test_similarity_with_channels_and_weights():
    rng = np.random.default_rng(2)
    a = rng.random((2, 14, 15, 3))
    b = a + 0.1 * rng.random(a.shape)
    each = [vision.structural_similarity(a[..., c], b[..., c]) for c in range(3)]
    assert np.allclose(vision.structural_similarity(a, b, multichannel=True), np.mean(each, 0))
    assert vision.structural_similarity(a, b, multichannel=True, full=True).shape == a.shape
    assert np.allclose(vision.structural_similarity(a[..., 0], a[..., 0], gaussian_weights=True), 1)
    with pytest.raises(ValueError):
        vision.structural_similarity(a[:, :5, :, 0], b[:, :5, :, 0])


def test_features_with_other_edges_look_at_the_padded_image():
    x = np.random.default_rng(3).random((1, 9, 9))
    for mode, pad in (("nearest", "edge"), ("reflect", "symmetric")):
        wide = np.pad(x, ((0, 0), (12, 12), (12, 12)), mode=pad)
        smooth = filters.gaussian_filter(wide, 1.0)[:, 12:-12, 12:-12]
        gy, gx = np.gradient(smooth, axis=1), np.gradient(smooth, axis=2)
        want = np.gradient(gy, axis=1) * np.gradient(gx, axis=2) - np.gradient(gy, axis=2) ** 2
        assert np.allclose(vision.hessian_matrix_det(x, 1.0, mode), want)
    assert not np.allclose(vision.corner_harris(x, mode="nearest"), vision.corner_harris(x))


def test_labels_at_the_edge_are_cleared(spark):
    values = [[0, 1, 1, 0, 0], [0, 0, 1, 0, 0], [0, 2, 0, 3, 0], [0, 2, 0, 3, 0], [0, 0, 0, 0, 0]]
    px = table(spark, "label", values)
    for buffer, kept in ((0, {2.0, 3.0}), (1, set())):
        got = regions.clear_border(px, buffer).collect()
        assert {r.label for r in got} - {0.0} == kept and len(got) == 25
    size = spark.createDataFrame([(1, 9, 9)], "image_id long, rows int, cols int")
    assert {r.label for r in regions.clear_border(px.where("label > 0"), 0, size=size).collect()} == {0.0, 2.0, 3.0}


def lattice(v, source, target, most):
    """The rules of conversion between whole numbers, one value at a time."""
    n, m = int(source.lstrip("uint")), int(target.lstrip("uint"))

    def scale(v, n, m):
        if n > m:
            return v if most < 2**m else v // 2 ** (n - m)
        wide = n
        while wide < m:
            wide += n
        return v * ((2**wide - 1) // (2**n - 1)) // 2 ** (wide - m)

    if source[0] == "u":
        return scale(v, n, m if target[0] == "u" else m - 1)
    if target[0] == "u":
        return max(scale(v, n - 1, m), 0)
    return scale(v, n - 1, m - 1) if n > m else scale(v + 2 ** (n - 1), n, m) - 2 ** (m - 1)


def test_conversions_between_whole_numbers(spark):
    from lumengrid.functions import scalar

    kinds = ["uint8", "int8", "uint16", "int16", "uint32", "int32"]
    for source in kinds:
        lo, hi = scalar.DTYPE_RANGE[source]
        values = sorted({lo, lo + 1, -1 if lo else 0, 0, 1, 2, 100, 127, hi // 2, hi - 1, hi} | {int(v) for v in np.random.default_rng(0).integers(lo, hi, 20)})
        df = spark.createDataFrame([(v,) for v in values], "v long")
        targets = [t for t in kinds if t != source]
        got = df.select("v", *[scalar.convert(F.col("v"), source, t).alias(t) for t in targets], *[scalar.convert(F.col("v"), source, t, most=F.lit(100)).alias(t + "_") for t in targets]).collect()
        for r in got:
            for t in targets:
                assert r[t] == lattice(r.v, source, t, 2**99), (source, t, r.v)
                if r.v <= 100:
                    assert r[t + "_"] == lattice(r.v, source, t, 100), (source, t, r.v)


def test_conversions_to_and_from_floats(spark):
    from lumengrid.functions import scalar

    df = spark.createDataFrame([(-1.0,), (-0.5,), (0.0,), (0.25,), (1.0,)], "v double")
    got = [tuple(r) for r in df.select(scalar.img_as_int(F.col("v")), scalar.img_as_ubyte(F.col("v")), scalar.convert(F.col("v"), "float64", "uint8", True), scalar.convert(F.col("v"), "float64", "int8")).collect()]
    assert got == [(-32768, 0, 0, -128), (-16384, 0, 0, -64), (0, 0, 0, 0), (8191, 64, 64, 31), (32767, 255, 255, 127)]
    back = spark.createDataFrame([(-128,), (0,), (127,)], "v int").select(scalar.img_as_float(F.col("v"), "int8").alias("f")).collect()
    assert np.allclose([r.f for r in back], [-1, 1 / 255, 1])
