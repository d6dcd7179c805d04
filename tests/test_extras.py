"""Fits by sums, reworked aggregates, and twins of single functions."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import compare
from lumengrid.functions import geometry, vision
from lumengrid.operators import fits, histograms, regions
from lumengrid.sources import images as src

DATA = "/root/testdata/sf0.001"
NAMES = "fourier_ellipsoid shift_cubic swirl corner_harris frangi canny daisy grey_reconstruction threshold_li threshold_yen threshold_minimum equalize_adapthist match_histograms region_shapes region_images optical_flow_tvl1 phase_cross_correlation resample_poly delta_e luv2rgb cross_correlate_masked uirfftn ball subdivide_polygon_closed event_sessions stream_histogram label_rollup".split()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in compare.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and compare.rows(got) == compare.rows(want)


def points(spark, maps, noise=0.0, n=60):
    rng = np.random.default_rng(3)
    rows, parts = [], {}
    for g, t in enumerate(maps):
        p = rng.uniform(-40, 60, (n + 20 * g, 2))
        q = t(p) + rng.normal(0, noise, p.shape)
        parts[g] = p, q
        rows += [(g, *map(float, a), *map(float, b)) for a, b in zip(p, q)]
    return spark.createDataFrame(rows, "g int, x double, y double, u double, v double").repartition(5), parts


def matrices(df):
    return {r.g: np.array([r[c] for c in fits.PARAMS], float).reshape(3, 3) for r in df.collect()}


def test_fits_agree_with_the_driver_side_ones(spark):
    maps = [geometry.ProjectiveTransform([[1.1, 0.2, 5], [-0.1, 0.9, 2], [0.0004, 0.0007, 1]]), geometry.AffineTransform(scale=(2, 0.5), rotation=0.7, shear=0.1, translation=(3, -8)), geometry.AffineTransform(scale=1.4, rotation=-2.0, translation=(1, 2))]
    pairs, parts = points(spark, maps, 0.3)
    for fit, kind in ((lambda p: fits.fit_projective(p, ["g"]), geometry.ProjectiveTransform), (lambda p: fits.fit_projective(p, ["g"], True), geometry.AffineTransform), (lambda p: fits.fit_similarity(p, ["g"]), geometry.SimilarityTransform), (lambda p: fits.fit_similarity(p, ["g"], False), geometry.EuclideanTransform)):
        got = matrices(fit(pairs))
        for g, (p, q) in parts.items():
            t = kind()
            assert t.estimate(p, q) and np.allclose(got[g], t.params, atol=1e-6)
    row = fits.properties(fits.fit_projective(points(spark, maps[1:2])[0], ["g"], True), ["g"]).first()
    assert np.allclose(row[1:], [2, 0.5, 0.7, 0.1, 3, -8], atol=1e-8)


def test_polynomial_and_epipolar_fits(spark):
    rng = np.random.default_rng(1)
    space = rng.uniform(-1, 1, (80, 3)) + (0, 0, 4)
    turned = space @ np.array([[0.9, 0.1, -0.2], [-0.1, 1.0, 0.05], [0.2, -0.04, 0.97]]).T + (0.5, 0.1, 0.2)
    p, q = space[:, :2] / space[:, 2:], turned[:, :2] / turned[:, 2:]
    df = spark.createDataFrame([(1, *map(float, a), *map(float, b)) for a, b in zip(p, q)], "g int, x double, y double, u double, v double")
    for essential, kind in ((False, geometry.FundamentalMatrixTransform), (True, geometry.EssentialMatrixTransform)):
        t = kind()
        t.estimate(p, q)
        f = fits.fit_fundamental(df, ["g"], essential)
        m = matrices(f)[1]
        a, b = m / np.linalg.norm(m), t.params / np.linalg.norm(t.params)
        assert np.allclose(a, b, atol=1e-5) or np.allclose(a, -b, atol=1e-5)
        got = fits.epipolar_residuals(df, f, ["g"]).orderBy("x").toPandas().residual
        assert np.allclose(got, t.residuals(p, q)[np.argsort(p[:, 0])], atol=1e-6)
    t = geometry.PolynomialTransform()
    t.estimate(p, q, 2)
    row = fits.fit_polynomial(df, ["g"], 2).first()
    assert np.allclose([row[f"{n}_{k}"] for n in "ab" for k in range(6)], t.params.ravel(), atol=1e-6)


def test_matching_equals_interpolated_quantiles(spark):
    rng = np.random.default_rng(2)
    own, ref = np.round(rng.normal(0, 1, (2, 400)), 2), np.round(rng.gamma(2, 2, 3000), 3)
    px = spark.createDataFrame([(g, k, float(v)) for g, row in enumerate(own) for k, v in enumerate(row)], "image_id int, k int, v double")
    got = histograms.match_histograms(px, spark.createDataFrame([(float(v),) for v in ref], "v double")).toPandas()
    values, counts = np.unique(ref, return_counts=True)
    quantile = np.cumsum(counts) / len(ref)
    assert len(got) == own.size
    for g in (0, 1):
        v, inverse, n = np.unique(own[g], return_inverse=True, return_counts=True)
        want = np.interp(np.cumsum(n) / len(own[g]), quantile, values)[inverse]
        assert np.allclose(got[got.image_id == g].sort_values("v").matched, np.sort(want), atol=1e-9)
    assert histograms.match_histograms(px, spark.createDataFrame([], "v double")).count() == 0


def test_label_statistics(spark):
    rows = [(1, 1, 3, 2, 5.0), (1, 1, 0, 9, -1.0), (1, 1, 0, 2, -1.0), (1, 1, 4, 4, 5.0), (1, 1, 9, 9, None), (1, 2, 0, 0, 2.0), (None, 2, 1, 1, 3.0), (1, 3, 0, 0, None)]
    got = {(r.image_id, r.label): r for r in regions.label_stats(spark.createDataFrame(rows, "image_id int, label int, y int, x int, v double")).collect()}
    a = got[1, 1]
    assert (a.n, a["sum"], a.median, a.min_y, a.min_x, a.max_y, a.max_x, a.minimum, a.maximum) == (4, 8.0, 2.0, 0, 2, 3, 2, -1.0, 5.0)
    assert got[1, 2].median == 2.0 and got[None, 2].median == 3.0 and got[1, 3].n == 0 and got[1, 3].median is None
    assert regions.label_stats(spark.createDataFrame([], "image_id int, label int, y int, x int, v double")).count() == 0


def test_signals_have_every_hour(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet").toPandas()
    got = {r.image_id: np.array(r.img) for r in src.event_signals(spark, DATA).collect()}
    hour = ((e.ts - np.datetime64("2024-01-01")).dt.total_seconds() // 3600).astype(int)
    for user, g in e.assign(hour=hour).query("0 <= hour < 720").groupby("user_id"):
        want = np.zeros(720)
        np.add.at(want, g.hour.to_numpy(), g.value.to_numpy())
        assert np.allclose(got[user], want)


def test_thresholds_of_both_kinds_agree(spark):
    rng = np.random.default_rng(5)
    counts = rng.poisson(0.2, (40, 256))
    counts[0] = 0
    counts[0, 77] = 9
    rows = [(g, k, int(n)) for g, row in enumerate(counts) for k, n in enumerate(row) if n]
    hist = spark.createDataFrame(rows, "image_id int, bin int, n long")
    got = {r.image_id: r.threshold for r in histograms.threshold_otsu(hist).collect()}
    assert [got[g] for g in range(40)] == vision.threshold_otsu(counts).tolist()
    yen = {r.image_id: r.threshold for r in histograms.threshold_yen(hist).collect()}
    for g, row in enumerate(counts[1:], 1):
        p = row / row.sum()
        below, a, b = np.cumsum(p), np.cumsum(p * p), np.cumsum((p * p)[::-1])[::-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = -np.log(a[:-1] * b[1:]) + 2 * np.log(below[:-1] * (1 - below[:-1]))
        score[(row[:-1] == 0) | (np.arange(255) >= np.flatnonzero(row)[-1])] = -np.inf
        assert yen[g] == np.round(score, 9).argmax()


def test_subdivision_goes_along_the_line():
    line = np.stack([np.arange(5.0), np.zeros(5)], 1)
    assert np.allclose(geometry.subdivide_polygon(line)[:, 0], [0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3.25, 3.75])
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)
    out = geometry.subdivide_polygon(square, 3)
    assert np.allclose(out[0], out[-1]) and len(out) == 9


def test_region_images_cover_their_boxes(spark):
    px = spark.createDataFrame([(1, y, x, 1, 2.0) for y, x in ((2, 3), (2, 4), (3, 4), (5, 3))] + [(1, 4, 3, 0, 9.0)], "image_id long, y int, x int, label int, v double")
    got = {(r.y, r.x): (r.image, r.intensity_image) for r in regions.region_images(px).collect()}
    assert len(got) == 8 and sum(i for i, _ in got.values()) == 4 and got[2, 0] == (False, 0.0)
    assert [tuple(c) for c in regions.region_coords(px).first().coords] == [(2, 3), (2, 4), (3, 4), (5, 3)]
    assert regions.local_centroids(px).first().local_centroid_0 == 1.0
    assert regions.region_images(px.where("label = 0")).count() == 0
