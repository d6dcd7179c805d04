import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.operators import histograms, labelled

RNG = np.random.default_rng(4)


@pytest.fixture(scope="module")
def px(spark):
    rows = []
    for k in range(3):
        for y, x in itertools.product(range(7), range(6)):
            rows.append((k, y, x, float(RNG.integers(0, 9)) / 4 if (y, x) != (2, 2) else None, int(RNG.integers(-1, 4)) if k < 2 else 0))
    return spark.createDataFrame(rows, "image_id long, y int, x int, v double, label int").repartition(3).cache()


def brute(rows):
    """All measurements of some pixels, in raster order."""
    rows = sorted((r.y, r.x, r.v) for r in rows if r.v is not None)
    v = np.array([r[2] for r in rows])
    if not len(v):
        return {"sum": 0.0, "mean": math.nan, "variance": math.nan, "standard_deviation": math.nan} | dict.fromkeys("minimum maximum median min_y min_x max_y max_x com_y com_x".split())
    lo, hi = rows[int(v.argmin())], rows[int(v.argmax())]
    mass = v.sum()
    centre = [sum(r[a] * r[2] for r in rows) / mass if mass else None for a in (0, 1)]
    return {"sum": mass, "mean": v.mean(), "variance": v.var(), "standard_deviation": v.std(), "minimum": v.min(), "maximum": v.max(), "median": np.median(v), "min_y": lo[0], "min_x": lo[1], "max_y": hi[0], "max_x": hi[1], "com_y": centre[0], "com_x": centre[1]}


def same(row, want):
    for name, value in want.items():
        got = row[name]
        assert (got is None) == (value is None), (row, name, value)
        assert value is None or (math.isnan(got) and math.isnan(value)) or abs(got - value) < 1e-9, (row, name, value)


def test_eleven_measurements_in_every_form_of_index(spark, px):
    names, every = list(labelled.COLUMNS), px.collect()
    own = lambda k, keep: [r for r in every if r.image_id == k and keep(r.label)]
    for r in labelled.measure(px, names).collect():
        same(r, brute(own(r.image_id, lambda _: True)))
    for r in labelled.measure(px, names, "label").collect():
        same(r, brute(own(r.image_id, lambda l: l > 0)) | {"sum": brute(own(r.image_id, lambda l: l != 0))["sum"]})
    assert labelled.measure(px, ["sum"], "label").count() == 3
    for r in labelled.measure(px, names, "label", 2).collect():
        assert r.pos == 0 and r.label == 2
        same(r, brute(own(r.image_id, lambda l: l == 2)))
    index = [3, 1, 1, 99, 0, -1]
    for form in (index, spark.createDataFrame(list(enumerate(index)), "pos int, label int")):
        got = labelled.measure(px, names, "label", form).collect()
        assert sorted((r.image_id, r.pos, r.label) for r in got) == [(k, p, l) for k in range(3) for p, l in enumerate(index)]
        for r in got:
            same(r, brute(own(r.image_id, lambda l: l == r.label)))
    assert labelled.measure(px, names, "label", []).collect() == []


def test_users_aggregates_by_label(spark, px):
    every = px.where("v is not null").collect()
    want = {}
    for r in every:
        want.setdefault((r.image_id, r.label), []).append(r.v)
    # A trimmed range: the second greatest less the second least value.
    pick = lambda v: np.r_[np.sort(v)[:2], np.sort(v)[-2:]]
    steps = (pick, lambda a, b: np.r_[np.sort(np.r_[a[:2], b[:2]])[:2], np.sort(np.r_[a[-2:], b[-2:]])[-2:]], lambda s: s[-2] - s[1])
    got = {(r.image_id, r.label): r.out for r in labelled.aggregate(px, *steps).collect()}
    assert set(got) == set(want)
    for key, values in want.items():
        if len(values) >= 4:
            assert got[key] == sorted(values)[-2] - sorted(values)[1]
    span = labelled.aggregate(px, lambda v, y, x: [y.min(), y.max()], lambda a, b: [min(a[0], b[0]), max(a[1], b[1])], lambda s: s[1] - s[0], out="height long", positions=True)
    assert {(r.image_id, r.label): r.height for r in span.collect()} == {k: max(r.y for r in every if (r.image_id, r.label) == k) - min(r.y for r in every if (r.image_id, r.label) == k) for k in want}
    index = spark.createDataFrame([(0, 1), (0, 55)], "image_id long, label int")
    assert {r.label: r.out for r in labelled.aggregate(px, lambda v: [v.sum()], lambda a, b: a + b, lambda s: s[0], default=-1.0, index=index).collect()} == {1: sum(want[0, 1]), 55: -1.0}


def test_half_of_all_pixels_in_one_label_leave_only_states(spark):
    n = 20_000
    px = spark.range(n, numPartitions=6).select(F.lit(0).alias("image_id"), F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("label"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.col("id").cast("double").alias("v"))
    hot = px.where("label = 1 or label < 100")
    seen = spark.sparkContext.accumulator(0)

    def merge(a, b):
        seen.add(1)
        return a + b

    got = {r.label: r.out for r in labelled.aggregate(hot, lambda v: [v.sum()], merge, lambda s: s[0]).collect()}
    assert got[1] == sum(range(0, n, 2)) + 1 and len(got) == 50
    assert seen.value < 100  # batches and tasks meet, not pixels


@pytest.mark.parametrize("edges", [[0.0, 1.0], [-1.0, 0.0, 0.5, 2.0, 2.0, 7.0], [0.0, 1.0, 1.0], [k * 0.37 - 200 + (k % 3) * 0.01 for k in range(1500)]])
def test_uneven_edges_are_numpys(spark, edges):
    values = [*RNG.uniform(min(edges) - 1, max(edges) + 1, 400).tolist(), *edges[:40], edges[-1], float("nan"), None]
    df = spark.createDataFrame([(v, 2.0, k % 2) for k, v in enumerate(values)], "v double, w double, k int")
    clean = [v for v in values if v is not None and v == v]
    want = np.histogram(clean, edges)[0]
    got = {r.bin_v: r.n for r in histograms.histogramdd(df, {"v": edges}).collect()}
    assert [got.get(k, 0) for k in range(len(edges) - 1)] == want.tolist()
    if len(edges) > 2 and edges[-1] > edges[-2] and len(edges) < 100:
        both = histograms.histogramdd(df, {"v": edges, "w": (2, 0.0, 3.0)}, ["k"], weight=F.col("w"), density=True).collect()
        for k in (0, 1):
            own = [(v, 2.0) for j, v in enumerate(values) if j % 2 == k and v is not None and v == v]
            some = [e for i, e in enumerate(edges) if i == 0 or e > edges[i - 1]]
            exact = np.histogramdd(np.array(own), [some, np.array([0, 1.5, 3.0])], weights=[2.0] * len(own), density=True)[0]
            assert np.isclose(sorted(r.density for r in both if r.k == k), sorted(exact[exact > 0])).all()


def test_edges_must_ascend(spark):
    for bad in ([1.0], [1.0, 0.0]):
        with pytest.raises(ValueError):
            histograms.bin_of(F.col("v"), bad)
