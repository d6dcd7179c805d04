import numpy as np

from lumengrid.functions import geometry, morphology
from lumengrid.operators import grid, shapes, tile_regions

RNG = np.random.default_rng(8)


def test_region_shapes_of_tiles_are_those_of_whole_images(spark):
    ring = np.zeros((13, 17))
    ring[1, 2:15] = ring[11, 2:15] = ring[1:12, 2] = ring[1:12, 14] = 1
    ring[4:8, 5:9] = 2
    ring[5, 6] = 0  # a hole of the inner region, itself in the hole of the outer one
    noise = morphology.label(RNG.random((1, 14, 11)) < 0.28, np.ones((3, 3)))[0].astype(float)
    edge = np.zeros((8, 8))
    edge[:, -1] = edge[-1] = 5  # along the last row and column
    images = [ring, noise, edge, np.zeros((4, 4)), np.full((5, 9), 3.0)]
    rows = [(k, list(x.shape), x.ravel().tolist()) for k, x in enumerate(images)]
    df = spark.createDataFrame(rows, "image_id long, shape array<int>, img array<double>")
    key = lambda r: (r.image_id, r.label)
    want = sorted(shapes.region_shapes(df).collect(), key=key)
    got = sorted(tile_regions.region_shapes(grid.split(df, 4), 4).collect(), key=key)
    assert len(got) == len(want) > 10
    for a, b in zip(got, want):
        assert key(a) == key(b)
        for name in b.__fields__[2:]:
            assert abs(a[name] - b[name]) < 1e-9, (key(a), name, a[name], b[name])


def test_gathered_and_spread_images_give_the_same_shapes(spark, monkeypatch):
    spread = np.zeros((40, 23))
    spread[RNG.random(spread.shape) < 0.4] = 7  # one label in many pieces, higher than the rows measured side by side
    spread[3:20, 4:9], spread[5:12, 6] = 2, 0
    thin = np.zeros((9, 20))
    thin[[0, 2, 8], [0, 3, 19]] = 4  # rows of the hull without a pixel
    ring = np.zeros((13, 17))
    ring[1, 2:15] = ring[11, 2:15] = ring[1:12, 2] = ring[1:12, 14] = 1
    ring[4:8, 5:9], ring[5, 6] = 2, 0
    images = [spread, thin, ring, *[(RNG.random((8, 8)) < 0.5) * RNG.integers(1, 4, (8, 8)).astype(float) for _ in range(12)], np.eye(5), np.zeros((3, 3)), np.ones((1, 1))]
    rows = [(k, list(x.shape), np.asarray(x, float).ravel().tolist()) for k, x in enumerate(images)] + [(None, [1, 1], [1.0]), (99, [2, 2], [1.0])]
    df = spark.createDataFrame(rows, "image_id long, shape array<int>, img array<double>")
    key = lambda r: (r.image_id, r.label)
    want = sorted((r for r in shapes.region_shapes(df).collect() if r.image_id is not None), key=key)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # images go on from batch to batch
    staged, stage = [], grid.stage
    monkeypatch.setattr(grid, "stage", lambda df, *a: staged.append(1) or stage(df, *a))
    try:
        whole = tile_regions.region_shapes(grid.split(df, 3), 3).collect()
        assert len(staged) == 1
        mixed = tile_regions.region_shapes(grid.split(df.where("image_id < 6"), 3), 3, 64).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for got, some in ((whole, want), (mixed, [r for r in want if r.image_id < 6])):
        assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in some]
        for a, b in zip(sorted(got, key=key), some):
            for name in b.__fields__[2:]:
                assert abs(a[name] - b[name]) < 1e-9, (key(a), name, a[name], b[name])


def test_hulls_of_stacks_are_those_of_single_masks():
    masks = np.pad(RNG.random((200, 11, 8)) < RNG.choice([0.03, 0.1, 0.5], 200)[:, None, None], ((0, 0), (1, 1), (1, 1)))
    masks = masks[masks.any((1, 2))]
    convex, far = tile_regions.stack_hulls(masks)
    assert convex.tolist() == [geometry.convex_area(m) for m in masks]
    assert np.allclose(far, [geometry.feret_diameter_max(m) for m in masks], 0, 1e-9)
