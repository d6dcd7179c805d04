import numpy as np
import pytest

from lumengrid.functions import morphology
from lumengrid.operators import tiles

RNG = np.random.default_rng(11)


@pytest.mark.parametrize("connectivity", [1, 2])
def test_labels_of_tiles_are_those_of_the_whole_image(spark, connectivity):
    spiral = np.zeros((17, 17))
    top, left, bottom, right = 0, 0, 16, 16
    while top <= bottom and left <= right:  # one long arm through many tiles
        spiral[top, max(left - 2, 0) : right + 1] = spiral[top : bottom + 1, right] = spiral[bottom, left : right + 1] = spiral[top + 2 : bottom + 1, left] = 1
        top, left, bottom, right = top + 2, left + 2, bottom - 2, right - 2
    masks = [(RNG.random((20, 23)) < 0.5).astype(float), (RNG.random((5, 31)) < 0.7).astype(float), spiral, np.zeros((4, 4)), np.ones((9, 9))]
    rows = [(k, list(x.shape), x.ravel().tolist()) for k, x in enumerate(masks)] + [(9, None, None)]
    images = spark.createDataFrame(rows, "image_id long, shape array<int>, img array<double>")
    got = [np.zeros(x.shape, int) for x in masks]
    for r in tiles.label_tiles(tiles.split(images, 5, 0), connectivity).collect():
        got[r.image_id][r.y, r.x] = r.label
    for x, lab in zip(masks, got):
        assert (lab == morphology.label(x[None] != 0, morphology.generate_binary_structure(2, connectivity))[0]).all()
    assert tiles.label_tiles(tiles.split(images.where("image_id = 3"), 5, 0)).count() == 0
