"""Shapes of labelled regions of images kept as tiles: holes, borders, hulls.

Images that fit a task are gathered from their tiles, by one shuffle, and all
their regions measured side by side.  Of larger ones each region becomes a small binary picture of its own: the tiles its box
touches, with its pixels set.  Work follows the boxes; a region of any size is
spread over its tiles.  Borders and bit quads are counted on windows with
halos, so seams count as anything else; holes are what the outside can't reach
across the region's tiles; hulls are merged from the tiles' hulls, first along
rows of tiles, then over these.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry, morphology, vision
from . import grid
from .grid import DOUBLES, INTS, KEY, PLACE
from .runtime import STACK, _lists, ship

_ID = "image_id"
#: Pixels of an image that one task gathers, at most.
WHOLE = 1 << 16
#: Rows of a region's box up to which hulls of many regions are found side by side.
LOW = 16
MEASURES = {"label": "long", "area": "long", "filled_area": "long", "convex_area": "double", "solidity": "double", "perimeter": "double", "perimeter_crofton": "double", "euler_number": "long", "feret_diameter_max": "double"}


def region_boxes(tiles: DataFrame, side: int) -> DataFrame:
    """image_id, label, area and box (ends included) of every region of label tiles; one row a tile and label is shuffled."""
    def run(rows):
        for place, (v,) in rows:
            h, w = grid._size(place, side)
            if v.size != h * w:
                continue
            at = np.flatnonzero(v)
            labels, inverse = np.unique(v[at].astype(np.int64), return_inverse=True)
            y, x = at // w + place[3], at % w + place[4]
            for k, label in enumerate(labels.tolist()):
                own = inverse == k
                yield *place, label, int(own.sum()), int(y[own].min()), int(x[own].min()), int(y[own].max()), int(x[own].max())

    box = [(c, T.IntegerType()) for c in ("y0", "x0", "y1", "x1")]
    parts = grid.mapped(tiles, run, grid._schema(tiles, ("label", T.LongType()), ("area", T.LongType()), *box), "img")
    low, high = [F.min(c).alias(c) for c in ("y0", "x0")], [F.max(c).alias(c) for c in ("y1", "x1")]
    return parts.groupBy(_ID, "label").agg(F.sum("area").alias("area"), *low, *high)


def region_tiles(tiles: DataFrame, boxes: DataFrame, side: int) -> DataFrame:
    """Every region as a picture of its own: whole tiles of 0 and 1; ``image_id`` is a text made of image and label."""
    first = lambda c: (F.floor(F.col(c) / side) * side).cast("int")
    spans = boxes.select(_ID, "label", *[first(c).alias(n) for c, n in zip(("y0", "x0", "y1", "x1"), ("a", "b", "c", "d"))])
    every = lambda a, b: F.explode(F.sequence(F.col(a), F.col(b), F.lit(side)))
    spans = spans.withColumn("ty", every("a", "c")).withColumn("tx", every("b", "d"))
    joined = spans.join(tiles.select(*PLACE, "img"), KEY)
    region = F.concat(F.col(_ID).cast("string"), F.lit(":"), F.col("label").cast("string"))
    picked = joined.select(region.alias(_ID), (F.col("c") - F.col("a") + side).alias("rows"), (F.col("d") - F.col("b") + side).alias("cols"), (F.col("ty") - F.col("a")).alias("ty"), (F.col("tx") - F.col("b")).alias("tx"), "label", F.least(F.lit(side), F.col("rows") - F.col("ty")).alias("h"), "img")

    def run(rows):
        for place, (label, h, v) in rows:
            mask = np.zeros((side, side))
            part = (v == label).reshape(h, -1)
            mask[: part.shape[0], : part.shape[1]] = part
            yield *place, np.array([side, side]), mask

    return grid.mapped(picked, run, grid._schema(picked, ("shape", INTS), ("img", DOUBLES)), "label", "h", "img")


def _borders(regions: DataFrame, side: int) -> DataFrame:
    """Perimeter, Crofton's perimeter and Euler number of binary pictures, by sums over windows."""
    wide = regions.withColumn("rows", F.col("rows") + 1).withColumn("cols", F.col("cols") + 1)  # quads at the last row and column
    pieces = grid.windows(wide, side, (2, 2), "constant")

    def run(groups):
        for group in groups:
            place = group[0][0]
            h, w = grid._size(place, side)
            p = np.zeros((h + 4, w + 4), bool)
            for _, (ys, xs, v) in group:
                p[ys[:, None], xs] = v.reshape(len(ys), len(xs)) != 0
            length = vision.perimeter_map(p[None])[0, 2:-2, 2:-2].sum()
            d, c, b, a = p[2:-2, 2:-2], p[2:-2, 1:-3], p[1:-3, 2:-2], p[1:-3, 1:-3]
            n = a.astype(int) + b + c + d
            quads = int((n == 1).sum()) - int((n == 3).sum()) - 2 * int(((n == 2) & (a == d)).sum())
            cross = int((c != d).sum() + (b != d).sum()) / 2 + int((a != d).sum() + (b != c).sum()) / 2 / math.sqrt(2)
            yield *place, float(length), math.pi / 4 * cross, quads

    found = grid.merged(pieces, run, grid._schema(regions, ("length", T.DoubleType()), ("crofton", T.DoubleType()), ("quads", T.LongType())), "ys", "xs", "img")
    return found.groupBy(_ID).agg(F.sum("length").alias("perimeter"), F.sum("crofton").alias("perimeter_crofton"), F.floor(F.sum("quads") / 4).cast("long").alias("euler_number"))


def _row_ends(hull: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, first and last pixel of each) whose centres lie in the hull."""
    y = np.arange(math.ceil(hull[:, 0].min() - 1e-9), math.floor(hull[:, 0].max() + 1e-9) + 1)
    low, high, ok = np.full(len(y), -np.inf), np.full(len(y), np.inf), np.ones(len(y), bool)
    for p, q in zip(hull, np.roll(hull, -1, 0)):
        up, over = q[0] - p[0], (q[1] - p[1]) * (y - p[0]) - 1e-9
        if up > 0:
            low = np.maximum(low, p[1] + over / up)
        elif up < 0:
            high = np.minimum(high, p[1] + over / up)
        else:
            ok &= over <= 0
    first, last = np.ceil(low), np.floor(high)
    ok &= first <= last
    return y[ok], first[ok], last[ok]


def hull_measures(points: np.ndarray) -> tuple[float, float]:
    """(pixels of the convex image, its greatest diameter) from the corners of a region's hull."""
    y, first, last = _row_ends(geometry.convex_hull(points))
    ends = np.concatenate([np.stack([y + dy, x + dx], 1) for dy, dx, x in ((-0.5, 0, first), (-0.5, 0, last), (0.5, 0, first), (0.5, 0, last), (0, -0.5, first), (0, 0.5, last))])
    h = geometry.convex_hull(ends)
    far = max(float(((h - p) ** 2).sum(1).max()) for p in h)
    return float((last - first + 1).sum()), math.sqrt(far)


def _hulls(regions: DataFrame, side: int) -> DataFrame:
    """Convex area and greatest diameter of binary pictures."""
    def corners(rows):
        for place, (v,) in rows:
            mask = v.reshape(side, side) != 0
            if mask.any():
                hull = geometry.convex_hull(geometry._half_points(mask)) + place[3:]
                yield *place, hull[:, 0], hull[:, 1]

    def together(group):
        return geometry.convex_hull(np.concatenate([np.stack(data, 1) for _, data in group]))

    def one_row(groups):
        for group in groups:
            hull = together(group)
            yield *group[0][0], hull[:, 0], hull[:, 1]

    def all_rows(groups):
        for group in groups:
            yield *group[0][0], *hull_measures(together(group))

    fields = [("hy", DOUBLES), ("hx", DOUBLES)]
    parts = grid.mapped(regions, corners, grid._schema(regions, *fields), "img")
    rows = grid.merged(parts, one_row, grid._schema(regions, *fields), "hy", "hx", keys=[_ID, "ty"])
    return grid.merged(rows, all_rows, grid._schema(regions, ("convex_area", T.DoubleType()), ("feret_diameter_max", T.DoubleType())), "hy", "hx", keys=[_ID]).select(_ID, "convex_area", "feret_diameter_max")


def _half_rows(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest x of the side middles of rows of pixels, at every half row from -0.5 on; inf and -inf where there are none."""
    n, h = first.shape
    low, high = np.full((n, 2 * h + 1), np.inf), np.full((n, 2 * h + 1), -np.inf)
    low[:, 0:-1:2], high[:, 0:-1:2] = first, last
    low[:, 2::2], high[:, 2::2] = np.minimum(low[:, 2::2], first), np.maximum(high[:, 2::2], last)
    low[:, 1::2], high[:, 1::2] = first - 0.5, last + 0.5
    return low, high


def _envelope(low: np.ndarray) -> np.ndarray:
    """First pixel of each row whose centre isn't left of the hull, from the least x at every half row."""
    out = low.copy()
    for i in range(low.shape[1]):
        for j in range(i + 2, low.shape[1]):
            at = np.arange(i + 1 + i % 2, j, 2)  # whole rows
            part = (at - i) / (j - i)
            out[:, at] = np.minimum(out[:, at], low[:, i, None] * (1 - part) + low[:, j, None] * part)
    return np.ceil(out[:, 1::2] - 1e-9)


def stack_hulls(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pixels of the convex image, its greatest diameter) of each of a stack of masks of few rows."""
    w = masks.shape[2]
    any_ = masks.any(2)
    first, last = np.where(any_, masks.argmax(2), np.inf), np.where(any_, w - 1 - masks[:, :, ::-1].argmax(2), -np.inf)
    low, high = _half_rows(first, last)
    first, last = _envelope(low), -_envelope(-high)
    ok = first <= last
    first, last = np.where(ok, first, np.inf), np.where(ok, last, -np.inf)
    low, high = _half_rows(first, last)
    far = np.zeros(len(masks))
    for d in range(low.shape[1]):
        across = np.maximum(high[:, d:] - low[:, : low.shape[1] - d], high[:, : low.shape[1] - d] - low[:, d:])
        far = np.maximum(far, np.where(np.isfinite(across), across**2 + d * d / 4, 0).max(1))
    return np.where(ok, np.where(ok, last, 0) - np.where(ok, first, 0) + 1, 0).sum(1), np.sqrt(far)


def stack_measures(masks: np.ndarray) -> tuple[np.ndarray, ...]:
    """What MEASURES names after area, for each of a stack of masks with an empty frame."""
    if masks.shape[1] - 2 <= LOW:
        convex, far = stack_hulls(masks)
    else:
        ends = masks & ((np.cumsum(masks, 2) == 1) | (np.cumsum(masks[:, :, ::-1], 2)[:, :, ::-1] == 1))
        convex, far = np.array([hull_measures(geometry.convex_hull(geometry._half_points(m))) for m in ends]).T
    filled = morphology.binary_fill_holes(masks, np.ones((3, 3), bool)).sum((1, 2))
    return filled, convex, masks.sum((1, 2)) / convex, vision.perimeter(masks), vision.perimeter_crofton(masks), vision.euler_number(masks), far


def _regions(image: np.ndarray, label: np.ndarray, y: np.ndarray, x: np.ndarray):
    """(image, values of MEASURES) of all regions of many images' pixels, as arrays."""
    order = np.lexsort((label, image))
    image, label, y, x = image[order], label[order], y[order], x[order]
    new = np.r_[True, (image[1:] != image[:-1]) | (label[1:] != label[:-1])]
    at = np.flatnonzero(new)
    region, area = np.cumsum(new) - 1, np.diff(np.r_[at, len(y)])
    y, x = y - np.minimum.reduceat(y, at)[region], x - np.minimum.reduceat(x, at)[region]
    # Boxes of like size are measured together, the lower ones filled up to a power of two.
    high, wide = (np.maximum.reduceat(c, at) + 1 for c in (y, x))
    up = lambda n: 1 << np.ceil(np.log2(n)).astype(np.int64)
    few = (high <= LOW) & (wide <= LOW)
    high, wide = np.where(few, up(high), high), np.where(few, up(wide), wide)
    found = [np.zeros(len(at), np.int64 if k == "long" else float) for k in list(MEASURES.values())[2:]]
    sizes, kind = np.unique(np.stack([high, wide], 1), axis=0, return_inverse=True)
    by_kind = np.argsort(kind.ravel(), kind="stable")
    ends = np.searchsorted(kind.ravel()[by_kind], np.arange(len(sizes) + 1))
    starts = np.r_[at, len(y)]
    for (h, w), i, j in zip(sizes.tolist(), ends, ends[1:]):
        step = max(1, STACK // 8 // ((h + 2) * (w + 2)))
        for a in range(i, j, step):
            own = by_kind[a : min(a + step, j)]
            size = area[own]
            pixel = np.repeat(starts[own] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            masks = np.zeros((len(own), h + 2, w + 2), bool)
            masks[np.repeat(np.arange(len(own)), size), y[pixel] + 1, x[pixel] + 1] = True
            for column, values in zip(found, stack_measures(masks)):
                column[own] = values
    return image[at], [label[at], area, *found]


def _gathered(tiles: DataFrame, side: int) -> DataFrame:
    """Region shapes of images that fit a task, from label tiles; one shuffle, of the tiles."""
    ship(tiles.sparkSession)
    rows = tiles.where(f"{_ID} is not null").select(*PLACE, "img").repartition(_ID).sortWithinPartitions(_ID)
    schema = T.StructType([tiles.schema[_ID]])
    for name, kind in MEASURES.items():
        schema = schema.add(name, kind)

    def run(batches):
        held = None  # the image that may go on in the next batch
        for batch in itertools.chain(batches, [None]):
            last = batch is None
            if held is not None:
                batch = held if last else pa.concat_batches([held, batch])
            held = None
            if batch is None or not len(batch):
                continue
            ids = batch.column(0)
            new = np.r_[0, np.cumsum(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))]
            stop = len(batch) if last else int(np.searchsorted(new, new[-1]))
            if not last:
                held = batch.slice(stop)
            batch, new = batch.slice(0, stop), new[:stop]
            if not stop:
                continue
            height, width, ty, tx = (batch.column(k).to_numpy().astype(np.int64) for k in range(1, 5))
            v, o = _lists(batch.column(5))
            size = np.diff(o)
            h, w = np.minimum(side, height - ty), np.minimum(side, width - tx)
            row = np.repeat(np.arange(stop), size)
            ints = np.nan_to_num(v).astype(np.int64)
            at = np.flatnonzero((ints != 0) & (size == h * w)[row])
            if not len(at):
                continue
            row = row[at]
            inner = at - o[row]
            image, columns = _regions(new[row], ints[at], ty[row] + inner // w[row], tx[row] + inner % w[row])
            first = np.searchsorted(new, image)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), *[pa.array(c, pa.int64() if k == "long" else pa.float64()) for c, k in zip(columns, MEASURES.values())]], names=[_ID, *MEASURES])

    return rows.mapInArrow(run, schema)


def region_shapes(tiles: DataFrame, side: int, whole: int = WHOLE) -> DataFrame:
    """Per region of images kept as label tiles, what ``shapes.region_shapes`` gives for whole images; label 0 is background.

    Images of at most ``whole`` pixels are gathered, larger ones stay tiles.
    """
    tiles = grid.stage(tiles.select(*PLACE, "img"))
    size = F.col("rows").cast("long") * F.col("cols")
    out = _gathered(tiles.where(size <= whole), side)
    large = tiles.where(size > whole)
    return out if large.isEmpty() else out.unionByName(_spread(large, side))


def _spread(tiles: DataFrame, side: int) -> DataFrame:
    """Region shapes of images that are never gathered."""
    boxes = grid.stage(region_boxes(tiles, side))
    regions = grid.stage(region_tiles(tiles, boxes, side), KEY)
    filled = grid.fill_holes(regions, side, 2).groupBy(_ID).agg(F.sum(F.aggregate("img", F.lit(0.0), lambda a, v: a + v)).cast("long").alias("filled_area"))
    region = F.concat(F.col(_ID).cast("string"), F.lit(":"), F.col("label").cast("string"))
    out = boxes.select(F.col(_ID).alias("_image"), "label", "area", region.alias(_ID))
    for part in (filled, _hulls(regions, side), _borders(regions, side)):
        out = out.join(part, _ID)
    return out.select(F.col("_image").alias(_ID), "label", "area", "filled_area", "convex_area", (F.col("area") / F.col("convex_area")).alias("solidity"), "perimeter", "perimeter_crofton", "euler_number", "feret_diameter_max")
