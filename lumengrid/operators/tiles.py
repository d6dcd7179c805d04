"""Images too large for one task: overlapping tiles, filtered apart, put together again.

A tile carries ``halo`` pixels of its neighbours (or of the boundary mode at
the image's edge), so a kernel that looks no farther gives the same result as
on the whole image.  The tile table is the storage form of such images: each
row is bounded, whatever the image.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import morphology
from ..functions.filters import extend
from .grid import arrays
from .runtime import cut, map_images, ship, stacks

SCHEMA = "image_id long, rows int, cols int, ty int, tx int, shape array<int>, img array<double>"


def split(images: DataFrame, side: int, halo: int, mode: str = "reflect") -> DataFrame:
    """2-D images to tiles of ``side`` pixels with a halo: one row a tile, at its place (ty, tx)."""
    ship(images.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column("image_id")
            for cut, stack in stacks(batch.column("shape"), batch.column("img")):
                if stack is None:
                    continue
                n, rows, cols = stack.shape
                p = extend(extend(stack, 1, halo, halo, mode), 2, halo, halo, mode)
                same = lambda v: pa.array(np.full(n, v, np.int32))
                for y in range(0, rows, side):
                    for x in range(0, cols, side):
                        part = p[:, y : min(y + side, rows) + 2 * halo, x : min(x + side, cols) + 2 * halo]
                        yield pa.RecordBatch.from_arrays([ids.slice(cut.start, n).cast(pa.int64()), same(rows), same(cols), same(y), same(x), arrays([np.array(part.shape[1:])] * n, pa.int32()), arrays(list(part), pa.float64())], names=["image_id", "rows", "cols", "ty", "tx", "shape", "img"])

    return images.select("image_id", F.col("shape").cast("array<int>"), F.col("img").cast("array<double>")).mapInArrow(run, SCHEMA)


def map_tiles(tiles: DataFrame, kernel, halo: int) -> DataFrame:
    """A kernel on every tile; the halo is cut off the result."""
    def inner(x: np.ndarray) -> np.ndarray:
        return kernel(x)[:, halo : x.shape[1] - halo, halo : x.shape[2] - halo]

    return map_images(tiles, inner)


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """Pixels of halo-free tiles at their place in the image: image_id, y, x, v."""
    one = tiles.select("image_id", "ty", "tx", F.element_at("shape", 2).alias("w"), F.posexplode("img").alias("p", "v"))
    return one.select("image_id", (F.col("ty") + F.floor(F.col("p") / F.col("w"))).cast("int").alias("y"), (F.col("tx") + F.col("p") % F.col("w")).cast("int").alias("x"), "v")


def join(tiles: DataFrame) -> DataFrame:
    """Halo-free tiles to whole images; only for images that fit one task."""
    def put(key, table):
        rows, cols = table["rows"][0].as_py(), table["cols"][0].as_py()
        out = np.zeros((rows, cols))
        for r in table.to_pylist():
            h, w = r["shape"]
            out[r["ty"] : r["ty"] + h, r["tx"] : r["tx"] + w] = np.reshape(r["img"], (h, w))
        return pa.table({"image_id": [key[0].as_py()], "shape": pa.array([[rows, cols]], pa.list_(pa.int32())), "img": [out.ravel().tolist()]})

    return tiles.groupBy("image_id").applyInArrow(put, "image_id long, shape array<int>, img array<double>")


#: Raster positions whose components are numbered in one task.
NUMBERED = 65_536


def _first_pixels(x: np.ndarray, connectivity: int) -> np.ndarray:
    """1 + the tile position of its component's first pixel, for every pixel; 0 is background."""
    lab = np.asarray(morphology.label(x != 0, morphology.generate_binary_structure(2, connectivity))).astype(np.int64)
    out = np.zeros(lab.shape)
    for k, one in enumerate(lab):
        known, first = np.unique(one, return_index=True)
        start = np.zeros(int(one.max()) + 1)
        start[known] = first + 1
        start[0] = 0
        out[k] = start[one]
    return out


def _least_reachable(edges: DataFrame) -> DataFrame:
    """(image_id, node, root) over undirected edges (image_id, a, b): least neighbours and pointer jumps until nothing changes."""
    both = edges.unionByName(edges.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    state = cut(both.groupBy("image_id", F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        told = both.join(state.select("image_id", F.col("node").alias("a"), "root"), ["image_id", "a"]).groupBy("image_id", F.col("b").alias("node")).agg(F.min("root").alias("told"))
        new = state.join(told, ["image_id", "node"]).select("image_id", "node", "root", F.least("root", "told").alias("next"))
        jump = state.select("image_id", F.col("node").alias("next"), F.col("root").alias("far"))
        new = cut(new.join(jump, ["image_id", "next"]).select("image_id", "node", "root", F.least("next", "far").alias("next")))
        done = new.where("next != root").isEmpty()
        state = new.select("image_id", "node", F.col("next").alias("root"))
        if done:
            return state


def label_tiles(tiles: DataFrame, connectivity: int = 1) -> DataFrame:
    """Connected components of images kept as halo-free tiles: image_id, y, x, label of every non-zero pixel.

    Labels count from 1 in raster order of first pixels, as on the whole image.
    Tiles are labelled apart; only border pixels meet in a join, and only the
    components they touch take part in the rounds.  A component's pixels are
    joined tile by tile, so none is too large for a task.
    """
    local = map_images(tiles, lambda x: _first_pixels(x, connectivity))
    w = F.element_at("shape", 2)
    one = local.select("image_id", "cols", "ty", "tx", w.alias("w"), F.element_at("shape", 1).alias("h"), F.posexplode("img").alias("p", "v")).where("v > 0")
    index = lambda p: (F.col("ty") + F.floor(p / F.col("w"))).cast("long") * F.col("cols") + F.col("tx") + (p % F.col("w")).cast("long")
    r, c = F.floor(F.col("p") / F.col("w")), F.col("p") % F.col("w")
    border = (r == 0) | (r == F.col("h") - 1) | (c == 0) | (c == F.col("w") - 1)
    px = cut(one.select("image_id", "ty", "tx", (F.col("ty") + r).cast("int").alias("y"), (F.col("tx") + c).cast("int").alias("x"), index(F.col("p")).alias("at"), index(F.col("v").cast("long") - 1).alias("node"), border.alias("border")))
    edge = px.where("border")
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * (connectivity > 1)
    near = edge.withColumn("d", F.explode(F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a, b in steps])))
    near = near.select("image_id", (F.col("y") + F.col("d.y")).alias("y"), (F.col("x") + F.col("d.x")).alias("x"), "ty", "tx", F.col("node").alias("a"))
    other = edge.select("image_id", "y", "x", F.col("ty").alias("oy"), F.col("tx").alias("ox"), F.col("node").alias("b"))
    edges = near.join(other, ["image_id", "y", "x"]).where("ty != oy or tx != ox").select("image_id", "a", "b").distinct()
    nodes = px.where("at = node").select("image_id", "node").join(_least_reachable(edges), ["image_id", "node"], "left")
    nodes = cut(nodes.withColumn("root", F.coalesce("root", "node")))
    roots = nodes.where("node = root").select("image_id", "root", F.floor(F.col("root") / NUMBERED).alias("bucket"))
    before = Window.partitionBy("image_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = roots.groupBy("image_id", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = Window.partitionBy("image_id", "bucket").orderBy("root")
    ranks = roots.withColumn("k", F.row_number().over(inner)).join(base, ["image_id", "bucket"]).select("image_id", "root", (F.col("k") + F.col("base")).cast("int").alias("label"))
    names = nodes.join(ranks, ["image_id", "root"]).select("image_id", "node", "label")
    return px.select("image_id", "y", "x", "node").join(names, ["image_id", "node"]).select("image_id", "y", "x", "label")
