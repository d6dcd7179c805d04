"""Regions beyond plain sums: moments and invariants (JVM), hulls, holes and borders (kernels)."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry, morphology, vision
from .regions import KEYS, moments
from .runtime import ship, stacks

ORDERS = [(i, j) for i in range(4) for j in range(4) if i + j <= 3]


def region_moments(px: DataFrame, weight: Column | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Centroid, central (mu), normalised (nu) moments and the seven invariants (hu) of every region.

    ``weight`` gives the weighted family; without it every pixel counts 1.
    One partial and final aggregation: central moments are expanded from raw
    ones about the image's origin.  A region whose weights sum to 0 has nulls.
    """
    g = moments(px, 3, keys, weight)
    raw = {(i, j): F.col(f"m_{i}_{j}") for i, j in ORDERS}
    mass = F.when(raw[0, 0] != 0, raw[0, 0])
    g = g.withColumn("centroid_0", raw[1, 0] / mass).withColumn("centroid_1", raw[0, 1] / mass)
    cy, cx = -F.col("centroid_0"), -F.col("centroid_1")
    power = lambda b, e: F.lit(1.0) if e == 0 else power(b, e - 1) * b
    for p, q in ORDERS:
        terms = [comb(p, i) * comb(q, j) * power(cy, p - i) * power(cx, q - j) * raw[i, j] for i in range(p + 1) for j in range(q + 1)]
        g = g.withColumn(f"mu_{p}_{q}", F.lit(0.0) * mass if p + q == 1 else sum(terms[1:], terms[0]))
    nu = {(p, q): F.col(f"mu_{p}_{q}") / F.pow(mass, F.lit(1 + (p + q) / 2)) for p, q in ORDERS if p + q >= 2}
    g = g.select(*keys, "centroid_0", "centroid_1", *[f"m_{i}_{j}" for i, j in ORDERS], *[f"mu_{i}_{j}" for i, j in ORDERS], *[c.alias(f"nu_{i}_{j}") for (i, j), c in nu.items()])
    n = {k: F.col(f"nu_{k[0]}_{k[1]}") for k in nu}
    a, b = n[3, 0] + n[1, 2], n[2, 1] + n[0, 3]
    c, d = n[3, 0] - 3 * n[1, 2], 3 * n[2, 1] - n[0, 3]
    e, f = n[2, 0] - n[0, 2], n[1, 1]
    x, y = a * a - 3 * b * b, 3 * a * a - b * b
    hu = [n[2, 0] + n[0, 2], e * e + 4 * f * f, c * c + d * d, a * a + b * b, c * a * x + d * b * y, e * (a * a - b * b) + 4 * f * a * b, d * a * x - c * b * y]
    return g.select("*", *[v.alias(f"hu_{k}") for k, v in enumerate(hu)])


def region_shapes(labels: DataFrame, keep: list[str] = ["image_id"]) -> DataFrame:
    """Per region of a label image (shape, img): filled and convex area, solidity, perimeters, Euler number, diameter.

    Each region is cut out by its box, so work follows the boxes; no shuffle.
    Label 0 is background.  Null images, and images that don't fill their shape, have no regions.
    """
    ship(labels.sparkSession)
    names = "label area filled_area convex_area solidity perimeter perimeter_crofton euler_number feret_diameter_max".split()
    picked = labels.select(*keep, F.col("shape").cast("array<int>"), F.col("img").cast("array<double>"))
    kinds = ["long", "long", "long", *["double"] * 4, "long", "double"]
    added = labels.sparkSession.createDataFrame([], ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).schema
    schema = picked.select(*keep).schema
    for field in added:
        schema = schema.add(field)

    def measure(img: np.ndarray):
        ints = img.astype(np.int64)
        at = np.nonzero(ints)
        lab = ints[at]
        order = np.argsort(lab, kind="stable")
        known, first = np.unique(lab[order], return_index=True)
        for label, own in zip(known.tolist(), np.split(order, first[1:]) if len(known) else []):
            y, x = at[0][own], at[1][own]
            mask = np.zeros((int(y.max() - y.min()) + 3, int(x.max() - x.min()) + 3), bool)
            mask[y - y.min() + 1, x - x.min() + 1] = True
            one, hull = mask[None], geometry.convex_area(mask)
            filled = morphology.binary_fill_holes(one, np.ones((3, 3), bool))
            yield label, len(own), int(filled.sum()), hull, len(own) / hull, float(vision.perimeter(one)[0]), float(vision.perimeter_crofton(one)[0]), int(vision.euler_number(one)[0]), geometry.feret_diameter_max(mask)

    def run(batches):
        for batch in batches:
            rows, who = [], []
            for cut, stack in stacks(batch.column("shape"), batch.column("img")):
                for k, img in enumerate(stack if stack is not None else []):
                    found = list(measure(img))
                    rows += found
                    who += [cut.start + k] * len(found)
            index = pa.array(who, pa.int64())
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(index) for c in keep], *[pa.array(v, pa.int64() if t == "long" else pa.float64()) for v, t in zip(columns, kinds)]], names=[*keep, *names])

    return picked.mapInArrow(run, schema)


def filled_images(labels: DataFrame, keep: list[str] = ["image_id"]) -> DataFrame:
    """One row per pixel of every region's box (y and x in the box): ``filled`` if it is in the region or in a hole of it, ``convex`` if in its convex image.

    Takes label images (shape, img), as ``region_shapes`` does.
    """
    ship(labels.sparkSession)
    picked = labels.select(*keep, F.col("shape").cast("array<int>"), F.col("img").cast("array<double>"))
    schema = picked.select(*keep).schema.add("label", T.LongType()).add("width", T.IntegerType()).add("filled", T.ArrayType(T.BooleanType())).add("convex", T.ArrayType(T.BooleanType()))

    def run(batches):
        for batch in batches:
            who, rows = [], []
            for cut, stack in stacks(batch.column("shape"), batch.column("img")):
                for k, img in enumerate(stack if stack is not None else []):
                    for label in np.unique(img[img != 0]).tolist():
                        y, x = np.nonzero(img == label)
                        mask = (img == label)[None, y.min() : y.max() + 1, x.min() : x.max() + 1]
                        filled = morphology.binary_fill_holes(np.pad(mask, ((0, 0), (1, 1), (1, 1))), np.ones((3, 3), bool))[0, 1:-1, 1:-1]
                        rows.append((int(label), filled.shape[1], filled.ravel().tolist(), geometry.convex_image(mask[0]).ravel().tolist()))
                        who.append(cut.start + k)
            columns = list(zip(*rows)) or [[], [], [], []]
            index = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(index) for c in keep], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.list_(pa.bool_())) for c in columns[2:]]], names=[*keep, "label", "width", "filled", "convex"])

    one = picked.mapInArrow(run, schema).select(*keep, "label", "width", F.posexplode(F.arrays_zip("filled", "convex")).alias("_p", "_z"))
    return one.select(*keep, "label", F.floor(F.col("_p") / F.col("width")).cast("int").alias("y"), (F.col("_p") % F.col("width")).cast("int").alias("x"), "_z.filled", "_z.convex")
