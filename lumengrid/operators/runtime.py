"""Running array kernels over a table of images, one Arrow batch at a time."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = "shape array<int>, img array<double>"
#: Values of one stack of images, at most (or one image).
STACK = 4 << 20


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did."""
    root = str(pathlib.Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def scratch(spark: SparkSession) -> str:
    """A new folder's name under ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = "file://" + tempfile.mkdtemp(prefix="lumengrid-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/lumengrid-engine/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False)
    size = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()
    return values, np.r_[0, np.cumsum(size)]


def stacks(shapes: pa.Array, *images: pa.Array):
    """(rows, stack): runs of neighbouring images of one shape as arrays; (rows, stack, stack...) for several columns.

    A row counts only if each of its images fills its shape; one that doesn't,
    or has no shape, comes by itself with None for every stack.
    """
    sv, so = _lists(shapes)
    parts = [_lists(i) for i in images]
    n, i = len(shapes), 0
    shape = lambda k: tuple(sv[so[k] : so[k + 1]].tolist())
    own = [shape(k) for k in range(n)]
    sizes = [int(np.prod(s)) if s else -1 for s in own]
    whole = np.array([z >= 0 for z in sizes], bool)
    for column, (_, io) in zip(images, parts):
        whole &= (np.diff(io) == np.array(sizes)) & ~column.is_null().to_numpy(zero_copy_only=False)
    while i < n:
        j = i + 1
        if not whole[i]:
            yield slice(i, j), *[None] * len(images)
        else:
            while j < n and whole[j] and own[j] == own[i] and (j - i + 1) * max(sizes[i], 1) <= STACK:
                j += 1
            yield slice(i, j), *[v[o[i] : o[j]].astype(float).reshape(j - i, *own[i]) for v, o in parts]
        i = j


def _gathered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with rows of one shape side by side, so that mixed shapes (tiles) still make large stacks."""
    sv, so = _lists(batch.column("shape"))
    shapes = [tuple(sv[so[k] : so[k + 1]].tolist()) for k in range(len(batch))]
    if sum(a != b for a, b in zip(shapes, shapes[1:])) < len(set(shapes)):
        return batch
    return batch.take(pa.array(sorted(range(len(shapes)), key=shapes.__getitem__), pa.int64()))


def _as_lists(rows: list) -> tuple[pa.Array, pa.Array]:
    shapes = pa.array([None if r is None else list(r.shape) for r in rows], pa.list_(pa.int32()))
    off = np.r_[0, np.cumsum([0 if r is None else r.size for r in rows])].astype(np.int32)
    flat = np.concatenate([np.zeros(0)] + [np.asarray(r, float).ravel() for r in rows if r is not None])
    mask = pa.array([r is None for r in rows])
    return shapes, pa.ListArray.from_arrays(pa.array(off), pa.array(flat), mask=mask)


def map_images(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """Replaces ``shape`` and ``img`` by the kernel's result, beside the columns of ``keep``.

    The kernel takes a stack (images first) and returns one.  A null image, or
    one whose values don't fill its shape, gives null.  No shuffle.
    """
    keep = [c for c in images.columns if c not in ("shape", "img")] if keep is None else keep
    ship(images.sparkSession)
    picked = images.select(*keep, F.col("shape").cast("array<int>"), F.col("img").cast("array<double>"))

    def run(batches):
        for batch in map(_gathered, batches):
            rows: list = [None] * len(batch)
            for cut, stack in stacks(batch.column("shape"), batch.column("img")):
                if stack is not None:
                    rows[cut] = list(kernel(stack))
            shapes, values = _as_lists(rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], shapes, values], names=[*keep, "shape", "img"])

    out = picked.drop("shape", "img").schema.add("shape", picked.schema["shape"].dataType).add("img", picked.schema["img"].dataType)  # may be null
    return picked.mapInArrow(run, out)


def map_pairs(pairs: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], keep: list[str]) -> DataFrame:
    """Like ``map_images`` for rows with two images of one shape, ``img`` and ``other``; null where either isn't whole."""
    ship(pairs.sparkSession)
    picked = pairs.select(*keep, F.col("shape").cast("array<int>"), F.col("img").cast("array<double>"), F.col("other").cast("array<double>"))
    out = picked.drop("shape", "img", "other").schema.add("shape", picked.schema["shape"].dataType).add("img", picked.schema["img"].dataType)  # may be null

    def run(batches):
        for batch in batches:
            rows: list = [None] * len(batch)
            for cut, a, b in stacks(batch.column("shape"), batch.column("img"), batch.column("other")):
                if a is not None:
                    rows[cut] = list(kernel(a, b))
            shapes, values = _as_lists(rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], shapes, values], names=[*keep, "shape", "img"])

    return picked.mapInArrow(run, out)


def pixels(images: DataFrame, value: str = "v", digits: int | None = 6) -> DataFrame:
    """One row per pixel of 2-D images: image_id, y, x and the value (rounded)."""
    one = images.select("image_id", F.element_at("shape", 2).alias("_w"), F.posexplode("img").alias("_p", value))
    v = F.col(value) if digits is None else F.round(value, digits) + F.lit(0.0)
    return one.select("image_id", F.floor(F.col("_p") / F.col("_w")).cast("int").alias("y"), (F.col("_p") % F.col("_w")).cast("int").alias("x"), v.alias(value))
