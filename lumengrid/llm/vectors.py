"""Arrow list and binary columns as numpy matrices, and sums of per-task arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import ship


def sound_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sizes, values) of the lists that are not null and hold finite numbers only; values lie end to end."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64())
    bad = values.is_null().to_numpy(zero_copy_only=False)
    flat = values.to_numpy(zero_copy_only=False)
    bad |= ~np.isfinite(flat)
    owner = np.repeat(np.arange(len(column)), size)
    broken = column.is_null().to_numpy(zero_copy_only=False).copy()
    broken[owner[bad]] = True
    rows = np.flatnonzero(~broken)
    return rows, size[rows], flat[~broken[owner]]


def floored(values: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * value) as int64, held between -limit and limit."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * values), -limit, limit).astype(np.int64)


def as_binary(matrix: np.ndarray, dtype: str) -> pa.Array:
    """One binary value per row."""
    raw = np.ascontiguousarray(matrix, dtype)
    width = raw.itemsize * raw.shape[1]
    offsets = np.arange(len(raw) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def from_binary(column: pa.Array, dtype: str, dims: int) -> np.ndarray:
    """The matrix that ``as_binary`` stored."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, dims), dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(dtype).reshape(len(column), dims)


def total(table: DataFrame, part, size: int) -> np.ndarray:
    """Sum over all rows of ``part(batch)``, an array of ``size`` doubles.

    A task adds up its own batches; the tasks' arrays are summed position by
    position in a shuffle, so the driver receives ``size`` numbers whatever the
    number of tasks.
    """
    ship(table.sparkSession)

    @K.tidy
    def run(batches):
        acc = np.zeros(size)
        for batch in batches:
            acc += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([acc.tolist()], pa.list_(pa.float64()))], names=["part"])

    parts = table.mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("at", "value"))
    out = np.zeros(size)
    for row in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[row["at"]] = row["value"]
    return out
