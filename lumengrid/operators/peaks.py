"""Points kept at a distance from each other, and peaks of images kept as tiles.

The rule is greedy: in order of strength a point stays unless one that stays
lies nearer than the spacing.  It is settled in passes over blocks of points
and their surroundings: a block's task finds out what holds whatever goes on
outside, and leaves the rest to the next pass, which is told what stays around
it.  Blocks too full for a task are settled in rounds instead.  Points fall into
cells so small that any two of one cell are too near to both stay; the strongest
of a cell stays if it also beats the strongest of every cell around it, and then
rejects all points near it.  A round joins cells with the few cells around
them, never points with points, so crowded places cost no more than others.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import filters
from . import grid
from .runtime import ship
from .tiles import tile_pixels

#: Points of a block and around it that one task settles, at most.
BLOCK = 1 << 15
#: Numbers that Python computes with as the JVM does.
PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _distance_to(w, p_norm: float):
    dy, dx = F.abs(F.col("y") - w["ky"]).cast("double"), F.abs(F.col("x") - w["kx"]).cast("double")
    if math.isinf(p_norm):
        return F.greatest(dy, dx)
    if p_norm == 1:
        return dy + dx
    return F.sqrt(dy * dy + dx * dx) if p_norm == 2 else F.pow(F.pow(dy, F.lit(p_norm)) + F.pow(dx, F.lit(p_norm)), F.lit(1 / p_norm))


def _apart(dy: np.ndarray, dx: np.ndarray, p_norm: float) -> np.ndarray:
    dy, dx = np.abs(dy).astype(float), np.abs(dx).astype(float)
    if math.isinf(p_norm):
        return np.maximum(dy, dx)
    if p_norm == 1:
        return dy + dx
    return np.sqrt(dy * dy + dx * dx) if p_norm == 2 else (dy**p_norm + dx**p_norm) ** (1 / p_norm)


def settled(y, x, v, own, known, spacing: float, p_norm: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """Of the points of a block (``own``) and around it: which stay for certain, and which are open.

    ``known`` points stay.  What becomes of the others around isn't known here,
    unless a point that stays rejects them; a point near a stronger one that is
    open is open itself.
    """
    order = np.lexsort((-x, -y, v))[::-1]
    y, x, known, mine = y[order], x[order], known[order], own[order]
    n = len(y)
    alive, clear, stays = np.ones(n, bool), np.ones(n, bool), np.zeros(n, bool)
    small = n <= 64
    if small:
        gaps = _apart(y[:, None] - y, x[:, None] - x, p_norm)
        near, same = gaps < spacing, gaps == 0
    for k in range(n):
        if not alive[k]:
            continue
        if small:
            close, double = near[k, k + 1 :], same[k, k + 1 :]
        else:
            gap = _apart(y[k + 1 :] - y[k], x[k + 1 :] - x[k], p_norm)
            close, double = gap < spacing, gap == 0
        if known[k] or (mine[k] and clear[k]):
            stays[k] = True
            alive[k + 1 :] &= ~close
        else:
            clear[k + 1 :] &= ~close
            alive[k + 1 :] &= ~double
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return (stays & mine & ~known)[back], (alive & ~stays & mine)[back]


def _block(c: str, spacing: float, by: float = 0.0):
    """A place's block along one axis; blocks lie around the origin, so that smaller images lie in one."""
    side = max(64.0, 8.0 * spacing)
    return F.floor((F.col(c) + side / 2 + by) / side)


def _block_pass(todo: DataFrame, known: DataFrame | None, keys: list[str], names: list[str], spacing: float, p_norm: float, most: int) -> DataFrame:
    """Points (names, _stays) that stay or are open still, after one look at every block."""
    ship(todo.sparkSession)
    key = [f"_k{i}" for i in range(len(keys))]
    block = lambda c, by=0.0: _block(c, spacing, by)
    rows = todo.select(*names, F.lit(False).alias("_known"))
    if known is not None:
        rows = rows.unionByName(known.select(*names, F.lit(True).alias("_known")))
    rows = rows.select(*names, "_known", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(n) for k, n in zip(keys, key)])
    for c in ("y", "x"):
        rows = rows.withColumn(f"_b{c}", F.explode(F.sequence(block(c, -spacing), block(c, spacing))))
    rows = rows.withColumn("_own", (F.col("_by") == block("y")) & (F.col("_bx") == block("x"))).where("not (_own and _known)")
    at = [*key, "_by", "_bx"]
    rows = rows.repartition(*at).sortWithinPartitions(*at)
    schema = T.StructType([rows.schema[c] for c in names]).add("_stays", "boolean")
    strength = names[-1]

    def run(batches):
        held, full = None, None  # the block that may go on in the next batch; the one that was too full
        for batch in itertools.chain(batches, [None]):
            last = batch is None
            if held is not None:
                batch = held if last else pa.concat_batches([held, batch])
            if batch is None or not len(batch):
                continue
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            new = np.zeros(len(batch) - 1, bool)
            for c in at:
                new |= pc.not_equal(column[c][1:], column[c][:-1]).to_numpy(zero_copy_only=False)
            ends = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
            y, x, v, own, known_ = (column[c].to_numpy(zero_copy_only=False) for c in ("y", "x", strength, "_own", "_known"))
            y, x, v = (c.astype(np.int64) if c.dtype.kind == "i" else c for c in (y, x, v))
            stays, open_ = np.zeros(len(batch), bool), np.zeros(len(batch), bool)
            held = None
            for i, j in zip(ends, ends[1:]):
                name = tuple(column[c][i].as_py() for c in at) if i == 0 or j == len(batch) else None
                if name is not None and name == full or j - i > most:
                    full = name
                    open_[i:j] = own[i:j] & ~known_[i:j]
                elif j == len(batch) and not last:
                    held = batch.slice(i)
                else:
                    stays[i:j], open_[i:j] = settled(y[i:j], x[i:j], v[i:j], own[i:j], known_[i:j], spacing, p_norm)
            pick = np.flatnonzero(stays | open_)
            yield pa.RecordBatch.from_arrays([*[column[c].take(pa.array(pick)) for c in names], pa.array(stays[pick])], names=[*names, "_stays"])

    return rows.mapInArrow(run, schema)


def ensure_spacing(points: DataFrame, spacing: float, p_norm: float = math.inf, keys: list[str] = ["image_id"], strength: str = "v", block: int = BLOCK) -> DataFrame:
    """The points (keys, y, x, strength) that stay: no two of one key nearer than ``spacing``; points at exactly that distance both stay.

    Stronger points go first; of equals the one with the smaller y, then x.
    Rows that repeat a place count once.  Null places or strengths are left
    out; null keys are a key of their own.  A task holds ``block`` points.
    """
    names = [*keys, "y", "x", strength]
    points = points.where(F.col("y").isNotNull() & F.col("x").isNotNull() & F.col(strength).isNotNull()).select(*names)
    once = lambda df: df.groupBy(*keys, "y", "x").agg(F.max(strength).alias(strength)).select(*names)
    if spacing <= 0:
        return once(points)
    kept, todo, won = [], points, None
    kinds = [type(points.schema[c].dataType) for c in ("y", "x", strength)]
    if all(k in PLAIN for k in kinds):
        todo = once(todo) if {T.FloatType, T.DoubleType} & set(kinds[:2]) else todo  # places that are nan count once too
        while True:
            done = grid.stage(_block_pass(todo, won, keys, names, spacing, p_norm, block))
            new, todo = done.where("_stays").select(*names), done.where("not _stays").select(*names)
            kept = _added(kept, new)
            if todo.isEmpty():
                return _all(kept)
            # What stays has been told to all of its own block.
            won = _all(kept).where(functools.reduce(lambda a, b: a | b, [_block(c, spacing, -spacing) != _block(c, spacing, spacing) for c in ("y", "x")]))
            if new.isEmpty():
                break
    # Two points of a half-open cell of this side are nearer than the spacing.
    side = spacing / (1 if math.isinf(p_norm) else 2 ** (1 / p_norm))
    reach = math.ceil(spacing / side)
    rank = F.struct(F.col(strength).alias("s"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))
    key = [f"_k{i}" for i in range(len(keys))]
    cell = [*key, "_cy", "_cx"]
    placed = lambda df, *columns: df.select(*columns, *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(n) for k, n in zip(keys, key)], F.floor(F.col("y") / side).alias("_cy"), F.floor(F.col("x") / side).alias("_cx"))
    todo = grid.stage(placed(once(todo), *names))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in itertools.product(range(-reach, reach + 1), repeat=2)]))
    if won is not None:
        won = placed(won, F.col("y").alias("ky"), F.col("x").alias("kx"))
    while not todo.isEmpty():
        if won is None:
            tops = todo.groupBy(*cell).agg(F.max(rank).alias("top"))
            seen = tops.select(*cell, "top", around.alias("_d")).select(*key, (F.col("_cy") + F.col("_d.a")).alias("_cy"), (F.col("_cx") + F.col("_d.b")).alias("_cx"), "top")
            best = seen.groupBy(*cell).agg(F.max("top").alias("best"))
            won = tops.join(best, cell).where("top = best").select(*cell, (-F.col("top.y")).alias("ky"), (-F.col("top.x")).alias("kx"))
            won = grid.stage(won)
        felt = won.withColumn("_d", around).select(*key, (F.col("_cy") + F.col("_d.a")).alias("_cy"), (F.col("_cx") + F.col("_d.b")).alias("_cx"), "ky", "kx")
        felt = felt.groupBy(*cell).agg(F.collect_list(F.struct("ky", "kx")).alias("_won"))  # at most one of each cell around
        near = F.exists("_won", lambda w: _distance_to(w, p_norm) < spacing)
        winner = F.exists("_won", lambda w: (w["ky"] == F.col("y")) & (w["kx"] == F.col("x")))
        judged = todo.join(felt, cell, "left").withColumn("_stays", F.coalesce(winner, F.lit(False))).withColumn("_goes", F.coalesce(near, F.lit(False)))
        judged = grid.stage(judged.drop("_won").where("_stays or not _goes"))
        kept = _added(kept, judged.where("_stays").select(*names))
        todo = judged.where("not _stays").drop("_stays", "_goes")
        won = None
    return _all(kept) if kept else once(points).limit(0)


def _all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _added(parts: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """One part more; many are written as one, so that plans stay small however many rounds there are."""
    parts = [*parts, new]
    return parts if len(parts) < 16 else [grid.stage(_all(parts))]


def peak_local_max(tiles: DataFrame, side: int, min_distance: int = 1, threshold_abs: float | None = None, threshold_rel: float | None = None, exclude_border: bool | int = True, num_peaks: int | None = None, footprint=None, p_norm: float = math.inf) -> DataFrame:
    """Peaks of whole images kept as tiles: image_id, y, x, v.

    One exchange of halos finds local maxima, sums by image give thresholds,
    and the spacing is settled over points.  An image of one value has none.
    """
    foot = np.ones((2 * min_distance + 1,) * 2, bool) if footprint is None else np.asarray(footprint, bool)
    size = [n // 2 for n in foot.shape]
    border = (min_distance if exclude_border else 0) if isinstance(exclude_border, bool) else exclude_border
    halo = max(*size, 1)
    wide = np.pad(foot, [(halo - s, halo - (n - 1 - s)) for s, n in zip(size, foot.shape)])

    def tops(x):
        if foot.size == 1:
            return x
        return np.where(x == filters.maximum_filter(x, footprint=wide, mode="constant"), x, np.nan)

    own = tiles.select("image_id", F.array_min("img").alias("lo"), F.array_max("img").alias("hi")).groupBy("image_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    low = F.col("lo") if threshold_abs is None else F.lit(float(threshold_abs))
    if threshold_rel is not None:
        low = F.greatest(low, F.col("hi") * float(threshold_rel))
    limits = own.where("lo < hi" if foot.size > 1 else "true").select("image_id", low.alias("low"))
    shape = tiles.where("ty = 0 and tx = 0").select("image_id", "rows", "cols")
    px = tile_pixels(grid.stencil(tiles, tops, halo, side, "constant")).where("not isnan(v)")
    px = px.join(limits, "image_id").where("v > low").join(shape, "image_id")
    px = px.where((F.col("y") >= border) & (F.col("x") >= border) & (F.col("y") < F.col("rows") - border) & (F.col("x") < F.col("cols") - border))
    out = ensure_spacing(px.select("image_id", "y", "x", "v"), min_distance, p_norm)
    if num_peaks is None:
        return out
    order = Window.partitionBy("image_id").orderBy(F.desc("v"), "y", "x")
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= num_peaks).drop("_n")
