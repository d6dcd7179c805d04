"""Geometric transforms fitted per group of point pairs.

Points are rows (keys..., x, y, u, v).  A fit needs only sums over a group:
means and spreads first, then the products of the rows of its linear system.
Both are partial aggregations, so groups may be of any size; the small systems
are solved in tasks over one row per group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ship

PARAMS = [f"m_{i}_{j}" for i in range(3) for j in range(3)]


def _normalised(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds cx, cy, sx (source) and cu, cv, su (target) of the group: mean place, and the scale that brings the mean distance to sqrt 2."""
    mean = pairs.groupBy(*keys).agg(*[F.avg(c).alias(f"c{c}") for c in "xyuv"])
    near = pairs.join(mean, keys)
    far = lambda a, b: F.avg(F.hypot(F.col(a) - F.col(f"c{a}"), F.col(b) - F.col(f"c{b}")))
    spread = near.groupBy(*keys).agg(far("x", "y").alias("_s"), far("u", "v").alias("_d"))
    scale = lambda c: F.sqrt(F.lit(2.0)) / F.greatest(F.col(c), F.lit(1e-300))
    return near.join(spread.select(*keys, scale("_s").alias("sx"), scale("_d").alias("su")), keys)


def gram(pairs: DataFrame, keys: list[str], rows: list[list[Column]], keep: list[str]) -> DataFrame:
    """Sums of the products of a linear system's columns, as an array ``gram`` (upper triangle by rows), beside columns constant in a group."""
    n = len(rows[0])
    sums = [F.sum(sum((r[i] * r[j] for r in rows[1:]), rows[0][i] * rows[0][j])) for i in range(n) for j in range(i, n)]
    return pairs.groupBy(*keys).agg(F.array(*sums).alias("gram"), *[F.first(c).alias(c) for c in keep])


def _solve(table: DataFrame, keys: list[str], names: list[str], solve) -> DataFrame:
    """One row per group: ``solve(row) -> values`` for the named columns, or nulls."""
    ship(table.sparkSession)
    schema = table.select(*keys).schema
    for name in names:
        schema = schema.add(name, "double")

    def run(batches):
        for batch in batches:
            found = [solve(row) for row in batch.to_pylist()]
            columns = [pa.array([None if f is None else float(f[k]) for f in found], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *columns], names=[*keys, *names])

    return table.mapInArrow(run, schema)


def _square(values: list[float], n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = values
    return out + np.triu(out, 1).T


def _normaliser(row: dict, a: str, b: str, s: str) -> np.ndarray:
    k = row[s]
    return np.array([[k, 0, -k * row[f"c{a}"]], [0, k, -k * row[f"c{b}"]], [0, 0, 1.0]])


SCALES = ["cx", "cy", "cu", "cv", "sx", "su"]


def _unit(pairs: DataFrame, keys: list[str]):
    near = _normalised(pairs, keys)
    part = lambda c, s: (F.col(c) - F.col(f"c{c}")) * F.col(s)
    return near, part("x", "sx"), part("y", "sx"), part("u", "su"), part("v", "su")


def fit_projective(pairs: DataFrame, keys: list[str], affine: bool = False) -> DataFrame:
    """Keys and m_i_j of the homography (or affine map) of least algebraic error; m_2_2 is 1, or null where none exists."""
    near, x, y, u, v = _unit(pairs, keys)
    o, z = F.lit(1.0), F.lit(0.0)
    free = [0, 1, 2, 3, 4, 5, *([] if affine else [6, 7]), 8]
    rows = [[x, y, o, z, z, z, -u * x, -u * y, -u], [z, z, z, x, y, o, -v * x, -v * y, -v]]

    def solve(row):
        g = _square(row["gram"], len(free))
        h = np.zeros(9)
        h[free] = np.linalg.eigh(g)[1][:, 0]
        if abs(h[8]) < 1e-12:
            return None
        m = np.linalg.inv(_normaliser(row, "u", "v", "su")) @ h.reshape(3, 3) @ _normaliser(row, "x", "y", "sx")
        return (m / m[2, 2]).ravel()

    return _solve(gram(near, keys, [[r[k] for k in free] for r in rows], SCALES), keys, PARAMS, solve)


def fit_fundamental(pairs: DataFrame, keys: list[str], essential: bool = False) -> DataFrame:
    """Keys and m_i_j of the fundamental matrix by the eight-point method; ``essential`` evens its singular values."""
    near, x, y, u, v = _unit(pairs, keys)
    d, s = [u, v, F.lit(1.0)], [x, y, F.lit(1.0)]

    def solve(row):
        f = np.linalg.eigh(_square(row["gram"], 9))[1][:, 0].reshape(3, 3)
        a, w, b = np.linalg.svd(f)
        w = [(w[0] + w[1]) / 2, (w[0] + w[1]) / 2, 0] if essential else [w[0], w[1], 0]
        return (_normaliser(row, "u", "v", "su").T @ (a @ np.diag(w) @ b) @ _normaliser(row, "x", "y", "sx")).ravel()

    return _solve(gram(near, keys, [[p * q for p in d for q in s]], SCALES), keys, PARAMS, solve)


def fit_polynomial(pairs: DataFrame, keys: list[str], order: int = 2) -> DataFrame:
    """Keys and a_k, b_k: least-squares polynomials of u and v in the terms x**(n - i) * y**i."""
    power = lambda c, n: F.lit(1.0) if n == 0 else power(c, n - 1) * F.col(c)
    terms = [power("x", n - i) * power("y", i) for n in range(order + 1) for i in range(n + 1)]
    k = len(terms)

    def solve(row):
        g = _square(row["gram"], k + 2)
        scale = np.sqrt(np.maximum(np.diag(g)[:k], 1e-300))
        both = np.linalg.lstsq(g[:k, :k] / np.outer(scale, scale), g[:k, k:] / scale[:, None], rcond=None)[0] / scale[:, None]
        return both.T.ravel()

    return _solve(gram(pairs, keys, [[*terms, F.col("u").cast("double"), F.col("v").cast("double")]], []), keys, [f"{n}_{i}" for n in "ab" for i in range(k)], solve)


def fit_similarity(pairs: DataFrame, keys: list[str], scaled: bool = True) -> DataFrame:
    """Keys and m_i_j of the rotation and shift (and scale) of least squares, in closed form."""
    s = lambda a, b: F.sum(F.col(a) * F.col(b)) / F.count("*") - F.avg(a) * F.avg(b)
    g = pairs.groupBy(*keys).agg(*[F.avg(c).alias(f"c{c}") for c in "xyuv"], (s("x", "u") + s("y", "v")).alias("_c"), (s("x", "v") - s("y", "u")).alias("_s"), (s("x", "x") + s("y", "y")).alias("_n"))
    length = F.hypot("_c", "_s")
    k = F.when(F.col("_n") > 0, (length / F.col("_n")) if scaled else F.lit(1.0)) / F.when(length > 0, length)
    g = g.withColumn("_a", k * F.col("_c")).withColumn("_b", k * F.col("_s"))
    a, b, x, y, u, v = (F.col(c) for c in ("_a", "_b", "cx", "cy", "cu", "cv"))
    values = [a, -b, u - a * x + b * y, b, a, v - b * x - a * y, F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return g.select(*keys, *[c.alias(n) for c, n in zip(values, PARAMS)])


def properties(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Scale, rotation, shear and translation of fitted affine maps."""
    m = {(i, j): F.col(f"m_{i}_{j}") for i in range(3) for j in range(3)}
    turn = F.atan2(m[1, 0], m[0, 0])
    return fits.select(*keys, F.hypot(m[0, 0], m[1, 0]).alias("scale_x"), F.hypot(m[0, 1], m[1, 1]).alias("scale_y"), turn.alias("rotation"), (F.atan2(-m[0, 1], m[1, 1]) - turn).alias("shear"), m[0, 2].alias("translation_x"), m[1, 2].alias("translation_y"))


def residuals(pairs: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``residual``: distance of each pair's target from the fitted projective map."""
    both = pairs.join(fits, keys)
    m = [[F.col(f"m_{i}_{j}") for j in range(3)] for i in range(3)]
    p, q, w = (r[0] * F.col("x") + r[1] * F.col("y") + r[2] for r in m)
    return both.select(*pairs.columns, F.hypot(p / w - F.col("u"), q / w - F.col("v")).alias("residual"))


def epipolar_residuals(pairs: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``residual``: Sampson distance of each pair to the fitted epipolar geometry."""
    both = pairs.join(fits, keys)
    m = [[F.col(f"m_{i}_{j}") for j in range(3)] for i in range(3)]
    s, d = [F.col("x"), F.col("y"), F.lit(1.0)], [F.col("u"), F.col("v"), F.lit(1.0)]
    a = [sum((m[i][j] * s[j] for j in (1, 2)), m[i][0] * s[0]) for i in range(3)]
    b = [sum((m[i][j] * d[i] for i in (1, 2)), m[0][j] * d[0]) for j in range(3)]
    top = sum((d[i] * a[i] for i in (1, 2)), d[0] * a[0])
    return both.select(*pairs.columns, (F.abs(top) / F.sqrt(a[0] * a[0] + a[1] * a[1] + b[0] * b[0] + b[1] * b[1])).alias("residual"))
