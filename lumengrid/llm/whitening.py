"""Whitening by the leading eigenvectors of the covariance, without the covariance matrix.

Block Jacobi-Davidson: the driver holds the search space (dims x a few dozen
columns) and asks Spark for products of the centred covariance with a block of
vectors; one job multiplies all of them.  Rayleigh-Ritz in the search space
gives approximate pairs; for each that has not converged, MINRES solves the
correction equation (A - theta) t = -r, projected away from the locked and the
current vectors, all equations side by side, one job a step.  Pairs whose
residual is at double precision are locked in falling order.

Every vector is stored once, as whole numbers next to the mean's whole part,
so centring loses nothing and each job reads only what it multiplies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import ship, stage
from .vectors import as_binary, floored, from_binary, sound_lists, total

SCALE, SHIFT = 1024, 100_000
#: floor(1024 * c) is held between -LIMIT and LIMIT.
LIMIT = 1 << 40
#: MINRES steps of one correction, and columns of the search space before it restarts.
INNER, SPACE = 6, 96
#: Residual, against the largest eigenvalue, at which the pair after the wanted ones is known well enough.
GUARD = 1e-6
#: Corrections before a solve is given up.
OUTER = 300
EPS = float(np.finfo(float).eps)
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _orthonormal(x: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal columns spanning x outside ``against``; directions that vanish are dropped."""
    norm = np.linalg.norm(x, axis=0)
    x = x[:, norm > 0] / norm[norm > 0]
    out = against
    for column in x.T:
        for _ in range(3):
            column = column - out @ (out.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        else:
            out = np.c_[out, column]
    return out[:, against.shape[1] :]


def minres(product, rhs: np.ndarray, shift: np.ndarray, project, steps: int, tolerance: float) -> np.ndarray:
    """Approximate solutions of P (A - shift) P t = rhs, one column each, by ``steps`` products of the whole block."""
    size = np.linalg.norm(rhs, axis=0)
    live = size > 0
    beta = np.where(live, size, 1.0)
    v, before = rhs / beta, np.zeros_like(rhs)
    t, w, w_before = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    cos, sin, cos_before, sin_before = -np.ones_like(size), np.zeros_like(size), -np.ones_like(size), np.zeros_like(size)
    phi, last = size.copy(), np.zeros_like(size)
    for _ in range(steps):
        if not live.any():
            break
        ahead = project(product(v) - shift * v) - last * before
        alpha = (v * ahead).sum(0)
        ahead = ahead - alpha * v
        ahead -= v * (v * ahead).sum(0)
        nxt = np.linalg.norm(ahead, axis=0)
        # The column (last, alpha, nxt) of the tridiagonal matrix, turned by the two last rotations.
        far, mid = sin_before * last, -cos_before * last
        over, diagonal = cos * mid + sin * alpha, sin * mid - cos * alpha
        length = np.hypot(diagonal, nxt)
        live &= length > EPS * np.abs(shift)
        safe = np.where(length > 0, length, 1.0)
        cos_before, sin_before, cos, sin = cos, sin, diagonal / safe, nxt / safe
        w, w_before = (v - over * w - far * w_before) / safe, w
        t += np.where(live, cos * phi, 0.0) * w
        phi = phi * sin
        live &= (phi > tolerance * size) & (nxt > EPS * np.abs(shift))
        before, v, last = v, ahead / np.where(nxt > 0, nxt, 1.0), nxt
    return t


def jacobi_davidson(product, dims: int, want: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``want`` largest eigenpairs of a symmetric positive semidefinite operator, falling.

    ``product`` multiplies a block of columns.  Residuals end below
    max(64, dims) * eps * largest value.  One pair more is followed to
    ``GUARD``, and takes its place if it is larger than one of those locked.
    """
    want = min(want, dims)
    block = min(want + 2, dims)
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    space, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    fresh = rng.standard_normal((dims, block))
    for _ in range(OUTER):
        fresh = _orthonormal(fresh, np.c_[locked, space])
        if not fresh.shape[1] and space.shape[1] + locked.shape[1] < dims:
            fresh = _orthonormal(rng.standard_normal((dims, 1)), np.c_[locked, space])
        if fresh.shape[1]:
            space, image = np.c_[space, fresh], np.c_[image, product(fresh)]
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        scale = max([*np.abs(values), *np.abs(theta), 0.0])
        bar = max(64, dims) * EPS * scale
        away = image - locked @ (locked.T @ image)
        residual = away - theta * space
        size = np.linalg.norm(residual, axis=0)
        while len(theta) and size[0] <= bar and not _settled(values, theta, size, want, scale, bar):
            locked, values = np.c_[locked, space[:, :1]], np.r_[values, theta[0]]
            space, image, theta, residual, size = space[:, 1:], image[:, 1:], theta[1:], residual[:, 1:], size[1:]
        if locked.shape[1] == dims or _settled(values, theta, size, want, scale, bar):
            order = np.argsort(-values, kind="stable")[:want]
            return values[order], locked[:, order]
        if space.shape[1] + locked.shape[1] == dims:  # the whole space: only rounding is left
            space = _orthonormal(space, locked)
            image = product(space) if space.shape[1] else space
            fresh = np.zeros((dims, 0))
            continue
        if space.shape[1] > SPACE:
            space, image = space[:, : 2 * block], image[:, : 2 * block]
        take = min(max(want - len(values), 0) + 2, len(theta))
        current = np.c_[locked, space[:, :take]]
        project = lambda x: x - current @ (current.T @ x)
        open_ = np.flatnonzero(size[:take] > bar)
        if not len(open_):
            fresh = rng.standard_normal((dims, 1))
            continue
        fresh = minres(product, -project(residual[:, open_]), theta[open_], project, INNER, 0.01)
        fresh = np.c_[fresh, residual[:, open_]] if not np.linalg.norm(fresh) else fresh
    raise RuntimeError("the eigenpairs did not converge")


def _settled(values: np.ndarray, theta: np.ndarray, size: np.ndarray, want: int, scale: float, bar: float) -> bool:
    """Enough pairs are locked, and none outside them is larger."""
    if len(values) < want:
        return False
    least = np.sort(values)[::-1][want - 1]
    return not len(theta) or (size[0] <= GUARD * scale and theta[0] - least <= bar + size[0] * size[0] / max(scale, 1e-300))


class Moments:
    """The fit list: its length n, dims, exact sums, and the stored rows (vec_id, y = x - whole part of the mean)."""

    def __init__(self, embeddings: DataFrame):
        spark = embeddings.sparkSession
        ship(spark)
        vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

        @K.tidy
        def survey(batches):
            count, sums = {}, {}
            for batch in batches:
                _, size, flat = sound_lists(batch.column(0))
                owner = np.repeat(size, size)
                for d in np.unique(size).tolist():
                    x = floored(flat[owner == d].reshape(int((size == d).sum()), d), SCALE, LIMIT) + SHIFT
                    count[d] = count.get(d, 0) + len(x)
                    sums[d] = [a + b for a, b in zip(sums.get(d, [0] * d), x.sum(0).tolist())]
            yield pa.RecordBatch.from_pylist([{"dims": d, "sums": [str(count[d]), *map(str, sums[d])]} for d in count], pa.schema([("dims", pa.int32()), ("sums", pa.list_(pa.string()))]))

        found = stage(vectors.select("embedding").mapInArrow(survey, "dims int, sums array<string>"), "whiten_survey")
        sizes = found.groupBy("dims").agg(F.sum(F.col("sums")[0].cast("decimal(38,0)")).alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
        self.n, self.dims = (int(sizes[0]["n"]), sizes[0]["dims"]) if sizes else (0, 0)
        dims, self.sums = self.dims, [0] * self.dims
        if not self.n or not dims:
            return
        parts = found.where(F.col("dims") == dims).select(F.posexplode("sums").alias("at", "x")).where("at > 0")
        for row in parts.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
            self.sums[row["at"] - 1] = int(row["x"])
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = [s % self.n for s in self.sums]
        self.part = np.array([r / self.n for r in self.rest])
        whole = self.whole

        @K.tidy
        def store(batches):
            for batch in batches:
                rows, size, flat = sound_lists(batch.column(1))
                own = size == dims
                y = floored(flat[np.repeat(own, size)].reshape(-1, dims), SCALE, LIMIT) + SHIFT - whole
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[own])), as_binary(y, "<i8")], names=["vec_id", "y"])

        self.rows = stage(vectors.mapInArrow(store, "vec_id long, y binary"), "whiten_rows")

    def mean(self, part, size: int) -> np.ndarray:
        """Mean over the fit list of an array of ``size`` numbers summed by ``part(centred rows)``."""
        take = _Centring(self.dims, self.part)
        return total(self.rows.select("y"), lambda batch: part(take(batch)), size) / self.n

    def product(self, block: np.ndarray) -> np.ndarray:
        """Covariance times a block of columns."""
        return self.mean(lambda x: (x.T @ (x @ block)).ravel(), block.size).reshape(block.shape)


class _Centring:
    """Rows of a batch less the mean; holds nothing of the session, so tasks can carry it."""

    def __init__(self, dims: int, part: np.ndarray):
        self.dims, self.part = dims, part

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        return from_binary(batch.column(batch.schema.get_field_index("y")), "<i8", self.dims) - self.part


def whiten(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """Every sound vector's first ``components`` whitened coordinates, one row each, with exact deviations.

    Rows whose vector is null or holds null or non-finite entries are dropped.
    Where lengths differ, the commonest one (the longer of equals) is the
    table's and others are dropped.  Components of no variance (below
    max(64, dims) * eps of the trace) have no row, so a table of equal vectors,
    of one vector or of none gives no rows.  floor(1024 * c) is held between
    -2**40 and 2**40; deviations beyond 64 bits are null.  Null ids and
    repeated rows are rows like others; other columns are ignored.
    """
    spark = embeddings.sparkSession
    fit = Moments(embeddings)
    if not fit.n or not fit.dims:
        return spark.createDataFrame([], OUT)
    n, dims, take = fit.n, fit.dims, _Centring(fit.dims, fit.part)
    trace = float(fit.mean(lambda x: np.array([(x * x).sum()]), 1)[0])
    if not trace:
        return spark.createDataFrame([], OUT)
    values, vectors = jacobi_davidson(fit.product, dims, components)
    real = values > max(64, dims) * EPS * trace
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    turn, k = vectors / np.sqrt(values), len(values)
    offset = fit.mean(lambda x: (x @ turn).sum(0), k)

    def spread(x):
        w = x @ turn - offset
        return (w.T @ w).ravel()

    error = float(np.abs(fit.mean(spread, k * k).reshape(k, k) - np.eye(k)).max())
    explained, rest = values / trace, np.array(fit.rest, object)

    def deviation(y):
        most = n * (int(np.abs(y).max(initial=0)) + 1)
        if dims * most * most < 1 << 62:
            d = n * y - rest.astype(np.int64)
            return pa.array((d * d).sum(1))
        d = n * y.astype(object) - rest
        return pa.array([x if x < 1 << 63 else None for x in (d * d).sum(1).tolist()], pa.int64())

    @K.tidy
    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 10_000):
                part = batch.slice(a, 10_000)
                m = len(part)
                row = pa.array(np.repeat(np.arange(m), k))
                w = take(part) @ turn
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), deviation(from_binary(part.column(1), "<i8", dims)).take(row), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return fit.rows.mapInArrow(run, OUT)
