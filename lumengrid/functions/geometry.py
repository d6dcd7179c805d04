"""Geometric transforms with estimation, on the driver; they emit matrices or columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _normaliser(p):
    c = p.mean(0)
    s = math.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(1)).mean(), 1e-300)
    return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1.0]])


def _h(p):
    return np.c_[np.asarray(p, float), np.ones(len(p))]


class ProjectiveTransform:
    """A 3x3 homography of (x, y) points; ``a + b`` applies a first."""

    def __init__(self, matrix=None):
        self.params = np.eye(3) if matrix is None else np.asarray(matrix, float)

    def __call__(self, points):
        q = _h(points) @ self.params.T
        return q[:, :2] / q[:, 2:]

    def inverse(self, points):
        return type(self)(np.linalg.inv(self.params))(points)

    def __add__(self, other):
        return ProjectiveTransform(other.params @ self.params)

    def residuals(self, src, dst):
        return np.sqrt(((self(src) - dst) ** 2).sum(1))

    def columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        m = self.params.tolist()
        w = m[2][0] * x + m[2][1] * y + m[2][2]
        return (m[0][0] * x + m[0][1] * y + m[0][2]) / w, (m[1][0] * x + m[1][1] * y + m[1][2]) / w

    _free = (0, 1, 2, 3, 4, 5, 6, 7)

    def estimate(self, src, dst) -> bool:
        """Total least squares of the direct linear transform, points normalised."""
        src, dst = np.asarray(src, float), np.asarray(dst, float)
        ts, td = _normaliser(src), _normaliser(dst)
        s, d = _h(src) @ ts.T, _h(dst) @ td.T
        rows = []
        for (x, y, _), (u, v, _) in zip(s, d):
            rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
        cols = [*self._free, 8]
        _, sv, vt = np.linalg.svd(np.array(rows)[:, cols])
        if abs(vt[-1, -1]) < 1e-12:
            return False
        h = np.zeros(9)
        h[cols] = vt[-1] / vt[-1, -1]
        self.params = np.linalg.inv(td) @ h.reshape(3, 3) @ ts
        self.params /= self.params[2, 2]
        return True


class AffineTransform(ProjectiveTransform):
    _free = (0, 1, 2, 3, 4, 5)

    def __init__(self, matrix=None, scale=(1, 1), rotation=0.0, shear=0.0, translation=(0, 0)):
        sx, sy = np.broadcast_to(scale, 2)
        m = [[sx * math.cos(rotation), -sy * math.sin(rotation + shear), translation[0]], [sx * math.sin(rotation), sy * math.cos(rotation + shear), translation[1]], [0, 0, 1]]
        super().__init__(m if matrix is None else matrix)

    @property
    def scale(self):
        return np.hypot(*self.params[:2, :2])

    @property
    def rotation(self):
        return math.atan2(self.params[1, 0], self.params[0, 0])

    @property
    def shear(self):
        return math.atan2(-self.params[0, 1], self.params[1, 1]) - self.rotation

    @property
    def translation(self):
        return self.params[:2, 2]


class EuclideanTransform(AffineTransform):
    _scaled = False

    def estimate(self, src, dst) -> bool:
        """Least-squares rotation and translation (and scale), by singular vectors."""
        src, dst = np.asarray(src, float), np.asarray(dst, float)
        a, b = src - src.mean(0), dst - dst.mean(0)
        u, s, vt = np.linalg.svd(b.T @ a / len(a))
        d = np.array([1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
        r = u @ np.diag(d) @ vt
        k = (s * d).sum() / max((a**2).sum(1).mean(), 1e-300) if self._scaled else 1.0
        self.params = np.eye(3)
        self.params[:2, :2] = k * r
        self.params[:2, 2] = dst.mean(0) - k * r @ src.mean(0)
        return bool(np.isfinite(self.params).all())


class SimilarityTransform(EuclideanTransform):
    _scaled = True


class FundamentalMatrixTransform:
    """Epipolar geometry of two views by the eight-point method."""

    def __init__(self, matrix=None):
        self.params = np.eye(3) if matrix is None else np.asarray(matrix, float)

    def __call__(self, points):
        return _h(points) @ self.params.T

    def _linear(self, src, dst):
        ts, td = _normaliser(src), _normaliser(dst)
        s, d = _h(src) @ ts.T, _h(dst) @ td.T
        a = (d[:, :, None] * s[:, None, :]).reshape(len(s), 9)
        return np.linalg.svd(a)[2][-1].reshape(3, 3), ts, td

    def estimate(self, src, dst) -> bool:
        f, ts, td = self._linear(np.asarray(src, float), np.asarray(dst, float))
        u, s, vt = np.linalg.svd(f)
        self.params = td.T @ (u @ np.diag(self._rank(s)) @ vt) @ ts
        return True

    @staticmethod
    def _rank(s):
        return [s[0], s[1], 0]

    def residuals(self, src, dst):
        """Sampson distance."""
        s, d = _h(src), _h(dst)
        a, b = s @ self.params.T, d @ self.params
        return np.abs((d * a).sum(1)) / np.sqrt(a[:, 0] ** 2 + a[:, 1] ** 2 + b[:, 0] ** 2 + b[:, 1] ** 2)


class EssentialMatrixTransform(FundamentalMatrixTransform):
    @staticmethod
    def _rank(s):
        return [(s[0] + s[1]) / 2, (s[0] + s[1]) / 2, 0]


class PolynomialTransform:
    def __init__(self, params=None):
        self.params = np.array([[0, 1, 0], [0, 0, 1]], float) if params is None else np.asarray(params, float)

    @staticmethod
    def _terms(p, order):
        x, y = np.asarray(p, float).T
        return np.stack([x ** (n - i) * y**i for n in range(order + 1) for i in range(n + 1)], 1)

    def estimate(self, src, dst, order=2) -> bool:
        self.params = np.linalg.lstsq(self._terms(src, order), np.asarray(dst, float), rcond=None)[0].T
        return True

    def __call__(self, points):
        order = int((math.sqrt(8 * self.params.shape[1] + 1) - 3) / 2)
        return self._terms(points, order) @ self.params.T


TRANSFORMS = {"euclidean": EuclideanTransform, "similarity": SimilarityTransform, "affine": AffineTransform, "projective": ProjectiveTransform, "fundamental": FundamentalMatrixTransform, "essential": EssentialMatrixTransform, "polynomial": PolynomialTransform}


def estimate_transform(kind, src, dst, **kw):
    t = TRANSFORMS[kind]()
    t.estimate(src, dst, **kw)
    return t


def matrix_transform(points, matrix):
    return ProjectiveTransform(matrix)(points)


def approximate_polygon(points, tolerance):
    """Douglas-Peucker: points farther than the tolerance from the chord stay."""
    p = np.asarray(points, float)
    if tolerance <= 0:
        return p
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, q = p[b] - p[a], p[a + 1 : b] - p[a]
        n2 = (d**2).sum()
        t = np.clip(q @ d / n2, 0, 1) if n2 else np.zeros(len(q))
        dist = np.sqrt(((q - t[:, None] * d) ** 2).sum(1))
        k = int(dist.argmax())
        if dist[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return p[keep]


def integrate(integral: Column, width: int, r0, c0, r1, c1) -> Column:
    """Sum over a window (ends included) from a flattened integral image."""
    get = lambda r, c: F.when((r >= 0) & (c >= 0), F.get(integral, r * width + c)).otherwise(0.0)
    r0, c0, r1, c1 = (F.lit(v) for v in (r0, c0, r1, c1))
    return get(r1, c1) - get(r0 - 1, c1) - get(r1, c0 - 1) + get(r0 - 1, c0 - 1)


def convex_hull(points):
    """Corners of the hull, counter-clockwise, by the monotone chain."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def half(rows):
        out = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def _half_points(mask):
    """The middles of the sides of a mask's pixels."""
    return (np.argwhere(mask)[:, None, :] + np.array([[0.5, 0], [-0.5, 0], [0, 0.5], [0, -0.5]])).reshape(-1, 2)


def convex_image(mask):
    """The pixels whose centres lie in (or on) the hull of the pixels' side middles."""
    mask = np.asarray(mask, bool)
    if not mask.any():
        return mask
    h = convex_hull(_half_points(mask))
    y, x = np.indices(mask.shape)
    inside = np.ones(mask.shape, bool)
    for p, q in zip(h, np.roll(h, -1, 0)):
        inside &= (q[0] - p[0]) * (x - p[1]) - (q[1] - p[1]) * (y - p[0]) >= -1e-9
    return inside


def convex_area(mask) -> float:
    """Number of pixels of the convex image."""
    return float(convex_image(mask).sum())


def feret_diameter_max(mask) -> float:
    """Greatest distance between points of the convex image's outline, half a pixel from its centres."""
    if not np.any(mask):
        return 0.0
    h = convex_hull(_half_points(convex_image(mask)))
    return float(np.sqrt(((h[:, None] - h[None]) ** 2).sum(-1)).max())


def delaunay(points):
    """Triangles (indices) whose circumcircles hold no other point: insertion one by one."""
    p = np.asarray(points, float)
    c, r = p.mean(0), max(np.ptp(p, 0).max(), 1.0) * 1e3
    q = np.vstack([p, c + r * np.array([[-1, -1], [1, -1], [0, 1.5]])])
    tri = [(len(p), len(p) + 1, len(p) + 2)]
    for k in range(len(p)):
        bad = [t for t in tri if _in_circle(q, t, q[k])]
        edges: dict = {}
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                key = tuple(sorted(e))
                edges[key] = edges.get(key, 0) + 1
        tri = [t for t in tri if t not in bad] + [(*e, k) for e, n in edges.items() if n == 1]
    return [t for t in tri if max(t) < len(p)]


def _in_circle(q, t, at):
    a, b, c = q[list(t)] - at
    turn = (q[t[1]][0] - q[t[0]][0]) * (q[t[2]][1] - q[t[0]][1]) - (q[t[1]][1] - q[t[0]][1]) * (q[t[2]][0] - q[t[0]][0])
    d = np.linalg.det(np.array([[*v, v @ v] for v in (a, b, c)]))
    return d * np.sign(turn) > 1e-12


class PiecewiseAffineTransform:
    """An affine map on each Delaunay triangle of the source points; outside of all, -1."""

    def estimate(self, src, dst) -> bool:
        src, dst = np.asarray(src, float), np.asarray(dst, float)
        self.maps = []
        for t in delaunay(src):
            i = list(t)
            inv = np.linalg.inv(np.c_[src[i], np.ones(3)].T)
            self.maps.append((inv, dst[i].T))
        return bool(self.maps)

    def __call__(self, points):
        h = np.c_[np.asarray(points, float), np.ones(len(points))].T
        out = np.full((len(points), 2), -1.0)
        for inv, dst in self.maps:
            w = inv @ h
            inside = (w >= -1e-9).all(0)
            out[inside] = (dst @ w[:, inside]).T
        return out


TRANSFORMS["piecewise-affine"] = PiecewiseAffineTransform


# Even and odd masks of B-spline subdivision by degree, from rows of Pascal's triangle.
SUBDIVISION = {1: ([1, 1], [1, 1]), 2: ([3, 1], [1, 3]), 3: ([1, 6, 1], [0, 4, 4]), 4: ([5, 10, 1], [1, 10, 5]), 5: ([1, 15, 15, 1], [0, 6, 20, 6]), 6: ([7, 35, 21, 1], [1, 21, 35, 7]), 7: ([1, 28, 70, 28, 1], [0, 8, 56, 56, 8])}


def subdivide_polygon(points, degree=2, preserve_ends=False):
    """One round of B-spline subdivision; a closed polygon stays closed."""
    p = np.asarray(points, float)
    closed = bool((p[0] == p[-1]).all())
    p = p[:-1] if closed else p

    def filtered(mask):
        w = np.array(mask) / 2**degree
        if not closed:
            return np.stack([np.convolve(c, w, "valid") for c in p.T], 1)
        at = np.arange(len(p))[:, None] + (len(w) - 1) // 2 - np.arange(len(w))
        return np.einsum("ijk,j->ik", p[at % len(p)], w)

    even, odd = map(filtered, SUBDIVISION[degree])
    out = np.empty((len(even) + len(odd), 2))
    out[::2], out[1::2] = odd, even
    if closed:
        return np.vstack([out, out[:1]])
    return np.vstack([p[:1], out, p[-1:]]) if preserve_ends else out
