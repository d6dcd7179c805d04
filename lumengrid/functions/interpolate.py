"""Gather kernels: splines, affine maps, warps and pyramids on stacks of images."""

from __future__ import annotations

import itertools
import math

import numpy as np

from . import filters as nf

# Poles of the B-spline prefilter by order.
POLES = {2: (math.sqrt(8) - 3,), 3: (math.sqrt(3) - 2,), 4: (math.sqrt(664 - math.sqrt(438976)) + math.sqrt(304) - 19, math.sqrt(664 + math.sqrt(438976)) - math.sqrt(304) - 19), 5: (math.sqrt(67.5 - math.sqrt(4436.25)) + math.sqrt(26.25) - 6.5, math.sqrt(67.5 + math.sqrt(4436.25)) - math.sqrt(26.25) - 6.5)}
_PAD = {"nearest": 12, "constant": 12, "grid-constant": 12}


def spline_filter1d(x, order=3, axis=-1, mode="mirror"):
    """B-spline coefficients along an axis, by solving the interpolation system.

    The system matrix is banded and the same for every line, so one inverse per
    axis length serves the whole stack.
    """
    n = x.shape[axis]
    if order < 2 or n == 1:
        return np.asarray(x, float)
    reach = order // 2
    index = nf.boundary_index(n, reach, reach, mode if mode in ("reflect", "grid-mirror", "grid-wrap") else "mirror")
    taps = bspline(np.arange(-reach, reach + 1, dtype=float), order)
    a = np.zeros((n, n))
    for k, t in enumerate(taps):
        np.add.at(a, (np.arange(n), index[k : k + n]), t)
    moved = np.moveaxis(np.asarray(x, float), axis, -1)
    return np.moveaxis(np.linalg.solve(a, moved.reshape(-1, n).T).T.reshape(moved.shape), -1, axis)


def spline_filter(x, order=3, mode="mirror"):
    for axis in range(1, x.ndim):
        x = spline_filter1d(x, order, axis, mode)
    return x


def bspline(t, order):
    """Central B-spline of the order at t, by its truncated-power sum."""
    t = np.abs(np.asarray(t, float))
    out = np.zeros_like(t)
    for k in range(order + 2):
        base = np.maximum(0, (order + 1) / 2 - k - t)
        out += (-1) ** k * math.comb(order + 1, k) * (base**order if order else (base > 0))
    return out / math.factorial(order)


def _fold(c, n, mode):
    """Real coordinates to within the image (the boundary modes that have a period)."""
    if mode == "nearest":
        return np.clip(c, 0, n - 1)
    if mode == "mirror":
        return np.zeros_like(c) if n == 1 else (n - 1) - np.abs(np.mod(c, 2 * n - 2) - (n - 1))
    if mode in ("reflect", "grid-mirror"):
        return c
    if mode == "wrap":
        return np.where((c < 0) | (c > n - 1), np.mod(c, max(n - 1, 1)), c)
    return c


def axis_taps(c, n, order, mode, pad=0):
    """(weights, positions) of the ``order`` + 1 samples of an axis that each real coordinate draws on; -1 stands for the constant.

    ``pad`` samples were put in front of and behind the axis.
    """
    c = _fold(c, n, mode) + pad
    if order == 0:
        first, taps = np.floor(c + 0.5).astype(int), [np.ones(c.shape)]
    else:
        first = (np.floor(c) - order // 2 if order % 2 else np.floor(c + 0.5) - order // 2).astype(int)
        taps = [bspline(c - (first + j), order) for j in range(order + 1)]
    edge = {"constant": "nearest", "wrap": "mirror"}.get(mode, mode) if not pad else "nearest" if mode != "grid-constant" else "grid-constant"
    return taps, [nf.boundary_at(first + j, n + 2 * pad, edge) for j in range(len(taps))]


def map_coordinates(x, coords, order=3, mode="constant", cval=0.0, prefilter=True):
    """Values at real coordinates (axes first; the same for every image of the stack)."""
    coords = np.asarray(coords, float)
    shape, dims = x.shape[1:], coords.shape[1:]
    pad = 0
    if order > 1 and prefilter:
        if mode in _PAD:
            pad = _PAD[mode]
            for axis in range(1, x.ndim):
                x = nf.extend(x, axis, pad, pad, "nearest" if mode == "nearest" else "constant", cval)
        x = spline_filter(x, order, "mirror" if mode in ("mirror", "wrap", "constant", "nearest", "grid-constant") else mode)
    outside = np.zeros(dims, bool)
    parts = []
    for k, n in enumerate(shape):
        if mode == "constant":
            outside |= (coords[k] < 0) | (coords[k] > n - 1)
        parts.append(axis_taps(coords[k], n, order, mode, pad))
    out = np.zeros((x.shape[0], *dims))
    for combo in itertools.product(*[range(len(t)) for t, _ in parts]):
        weight, index, lost = 1.0, [], np.zeros(dims, bool)
        for (taps, at), j in zip(parts, combo):
            weight = weight * taps[j]
            index.append(np.maximum(at[j], 0))
            lost |= at[j] < 0
        value = x[(slice(None), *index)]
        out += weight * (np.where(lost, cval, value) if lost.any() else value)
    return np.where(outside, cval, out) if outside.any() else out


def affine_transform(x, matrix, offset=0.0, output_shape=None, order=3, mode="constant", cval=0.0):
    m = np.asarray(matrix, float)
    n = x.ndim - 1
    if m.shape == (n + 1, n + 1) or m.shape == (n, n + 1):
        m, offset = m[:n, :n], m[:n, n]
    m = np.diag(m) if m.ndim == 1 else m
    grid = np.indices(output_shape or x.shape[1:])
    coords = np.tensordot(m, grid, 1) + np.broadcast_to(offset, n).reshape(-1, *[1] * n)
    return map_coordinates(x, coords, order, mode, cval)


def shift(x, by, order=3, mode="constant", cval=0.0):
    by = np.broadcast_to(by, x.ndim - 1)
    return affine_transform(x, np.ones(x.ndim - 1), -by, None, order, mode, cval)


def zoom(x, factor, order=3, mode="constant", cval=0.0):
    factor = np.broadcast_to(factor, x.ndim - 1)
    shape = tuple(int(round(n * f)) for n, f in zip(x.shape[1:], factor))
    step = np.array([(a - 1) / (b - 1) if b > 1 else 1.0 for a, b in zip(x.shape[1:], shape)])
    return affine_transform(x, step, 0.0, shape, order, mode, cval)


def rotate(x, angle, reshape=True, order=3, mode="constant", cval=0.0):
    """Turns 2-D images in their plane, in degrees."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    m = np.array([[c, s], [-s, c]])
    size = np.array(x.shape[1:])
    if reshape:
        corners = np.array([[0, 0, size[0], size[0]], [0, size[1], 0, size[1]]])
        out = (np.ptp(m @ corners, axis=1) + 0.5).astype(int)
    else:
        out = size
    offset = (size - 1) / 2 - m @ ((out - 1) / 2)
    return affine_transform(x, m, offset, tuple(out.tolist()), order, mode, cval)


def warp(x, inverse_map, output_shape=None, order=1, mode="constant", cval=0.0):
    """Gathers by an inverse map of (x, y) rows: a 3x3 matrix or a callable."""
    rows, cols = output_shape or x.shape[1:]
    y, xx = np.mgrid[:rows, :cols].astype(float)
    points = np.stack([xx.ravel(), y.ravel()], 1)
    if callable(inverse_map):
        src = inverse_map(points)
    else:
        h = np.c_[points, np.ones(len(points))] @ np.asarray(inverse_map, float).T
        src = h[:, :2] / h[:, 2:]
    names = {"edge": "nearest", "symmetric": "reflect", "reflect": "mirror", "wrap": "grid-wrap"}
    return map_coordinates(x, src[:, ::-1].T.reshape(2, rows, cols), order, names.get(mode, mode), cval)


def warp_coords(coord_map, shape):
    rows, cols = shape[:2]
    y, x = np.mgrid[:rows, :cols].astype(float)
    return coord_map(np.stack([x.ravel(), y.ravel()], 1))[:, ::-1].T.reshape(2, rows, cols)


def resize(x, output_shape, order=1, mode="mirror", cval=0.0, anti_aliasing=None):
    """Samples at pixel centres; shrinking smooths first."""
    factor = np.array(x.shape[1:]) / np.array(output_shape, float)
    if anti_aliasing if anti_aliasing is not None else (factor > 1).any():
        x = nf.gaussian_filter(x, [max(0.0, (f - 1) / 2) for f in factor], 0, mode, cval)
    return affine_transform(x, factor, factor / 2 - 0.5, tuple(output_shape), order, mode, cval)


def rescale(x, scale, **kw):
    scale = np.broadcast_to(scale, x.ndim - 1)
    return resize(x, tuple(int(round(n * s)) for n, s in zip(x.shape[1:], scale)), **kw)


def downscale_local_mean(x, factors):
    pad = [(0, 0)] + [(0, -n % f) for n, f in zip(x.shape[1:], factors)]
    p = np.pad(x, pad)
    for axis, f in enumerate(factors, 1):
        p = np.add.reduceat(p, np.arange(0, p.shape[axis], f), axis) / f
    return p


def swirl(x, center=None, strength=1.0, radius=100.0, rotation=0.0, order=1):
    cx, cy = center if center is not None else (np.array(x.shape[2:0:-1]) / 2 - 0.5)

    def back(p):
        dx, dy = p[:, 0] - cx, p[:, 1] - cy
        rho = np.hypot(dx, dy)
        theta = rotation + strength * np.exp(-rho / (radius / 5 * math.log(2))) + np.arctan2(dy, dx)
        return np.stack([cx + rho * np.cos(theta), cy + rho * np.sin(theta)], 1)

    return warp(x, back, order=order, mode="reflect")


def warp_polar(x, center=None, radius=None, scaling="linear", order=1):
    """Rows are angles (1 degree each), columns radii."""
    cy, cx = center if center is not None else (np.array(x.shape[1:]) / 2 - 0.5)
    radius = radius or math.hypot(x.shape[1] / 2, x.shape[2] / 2)
    width = math.ceil(radius)
    angle, r = np.mgrid[:360, :width].astype(float)
    r = np.exp(r * math.log(radius) / width) if scaling == "log" else r * radius / width
    a = np.radians(angle)
    return map_coordinates(x, np.stack([r * np.sin(a) + cy, r * np.cos(a) + cx]), order, "constant")


def pyramid_reduce(x, downscale=2, sigma=None, order=1):
    sigma = sigma or 2 * downscale / 6
    return resize(nf.gaussian_filter(x, sigma), tuple(math.ceil(n / downscale) for n in x.shape[1:]), order, "reflect", anti_aliasing=False)


def pyramid_expand(x, upscale=2, sigma=None, order=1):
    sigma = sigma or 2 * upscale / 6
    return nf.gaussian_filter(resize(x, tuple(math.ceil(n * upscale) for n in x.shape[1:]), order, "reflect", anti_aliasing=False), sigma)


def pyramid_gaussian(x, max_layer=-1, downscale=2):
    yield x
    while max_layer != 0 and x.shape[1:] != tuple(math.ceil(n / downscale) for n in x.shape[1:]):
        x = pyramid_reduce(x, downscale)
        yield x
        max_layer -= 1


def pyramid_laplacian(x, max_layer=-1, downscale=2):
    sigma = 2 * downscale / 6
    for level in pyramid_gaussian(x, max_layer, downscale):
        yield level - nf.gaussian_filter(level, sigma)


def profile_line(x, src, dst, linewidth=1, order=0, mode="reflect", cval=0.0, reduce=np.mean):
    """Samples along a line of pixels, one step a pixel, reduced across its width."""
    (r0, c0), (r1, c1) = np.asarray(src, float), np.asarray(dst, float)
    theta = math.atan2(r1 - r0, c1 - c0)
    n = math.ceil(math.hypot(r1 - r0, c1 - c0) + 1)
    rows, cols = np.linspace(r0, r1, n), np.linspace(c0, c1, n)
    off = np.linspace(-(linewidth - 1) / 2, (linewidth - 1) / 2, linewidth)
    at = np.stack([rows[:, None] + off * math.cos(theta), cols[:, None] - off * math.sin(theta)])
    got = map_coordinates(x, at, order, mode, cval)
    return got if reduce is None else reduce(got, -1)


def interpn(points, values, xi, method="linear", bounds_error=True, fill_value=np.nan):
    """Linear or nearest interpolation on a rectilinear grid; values may have further axes behind those of the grid."""
    xi = np.asarray(xi, float)
    where, part, bad = [], [], np.zeros(xi.shape[:-1], bool)
    for k, p in enumerate(points):
        p, q = np.asarray(p, float), xi[..., k]
        bad |= (q < p[0]) | (q > p[-1])
        i = np.clip(np.searchsorted(p, q) - 1, 0, len(p) - 2)
        where.append(i)
        part.append((q - p[i]) / (p[i + 1] - p[i]))
    if bounds_error and bad.any():
        raise ValueError("a requested point is out of bounds")
    values = np.asarray(values, float)
    wide = lambda v: v.reshape(*v.shape, *[1] * (values.ndim - len(points)))
    if method == "nearest":
        out = values[tuple(np.where(f <= 0.5, i, i + 1) for i, f in zip(where, part))]
    else:
        out = 0.0
        for edge in itertools.product((0, 1), repeat=len(points)):
            w = 1.0
            for e, f in zip(edge, part):
                w = w * (f if e else 1 - f)
            out = out + wide(w) * values[tuple(i + e for i, e in zip(where, edge))]
    return np.where(wide(bad), fill_value, out) if fill_value is not None and not bounds_error else out


class RegularGridInterpolator:
    """Values on a rectilinear grid as a function of points."""

    def __init__(self, points, values, method="linear", bounds_error=True, fill_value=np.nan):
        if any((np.diff(p) <= 0).any() for p in map(np.asarray, points)):
            raise ValueError("grid points must ascend strictly")
        self.grid, self.values, self.method = points, np.asarray(values, float), method
        self.bounds = {"bounds_error": bounds_error, "fill_value": fill_value}

    def __call__(self, xi, method=None):
        return interpn(self.grid, self.values, xi, method or self.method, **self.bounds)
