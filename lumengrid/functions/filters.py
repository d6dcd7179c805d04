"""Neighbourhood kernels on stacks of images.

Every kernel takes an array whose first axis counts images and whose other
axes are the image's; one call filters a whole Arrow batch.
"""

from __future__ import annotations

import math

import numpy as np

MODES = ("reflect", "grid-mirror", "mirror", "nearest", "grid-wrap", "wrap", "constant", "grid-constant")


def boundary_at(i: np.ndarray, n: int, mode: str) -> np.ndarray:
    """Source index of any whole positions of an axis of length n; -1 stands for the constant."""
    if mode in ("reflect", "grid-mirror"):
        i = np.where(i < 0, -1 - i, i) % (2 * n)
        return np.minimum(i, 2 * n - 1 - i)
    if mode == "mirror":
        if n == 1:
            return np.zeros_like(i)
        i = np.abs(i) % (2 * n - 2)
        return np.minimum(i, 2 * n - 2 - i)
    if mode == "nearest":
        return np.clip(i, 0, n - 1)
    if mode in ("wrap", "grid-wrap"):
        return i % n
    if mode in ("constant", "grid-constant"):
        return np.where((i < 0) | (i >= n), -1, i)
    raise ValueError(f"unknown boundary mode {mode!r}")


def boundary_index(n: int, lo: int, hi: int, mode: str) -> np.ndarray:
    """Source index of positions -lo to n + hi - 1; -1 stands for the constant."""
    return boundary_at(np.arange(-lo, n + hi), n, mode)


def extend(x: np.ndarray, axis: int, lo: int, hi: int, mode: str = "reflect", cval: float = 0.0) -> np.ndarray:
    index = boundary_index(x.shape[axis], lo, hi, mode)
    out = np.take(x, np.maximum(index, 0), axis)
    if (index < 0).any():
        shape = [1] * x.ndim
        shape[axis] = len(index)
        out = np.where((index < 0).reshape(shape), cval, out)
    return out


def _reach(size: int, origin: int) -> tuple[int, int]:
    lo = size // 2 + origin
    if not 0 <= lo < size:
        raise ValueError("invalid origin")
    return lo, size - 1 - lo


def _window(x: np.ndarray, axis: int, start: int, n: int) -> np.ndarray:
    cut = [slice(None)] * x.ndim
    cut[axis] = slice(start, start + n)
    return x[tuple(cut)]


def correlate1d(x, weights, axis=-1, mode="reflect", cval=0.0, origin=0):
    axis %= x.ndim
    w, n = np.asarray(weights, float), x.shape[axis]
    p = extend(x, axis, *_reach(len(w), origin), mode, cval)
    out = np.zeros(x.shape, np.result_type(p, w))
    for k, c in enumerate(w):
        if c:
            out += c * _window(p, axis, k, n)
    return out


def convolve1d(x, weights, axis=-1, mode="reflect", cval=0.0, origin=0):
    w = np.asarray(weights, float)[::-1]
    return correlate1d(x, w, axis, mode, cval, -origin - (len(w) % 2 == 0))


def _axes(x, value):
    """One value per image axis: sizes, origins and boundary modes may be given for all axes or each."""
    return [value] * (x.ndim - 1) if np.isscalar(value) or value is None else list(value)


def _padded(x, shape, mode, cval, origin):
    p = x
    for axis, (size, o, way) in enumerate(zip(shape, _axes(x, origin), _axes(x, mode)), 1):
        p = extend(p, axis, *_reach(size, o), way, cval)
    return p


def _shifted(p, x, offset):
    return p[(slice(None), *(slice(o, o + n) for o, n in zip(offset, x.shape[1:])))]


def correlate(x, weights, mode="reflect", cval=0.0, origin=0):
    w = np.asarray(weights)
    p = _padded(x, w.shape, mode, cval, origin)
    out = np.zeros(x.shape, np.result_type(p, w, float))
    for at in np.argwhere(w != 0):
        out += w[tuple(at)] * _shifted(p, x, at)
    return out


def convolve(x, weights, mode="reflect", cval=0.0, origin=0):
    w = np.asarray(weights)
    origin = [-o - (s % 2 == 0) for o, s in zip(_axes(x, origin), w.shape)]
    return correlate(x, w[(slice(None, None, -1),) * w.ndim], mode, cval, origin)


def uniform_filter1d(x, size=3, axis=-1, mode="reflect", cval=0.0, origin=0):
    return correlate1d(x, np.full(size, 1 / size), axis, mode, cval, origin)


def uniform_filter(x, size=3, mode="reflect", cval=0.0, origin=0):
    """A moving sum per axis: cost doesn't follow the size."""
    out = np.asarray(x, float)
    for axis, (s, o, way) in enumerate(zip(_axes(x, size), _axes(x, origin), _axes(x, mode)), 1):
        if s > 1:
            p = extend(out, axis, *_reach(s, o), way, cval)
            if s <= 8:
                out = sum(_window(p, axis, k, x.shape[axis]) for k in range(s)) / s
            else:
                c = np.insert(np.cumsum(p, axis), 0, 0, axis)
                out = (_window(c, axis, s, x.shape[axis]) - _window(c, axis, 0, x.shape[axis])) / s
    return out


def gaussian_taps(sigma: float, order: int = 0, truncate: float = 4.0) -> np.ndarray:
    """Samples of a Gaussian (or its derivative), for correlation."""
    r = int(truncate * sigma + 0.5)
    t = np.arange(-r, r + 1, dtype=float)
    g = np.exp(-0.5 * (t / sigma) ** 2)
    g /= g.sum()
    h_prev, h = np.ones_like(t), t / sigma  # Hermite polynomials, probabilists'
    for k in range(1, order):
        h_prev, h = h, t / sigma * h - k * h_prev
    poly = h if order else h_prev
    return g * poly / sigma**order  # (-1)^order undone by correlation


def gaussian_filter1d(x, sigma=1.0, axis=-1, order=0, mode="reflect", cval=0.0, truncate=4.0):
    return correlate1d(x, gaussian_taps(sigma, order, truncate), axis, mode, cval)


def gaussian_filter(x, sigma=1.0, order=0, mode="reflect", cval=0.0, truncate=4.0):
    out = np.asarray(x, float)
    for axis, (s, o, way) in enumerate(zip(_axes(x, sigma), _axes(x, order), _axes(x, mode)), 1):
        if s > 1e-15:
            out = gaussian_filter1d(out, s, axis, o, way, cval, truncate)
    return out


def directional(x, axis, smooth, edge=(-1, 0, 1), mode="reflect", cval=0.0):
    """Derivative along one image axis, smoothing along the others."""
    modes = _axes(x, mode)
    out = correlate1d(x, edge, axis + 1, modes[axis], cval)
    for other in range(1, x.ndim):
        if other != axis + 1:
            out = correlate1d(out, smooth, other, modes[other - 1], cval)
    return out


def sobel(x, axis=-1, mode="reflect", cval=0.0):
    return directional(x, axis % (x.ndim - 1), (1, 2, 1), mode=mode, cval=cval)


def prewitt(x, axis=-1, mode="reflect", cval=0.0):
    return directional(x, axis % (x.ndim - 1), (1, 1, 1), mode=mode, cval=cval)


def generic_laplace(x, derivative2, mode="reflect", cval=0.0, **kw):
    return sum(derivative2(x, axis, mode, cval, **kw) for axis in range(1, x.ndim))


def laplace(x, mode="reflect", cval=0.0):
    return generic_laplace(x, lambda a, axis, m, c: correlate1d(a, (1, -2, 1), axis, m, c), mode, cval)


def _gaussian_derivative(x, sigma, axis, order, mode, cval):
    orders = [order if k == axis else 0 for k in range(1, x.ndim)]
    return gaussian_filter(x, sigma, orders, mode, cval)


def gaussian_laplace(x, sigma=1.0, mode="reflect", cval=0.0):
    return generic_laplace(x, lambda a, axis, m, c: _gaussian_derivative(a, sigma, axis, 2, m, c), mode, cval)


def generic_gradient_magnitude(x, derivative, mode="reflect", cval=0.0, **kw):
    return np.sqrt(sum(derivative(x, axis, mode, cval, **kw) ** 2 for axis in range(1, x.ndim)))


def gaussian_gradient_magnitude(x, sigma=1.0, mode="reflect", cval=0.0):
    return generic_gradient_magnitude(x, lambda a, axis, m, c: _gaussian_derivative(a, sigma, axis, 1, m, c), mode, cval)


# Order statistics ---------------------------------------------------------


def _footprint(x, size, footprint):
    return np.asarray(footprint, bool) if footprint is not None else np.ones(_axes(x, size), bool)


def _extreme(x, pick, size, footprint, mode, cval, origin, offsets=None):
    if footprint is None:
        out = x
        for axis, (s, o, way) in enumerate(zip(_axes(x, size), _axes(x, origin), _axes(x, mode)), 1):
            p = extend(out, axis, *_reach(s, o), way, cval)
            out = _window(p, axis, 0, x.shape[axis])
            for k in range(1, s):
                out = pick(out, _window(p, axis, k, x.shape[axis]))
        return out
    f = np.asarray(footprint, bool)
    p, out = _padded(x, f.shape, mode, cval, origin), None
    for at in np.argwhere(f):
        one = _shifted(p, x, at)
        if offsets is not None:
            one = one + offsets[tuple(at)]
        out = one if out is None else pick(out, one)
    return out


def minimum_filter(x, size=3, footprint=None, mode="reflect", cval=0.0, origin=0):
    return _extreme(x, np.minimum, size, footprint, mode, cval, origin)


def maximum_filter(x, size=3, footprint=None, mode="reflect", cval=0.0, origin=0):
    return _extreme(x, np.maximum, size, footprint, mode, cval, origin)


def _one_axis(x, size, axis):
    sizes = [1] * (x.ndim - 1)
    sizes[(axis % x.ndim) - 1] = size
    return sizes


def minimum_filter1d(x, size=3, axis=-1, mode="reflect", cval=0.0):
    return minimum_filter(x, _one_axis(x, size, axis), None, mode, cval)


def maximum_filter1d(x, size=3, axis=-1, mode="reflect", cval=0.0):
    return maximum_filter(x, _one_axis(x, size, axis), None, mode, cval)


def rank_filter(x, rank, size=3, footprint=None, mode="reflect", cval=0.0, origin=0):
    f = _footprint(x, size, footprint)
    n = int(f.sum())
    rank += n if rank < 0 else 0
    if not 0 <= rank < n:
        raise ValueError("rank not within filter footprint size")
    p = _padded(x, f.shape, mode, cval, origin)
    stack = np.stack([_shifted(p, x, at) for at in np.argwhere(f)])
    return np.partition(stack, rank, 0)[rank]


def median_filter(x, size=3, footprint=None, mode="reflect", cval=0.0, origin=0):
    return rank_filter(x, int(_footprint(x, size, footprint).sum()) // 2, size, footprint, mode, cval, origin)


def percentile_filter(x, percentile, size=3, footprint=None, mode="reflect", cval=0.0, origin=0):
    n = int(_footprint(x, size, footprint).sum())
    percentile += 100 if percentile < 0 else 0
    return rank_filter(x, n - 1 if percentile == 100 else int(n * percentile / 100), size, footprint, mode, cval, origin)


# Edge operators on intensity images: smoothing normalised, halves averaged ----


def _edge(x, axis, smooth, scale=0.5, edge=(-1, 0, 1)):
    s = np.asarray(smooth, float)
    return directional(x, axis, s / s.sum(), np.asarray(edge, float) * scale)


def edge_magnitude(x, smooth, scale=0.5, edge=(-1, 0, 1)):
    """Root mean square of the directional derivatives."""
    n = x.ndim - 1
    return np.sqrt(sum(_edge(x, k, smooth, scale, edge) ** 2 for k in range(n)) / n)


SOBEL, SCHARR, PREWITT = (1, 2, 1), (3, 10, 3), (1, 1, 1)
# Farid and Simoncelli, 5-tap prefilter and first derivative.
FARID_SMOOTH = (0.0376593171958126, 0.249153396177344, 0.426374573253687, 0.249153396177344, 0.0376593171958126)
FARID_EDGE = (-0.109603762960254, -0.276690988455557, 0.0, 0.276690988455557, 0.109603762960254)


def farid(x):
    return np.sqrt(sum(directional(x, k, FARID_SMOOTH, FARID_EDGE) ** 2 for k in range(x.ndim - 1)) / (x.ndim - 1))


def roberts(x):
    a, b = roberts_diagonals(x)
    return np.sqrt(a**2 + b**2) / math.sqrt(2)


def roberts_diagonals(x):
    return convolve(x, [[1, 0], [0, -1]]), convolve(x, [[0, 1], [-1, 0]])


def unsharp_mask(x, radius=1.0, amount=1.0, preserve_range=False):
    """The image plus what blurring takes away; held in [0, 1], or [-1, 1] for images with negative values, unless the range is preserved."""
    out = x + amount * (x - gaussian_filter(x, radius, mode="reflect"))
    if preserve_range:
        return out
    low = np.where((x < 0).reshape(len(x), -1).any(1), -1.0, 0.0).reshape(-1, *[1] * (x.ndim - 1))
    return np.clip(out, low, 1.0)


def difference_of_gaussians(x, low_sigma, high_sigma=None, mode="nearest", cval=0.0):
    high_sigma = 1.6 * low_sigma if high_sigma is None else high_sigma
    return gaussian_filter(x, low_sigma, 0, mode, cval) - gaussian_filter(x, high_sigma, 0, mode, cval)


def gabor_kernel(frequency, theta=0.0, bandwidth=1.0, sigma_x=None, sigma_y=None, n_stds=3, offset=0.0):
    scale = math.sqrt(math.log(2) / 2) / math.pi * (2**bandwidth + 1) / (2**bandwidth - 1) / frequency
    sx, sy = sigma_x or scale, sigma_y or scale
    c, s = math.cos(theta), math.sin(theta)
    ry = math.ceil(max(abs(n_stds * sy * c), abs(n_stds * sx * s), 1))
    rx = math.ceil(max(abs(n_stds * sx * c), abs(n_stds * sy * s), 1))
    y, x = np.mgrid[-ry : ry + 1, -rx : rx + 1]
    u, v = x * c + y * s, -x * s + y * c
    g = np.exp(-0.5 * (u**2 / sx**2 + v**2 / sy**2)) / (2 * math.pi * sx * sy)
    return g * np.exp(1j * (2 * math.pi * frequency * u + offset))


def gabor(x, frequency, **kw):
    k = gabor_kernel(frequency, **kw)
    return convolve(x, k.real), convolve(x, k.imag)


def gradient(x, axis=-1, spacing=1.0, edge_order=1):
    return np.gradient(x, spacing, axis=axis, edge_order=edge_order)


def local_mean_std(x, size):
    m = uniform_filter(x, size, "mirror")
    return m, np.sqrt(np.maximum(uniform_filter(x * x, size, "mirror") - m * m, 0))


def wiener_local(x, size=3, noise=None):
    """Adaptive noise removal from local mean and variance (zeros beyond the edge)."""
    m = uniform_filter(x, size, "constant")
    v = uniform_filter(x * x, size, "constant") - m * m
    axes = tuple(range(1, x.ndim))
    noise = v.mean(axes, keepdims=True) if noise is None else noise
    with np.errstate(divide="ignore", invalid="ignore"):
        out = m + (x - m) * (1 - noise / v)
    return np.where(v < noise, m, out)


def convolve_separable(x, weights, axes=None, mode="reflect", cval=0.0):
    """One 1-D filter over every axis, or one filter per axis."""
    axes = range(1, x.ndim) if axes is None else [a + 1 if a >= 0 else a for a in axes]
    each = weights if np.ndim(weights[0]) else [weights] * len(axes)
    for axis, w in zip(axes, each, strict=True):
        x = convolve1d(x, w, axis, mode, cval)
    return x


def smooth_with_function_and_mask(x, function, mask):
    """Smooths the pixels under the mask alone: what others would have added is divided out."""
    mask = np.broadcast_to(np.asarray(mask, bool), x.shape)
    share = function(mask.astype(float))
    return function(np.where(mask, x, 0.0)) / (share + np.finfo(float).eps)


def masked_edges(kernel, x, mask):
    """An edge filter's result where the whole 3x3 neighbourhood lies under the mask, else 0."""
    mask = np.broadcast_to(np.asarray(mask, bool), x.shape)
    sure = minimum_filter(mask.astype(float), 3, mode="constant", cval=0.0) > 0
    return np.where(sure, kernel(x), 0.0)


def sobel_h(x):
    return _edge(x, 0, SOBEL)


def sobel_v(x):
    return _edge(x, 1, SOBEL)


def scharr_h(x):
    return _edge(x, 0, SCHARR)


def scharr_v(x):
    return _edge(x, 1, SCHARR)


def prewitt_h(x):
    return _edge(x, 0, PREWITT)


def prewitt_v(x):
    return _edge(x, 1, PREWITT)


def farid_h(x):
    return directional(x, 0, FARID_SMOOTH, FARID_EDGE)


def farid_v(x):
    return directional(x, 1, FARID_SMOOTH, FARID_EDGE)


def roberts_pos_diag(x):
    return roberts_diagonals(x)[0]


def roberts_neg_diag(x):
    return roberts_diagonals(x)[1]
