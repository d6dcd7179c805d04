"""Convolution, FFT filters, resampling and analytic signals on stacks."""

from __future__ import annotations

import math

import numpy as np

from . import filters as nf


def _spatial(x):
    return tuple(range(1, x.ndim))


def _crop(full, shape, mode, kernel):
    if mode == "full":
        return full
    want = shape if mode == "same" else tuple(a - b + 1 for a, b in zip(shape, kernel))
    cut = [slice(None)]
    for have, n in zip(full.shape[1:], want):
        start = (have - n) // 2
        cut.append(slice(start, start + n))
    return full[tuple(cut)]


def fftconvolve(x, kernel, mode="full"):
    k = np.asarray(kernel)
    shape = tuple(a + b - 1 for a, b in zip(x.shape[1:], k.shape))
    axes = _spatial(x)
    if np.iscomplexobj(x) or np.iscomplexobj(k):
        full = np.fft.ifftn(np.fft.fftn(x, shape, axes) * np.fft.fftn(k, shape), axes=axes)
    else:
        full = np.fft.irfftn(np.fft.rfftn(x, shape, axes) * np.fft.rfftn(k, shape, tuple(range(k.ndim))), shape, axes)
    return _crop(full, x.shape[1:], mode, k.shape)


def convolve(x, kernel, mode="full", method="auto"):
    """Direct for small kernels, by FFT for others."""
    k = np.asarray(kernel)
    if method == "auto":
        method = choose_conv_method(x, k)
    if method == "fft":
        return fftconvolve(x, k, mode)
    shape = tuple(a + b - 1 for a, b in zip(x.shape[1:], k.shape))
    full = np.zeros((x.shape[0], *shape), np.result_type(x, k, float))
    for at in np.argwhere(k != 0):
        full[(slice(None), *(slice(o, o + n) for o, n in zip(at, x.shape[1:])))] += k[tuple(at)] * x
    return _crop(full, x.shape[1:], mode, k.shape)


def choose_conv_method(x, kernel) -> str:
    direct = np.count_nonzero(kernel) * np.prod(x.shape[1:], dtype=float)
    size = np.prod([a + b for a, b in zip(x.shape[1:], np.shape(kernel))], dtype=float)
    return "direct" if direct < 15 * size * math.log2(size + 2) else "fft"


def correlate(x, kernel, mode="full", method="auto"):
    k = np.asarray(kernel)
    return convolve(x, np.conj(k[(slice(None, None, -1),) * k.ndim]), mode, method)


def oaconvolve(x, kernel, mode="full", block=1024):
    """Overlap-add along the last axis."""
    k = np.asarray(kernel)
    n, m = x.shape[-1], k.shape[-1]
    out = np.zeros((x.shape[0], *[a + b - 1 for a, b in zip(x.shape[1:], k.shape)]))
    for s in range(0, n, block):
        part = fftconvolve(x[..., s : s + block], k, "full")
        out[..., s : s + part.shape[-1]] += part
    return _crop(out, x.shape[1:], mode, k.shape)


def convolve2d(x, kernel, mode="full", boundary="fill", fillvalue=0.0):
    k = np.asarray(kernel)
    if boundary == "fill" and fillvalue == 0:
        return convolve(x, k, mode, "direct")
    way = {"fill": "constant", "wrap": "grid-wrap", "symm": "reflect"}[boundary]
    for axis, n in enumerate(k.shape, 1):
        x = nf.extend(x, axis, n - 1, n - 1, way, fillvalue)
    full = convolve(x, k, "valid", "direct")
    return _crop(full, tuple(s - 2 * (n - 1) for s, n in zip(x.shape[1:], k.shape)), mode, k.shape)


def upfirdn(h, x, up=1, down=1, axis=-1):
    """Insert zeros, filter, keep every down-th sample; one phase of taps at a time."""
    h = np.asarray(h, float)
    x = np.moveaxis(x, axis, -1)
    n = x.shape[-1]
    length = ((n - 1) * up + len(h) - 1) // down + 1
    out = np.zeros((*x.shape[:-1], length), np.result_type(x, h))
    t = np.arange(length) * down
    for phase in range(up):
        sel = np.flatnonzero(t % up == phase)
        taps = h[phase::up]
        for j, c in enumerate(taps):
            i = t[sel] // up - j
            ok = (i >= 0) & (i < n)
            out[..., sel[ok]] += c * x[..., i[ok]]
    return np.moveaxis(out, -1, axis)


# Cosine coefficients of the named windows.
WINDOWS = {"boxcar": (1.0,), "hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08), "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411), "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168), "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368)}


def window(name, n, periodic=True):
    """A named window: cosine sums, kaiser (beta), gaussian (std), tukey (alpha), triang, bartlett."""
    kind, args = (name, ()) if isinstance(name, str) else (name[0], name[1:])
    m = n + 1 if periodic else n
    t = np.arange(m)
    if kind in WINDOWS:
        w = sum((-1) ** k * a * np.cos(2 * np.pi * k * t / max(m - 1, 1)) for k, a in enumerate(WINDOWS[kind])) + 0.0 * t
    elif kind == "kaiser":
        w = np.kaiser(m, args[0])
    elif kind == "gaussian":
        w = np.exp(-0.5 * ((t - (m - 1) / 2) / args[0]) ** 2)
    elif kind == "tukey":
        a = args[0] if args else 0.5
        edge = np.minimum(t, m - 1 - t) / max(a * (m - 1) / 2, 1e-300)
        w = np.where(edge < 1, 0.5 * (1 - np.cos(np.pi * edge)), 1.0)
    elif kind == "bartlett":
        w = np.bartlett(m)
    elif kind == "triang":
        h = (m + 1) // 2
        up = np.arange(1, h + 1) * 2 / (m + 1) if m % 2 else (2 * np.arange(1, h + 1) - 1) / m
        w = np.r_[up, up[::-1][m % 2 :]]
    else:
        raise ValueError(f"unknown window {kind!r}")
    return w[:n]


def window_nd(name, shape):
    """The separable or rotated window: 1-D in each axis, multiplied."""
    out = np.ones(())
    for n in shape:
        out = np.multiply.outer(out, window(name, n, False))
    return out


def firwin(taps, cutoff, win=("kaiser", 5.0)):
    """Low-pass FIR by windowed sinc, gain 1 at zero; cutoff in units of Nyquist."""
    t = np.arange(taps) - (taps - 1) / 2
    h = cutoff * np.sinc(cutoff * t) * window(win, taps, False)
    return h / h.sum()


def resample(x, num, axis=-1, win=None):
    """Fourier resampling: spectra cut or zero-padded, the shared Nyquist bin shared out."""
    n = x.shape[axis]
    x = np.moveaxis(x, axis, -1)
    spec = np.fft.fft(x)
    if win is not None:
        spec = spec * np.fft.ifftshift(window(win, n))
    out = np.zeros((*x.shape[:-1], num), complex)
    m = min(n, num)
    half = (m + 1) // 2
    out[..., :half] = spec[..., :half]
    if m - half:
        out[..., num - (m - half) :] = spec[..., n - (m - half) :]
    if m % 2 == 0:
        if num < n:
            out[..., m // 2] += spec[..., m // 2]
        elif n < num:
            out[..., num - m // 2] *= 0.5
            out[..., m // 2] = out[..., num - m // 2]
    y = np.fft.ifft(out) * (num / n)
    return np.moveaxis(y if np.iscomplexobj(x) else y.real, -1, axis)


def resample_poly(x, up, down, axis=-1, win=("kaiser", 5.0)):
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down == 1:
        return np.array(x, float)
    n = x.shape[axis]
    want = -(-n * up // down)
    half = 10 * max(up, down)
    h = firwin(2 * half + 1, 1 / max(up, down), win) * up
    pre = down - half % down
    keep = (half + pre) // down
    post = max(0, (want + keep - 1) * down + 1 - ((n - 1) * up + len(h) + pre))  # enough output to keep ``want`` samples
    y = upfirdn(np.r_[np.zeros(pre), h, np.zeros(post)], x, up, down, axis)
    cut = [slice(None)] * y.ndim
    cut[axis] = slice(keep, keep + want)
    return y[tuple(cut)]


def _one_sided(n):
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return h


def hilbert(x, axis=-1):
    x = np.moveaxis(x, axis, -1)
    return np.moveaxis(np.fft.ifft(np.fft.fft(x) * _one_sided(x.shape[-1])), -1, axis)


def envelope(x, axis=-1):
    return np.abs(hilbert(x, axis))


def hilbert2(x):
    h1, h2 = _one_sided(x.shape[1]), _one_sided(x.shape[2])
    return np.fft.ifft2(np.fft.fft2(x) * np.outer(h1, h2))


# Multipliers of a spectrum -----------------------------------------------------


def _by_axis(spec, make, n=-1):
    for axis in range(1, spec.ndim):
        m = spec.shape[axis]
        shape = [1] * spec.ndim
        shape[axis] = m
        real = n > 0 and axis == spec.ndim - 1
        f = np.arange(m) / n if real else np.fft.fftfreq(m)
        spec = spec * make(axis - 1, f).reshape(shape)
    return spec


def fourier_gaussian(spec, sigma, n=-1):
    s = np.broadcast_to(sigma, spec.ndim - 1)
    return _by_axis(spec, lambda k, f: np.exp(-2 * np.pi**2 * s[k] ** 2 * f**2), n)


def fourier_uniform(spec, size, n=-1):
    s = np.broadcast_to(size, spec.ndim - 1)
    return _by_axis(spec, lambda k, f: np.sinc(s[k] * f), n)


def fourier_shift(spec, by, n=-1):
    s = np.broadcast_to(by, spec.ndim - 1)
    return _by_axis(spec, lambda k, f: np.exp(-2j * np.pi * s[k] * f), n)


def _j1(x):
    """Bessel J1 by its integral: mean of cos(t - x sin t) over 0..pi."""
    t = (np.arange(400) + 0.5) * np.pi / 400
    return np.cos(t - np.multiply.outer(x, np.sin(t))).mean(-1)


def fourier_ellipsoid(spec, size, n=-1):
    s = np.broadcast_to(size, spec.ndim - 1)
    grids = []
    for axis, m in enumerate(spec.shape[1:]):
        f = np.arange(m) / n if n > 0 and axis == spec.ndim - 2 else np.fft.fftfreq(m)
        grids.append(np.pi * s[axis] * f)
    r = np.sqrt(sum(g**2 for g in np.meshgrid(*grids, indexing="ij")))
    safe = np.where(r == 0, 1, r)
    d = spec.ndim - 1
    form = {1: lambda: np.sin(safe) / safe, 2: lambda: 2 * _j1(safe) / safe, 3: lambda: 3 * (np.sin(safe) - safe * np.cos(safe)) / safe**3}[d]()
    return spec * np.where(r == 0, 1, form)


def through_fft(x, multiply):
    """A real stack through its spectrum and back."""
    axes = _spatial(x)
    return np.fft.ifftn(multiply(np.fft.fftn(x, axes=axes)), axes=axes).real


# Unitary transforms -------------------------------------------------------------


def ufftn(x, dim=None):
    axes = _spatial(x) if dim is None else tuple(range(x.ndim - dim, x.ndim))
    return np.fft.fftn(x, axes=axes, norm="ortho")


def uifftn(x, dim=None):
    axes = _spatial(x) if dim is None else tuple(range(x.ndim - dim, x.ndim))
    return np.fft.ifftn(x, axes=axes, norm="ortho")


def urfftn(x, dim=None):
    axes = _spatial(x) if dim is None else tuple(range(x.ndim - dim, x.ndim))
    return np.fft.rfftn(x, axes=axes, norm="ortho")


def uirfftn(x, shape=None, dim=None):
    axes = _spatial(x) if dim is None else tuple(range(x.ndim - dim, x.ndim))
    return np.fft.irfftn(x, shape, axes=axes, norm="ortho")


def image_quad_norm(spec, real=False):
    axes = tuple(range(1, spec.ndim))
    total = (np.abs(spec) ** 2).sum(axes)
    return 2 * total - (np.abs(spec[..., 0]) ** 2).sum(axes[:-1]) if real else total


def ir2tf(response, shape):
    """Transfer function of an impulse response centred at the origin."""
    out = np.zeros(shape)
    out[tuple(slice(0, n) for n in response.shape)] = response
    for axis, n in enumerate(response.shape):
        out = np.roll(out, -(n // 2), axis)
    return np.fft.fftn(out)


def laplacian(ndim, shape):
    r = np.zeros((3,) * ndim)
    centre = (1,) * ndim
    r[centre] = 2.0 * ndim
    for axis in range(ndim):
        for k in (0, 2):
            at = list(centre)
            at[axis] = k
            r[tuple(at)] = -1.0
    return ir2tf(r, shape), r


def correlate2d(x, kernel, mode="full", boundary="fill", fillvalue=0.0):
    return convolve2d(x, np.conj(np.asarray(kernel)[::-1, ::-1]), mode, boundary, fillvalue)


# Filters given by an impulse response f(r, c) --------------------------------------


class LPIFilter2D:
    """A linear filter by its impulse response, sampled on an odd grid around the origin.

    Spectra are padded to twice the image, so nothing wraps around.
    """

    def __init__(self, impulse_response):
        self.response = impulse_response

    def spectrum(self, shape):
        odd = [n + 1 - n % 2 for n in shape]
        r, c = np.meshgrid(*[np.arange(n) - n // 2 for n in odd], indexing="ij")
        return ir2tf(np.asarray(self.response(r, c), float), tuple(2 * n - 1 for n in odd))

    def _apply(self, x, change):
        f = self.spectrum(x.shape[1:])
        out = np.fft.ifft2(np.fft.fft2(x, f.shape, axes=(1, 2)) * change(f), axes=(1, 2))
        return np.abs(out[:, : x.shape[1], : x.shape[2]])

    def __call__(self, x):
        return self._apply(x, lambda f: f)

    def inverse(self, x, max_gain=2.0):
        """Divides by the spectrum; no frequency is amplified by more than ``max_gain``."""

        def change(f):
            size = np.maximum(np.abs(f), np.finfo(float).tiny)
            return np.conj(f) / size * np.minimum(1 / size, max_gain)

        return self._apply(x, change)

    def wiener(self, x, k=0.25):
        """Least mean square inverse for a noise-to-signal ratio ``k``."""
        return self._apply(x, lambda f: np.conj(f) / (np.abs(f) ** 2 + k))


def ufft2(x):
    return np.fft.fft2(x, norm="ortho")


def uifft2(x):
    return np.fft.ifft2(x, norm="ortho")


def urfft2(x):
    return np.fft.rfft2(x, norm="ortho")


def uirfft2(x, shape=None):
    return np.fft.irfft2(x, s=shape, norm="ortho")
