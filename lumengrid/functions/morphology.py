"""Structuring elements, binary and grey morphology, labelling by fixpoints."""

from __future__ import annotations

import numpy as np

from . import filters as nf


def square(n):
    return np.ones((n, n), bool)


def rectangle(rows, cols):
    return np.ones((rows, cols), bool)


def cube(n):
    return np.ones((n, n, n), bool)


def diamond(r):
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    return abs(y) + abs(x) <= r


def disk(r):
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    return y * y + x * x <= r * r


def ball(r):
    z, y, x = np.mgrid[-r : r + 1, -r : r + 1, -r : r + 1]
    return z * z + y * y + x * x <= r * r


def octahedron(r):
    z, y, x = np.mgrid[-r : r + 1, -r : r + 1, -r : r + 1]
    return abs(z) + abs(y) + abs(x) <= r


def octagon(m, n):
    y, x = np.mgrid[: m + 2 * n, : m + 2 * n]
    e = m + 2 * n - 1
    return (y + x >= n) & (y + x <= 2 * e - n) & (x - y <= m + n - 1) & (y - x <= m + n - 1)


def generate_binary_structure(rank, connectivity):
    grid = np.indices((3,) * rank) - 1
    return np.abs(grid).sum(0) <= max(connectivity, 1)


def iterate_structure(structure, times):
    s = np.asarray(structure, bool)
    out = s
    for _ in range(times - 1):
        pad = np.pad(out, [((n - 1) // 2, n // 2) for n in s.shape])
        out = binary_dilation(pad[None], s)[0]
    return out


def _structure(x, structure):
    return generate_binary_structure(x.ndim - 1, 1) if structure is None else np.asarray(structure, bool)


def _repeat(step, x, iterations, mask):
    """Applies ``step`` so often, or until nothing changes for iterations < 1."""
    now, k = x, 0
    while True:
        new = step(now)
        if mask is not None:
            new = np.where(mask, new, x)
        k += 1
        if k == iterations or iterations < 1 and np.array_equal(new, now):
            return new
        now = new


def binary_erosion(x, structure=None, iterations=1, mask=None, border_value=0):
    s = _structure(x, structure)
    return _repeat(lambda a: nf.minimum_filter(a, footprint=s, mode="constant", cval=bool(border_value)), np.asarray(x, bool), iterations, mask)


def binary_dilation(x, structure=None, iterations=1, mask=None, border_value=0):
    s = _structure(x, structure)
    s = s[(slice(None, None, -1),) * s.ndim]
    origin = [-(n % 2 == 0) for n in s.shape]
    return _repeat(lambda a: nf.maximum_filter(a, footprint=s, mode="constant", cval=bool(border_value), origin=[int(o) for o in origin]), np.asarray(x, bool), iterations, mask)


def binary_opening(x, structure=None, iterations=1):
    return binary_dilation(binary_erosion(x, structure, iterations), structure, iterations)


def binary_closing(x, structure=None, iterations=1):
    return binary_erosion(binary_dilation(x, structure, iterations), structure, iterations)


def binary_hit_or_miss(x, structure1=None, structure2=None):
    s1 = _structure(x, structure1)
    s2 = ~s1 if structure2 is None else np.asarray(structure2, bool)
    return binary_erosion(x, s1) & binary_erosion(~np.asarray(x, bool), s2)


def binary_propagation(x, structure=None, mask=None, border_value=0):
    return binary_dilation(x, structure, -1, mask, border_value)


def binary_fill_holes(x, structure=None):
    x = np.asarray(x, bool)
    return ~binary_dilation(np.zeros_like(x), structure, -1, ~x, 1)


def _flip(footprint, offsets):
    turn = (slice(None, None, -1),) * footprint.ndim
    return footprint[turn], None if offsets is None else offsets[turn]


def grey_erosion(x, size=3, footprint=None, structure=None, mode="reflect", cval=0.0):
    f = None if footprint is None and structure is None else np.asarray(np.ones(np.shape(structure)) if footprint is None else footprint, bool)
    return nf._extreme(x, np.minimum, size, f, mode, cval, 0, None if structure is None else -np.asarray(structure, float))


def grey_dilation(x, size=3, footprint=None, structure=None, mode="reflect", cval=0.0):
    if footprint is None and structure is None:
        origin = [-(s % 2 == 0) for s in nf._axes(x, size)]
        return nf._extreme(x, np.maximum, size, None, mode, cval, [int(o) for o in origin])
    f = np.asarray(np.ones(np.shape(structure)) if footprint is None else footprint, bool)
    f, s = _flip(f, None if structure is None else np.asarray(structure, float))
    return nf._extreme(x, np.maximum, size, f, mode, cval, [-int(n % 2 == 0) for n in f.shape], s)


def grey_opening(x, **kw):
    return grey_dilation(grey_erosion(x, **kw), **kw)


def grey_closing(x, **kw):
    return grey_erosion(grey_dilation(x, **kw), **kw)


def morphological_gradient(x, **kw):
    return grey_dilation(x, **kw) - grey_erosion(x, **kw)


def morphological_laplace(x, **kw):
    return grey_dilation(x, **kw) + grey_erosion(x, **kw) - 2 * x


def white_tophat(x, **kw):
    return x - grey_opening(x, **kw)


def black_tophat(x, **kw):
    return grey_closing(x, **kw) - x


def reconstruction(seed, mask, method="dilation", footprint=None):
    """Grey reconstruction: geodesic dilations (or erosions) until nothing changes."""
    f = np.ones((3,) * (seed.ndim - 1), bool) if footprint is None else footprint
    grow, clip = (nf.maximum_filter, np.minimum) if method == "dilation" else (nf.minimum_filter, np.maximum)
    now = clip(seed, mask)
    while True:
        new = clip(grow(now, footprint=f, mode="nearest"), mask)
        if np.array_equal(new, now):
            return new
        now = new


def label(x, structure=None):
    """Components of non-zero pixels, numbered from 1 in raster order within each image.

    The least flat index spreads through each component, jumping to the index
    it points at, so the number of rounds follows the logarithm of the path.
    """
    x = np.asarray(x) != 0
    s = _structure(x, structure)
    if not np.array_equal(s, s[(slice(None, None, -1),) * s.ndim]):
        raise ValueError("structuring element is not symmetric")
    count, size = x.shape[0], int(np.prod(x.shape[1:]))
    big = count * size
    root = np.where(x, np.arange(big).reshape(x.shape), big)
    while True:
        new = np.where(x, nf.minimum_filter(root, footprint=s, mode="constant", cval=big), big)
        flat = np.append(new.ravel(), big)
        new = flat[flat[:-1]].reshape(x.shape)
        if np.array_equal(new, root):
            break
        root = new
    out = np.zeros(big + 1, np.int32)
    first = np.unique(root[x])
    image = first // size
    out[first] = np.arange(1, len(first) + 1) - np.searchsorted(image, image)
    return out[root]


def relabel_sequential(x, offset=1):
    """Labels renumbered in order of value from ``offset``; 0 stays."""
    out = np.zeros_like(x)
    for k in range(len(x)):
        values, inverse = np.unique(x[k], return_inverse=True)
        new = np.arange(len(values)) + offset - (1 if 0 in values else 0)
        out[k] = np.where(values == 0, 0, new)[inverse].reshape(x[k].shape)
    return out


def remove_small_objects(x, min_size=64, connectivity=1):
    lab = label(x, generate_binary_structure(x.ndim - 1, connectivity)) if x.dtype == bool else np.asarray(x)
    out = x.copy()
    for k in range(len(x)):
        small = np.bincount(lab[k].ravel()) < min_size
        out[k][small[lab[k]]] = 0
    return out


def remove_small_holes(x, area_threshold=64, connectivity=1):
    return ~remove_small_objects(~np.asarray(x, bool), area_threshold, connectivity)


def find_boundaries(lab, connectivity=1, mode="thick", background=0):
    """Borders between labels: thick, inner (within objects), outer (outside them, and where two touch), or subpixel (between pixels, on the doubled grid)."""
    rank = lab.ndim - 1
    if mode == "subpixel":
        pixels = (slice(None), *[slice(1, -1, 2)] * rank)
        wide = np.full((len(lab), *[2 * n + 1 for n in lab.shape[1:]]), np.nan)
        wide[pixels] = lab
        for axis in range(1, rank + 1):  # the rim counts as background
            for end in (0, -1):
                np.moveaxis(wide, axis, 0)[end] = 0
        views = np.lib.stride_tricks.sliding_window_view(wide, [3] * rank, tuple(range(1, rank + 1)))
        views = views.reshape(*views.shape[: rank + 1], -1)
        out = np.nanmax(views, -1) != np.nanmin(views, -1)
        out[(slice(None), *[slice(None, None, 2)] * rank)] = False
        return out
    s, full = generate_binary_structure(rank, connectivity), generate_binary_structure(rank, rank)
    spread = lambda f, x, foot: f(x, footprint=foot, mode="nearest")
    edge = spread(nf.maximum_filter, lab, s) != spread(nf.minimum_filter, lab, s)
    if mode == "inner":
        return edge & (lab != background)
    if mode == "outer":
        hidden = np.where(lab == background, lab.max() + 1, lab)
        touching = spread(nf.maximum_filter, lab, full) != spread(nf.minimum_filter, hidden, full)
        return edge & ((lab == background) | touching)
    return edge


def hysteresis(x, low, high):
    lab = label(x > low)
    out = np.zeros(x.shape, bool)
    for k in range(len(x)):
        keep = np.zeros(int(lab[k].max()) + 1, bool)
        keep[np.unique(lab[k][(x[k] > high) & (lab[k] > 0)])] = True
        keep[0] = False
        out[k] = keep[lab[k]]
    return out


def ellipse(width, height):
    y, x = np.mgrid[-height : height + 1, -width : width + 1]
    return (y / (height + 1)) ** 2 + (x / (width + 1)) ** 2 < 1


def star(a):
    """A square of side 2a + 1 together with the square turned by 45 degrees."""
    if a == 1:
        return np.ones((3, 3), bool)
    c = a + a // 2
    y, x = np.mgrid[-c : c + 1, -c : c + 1]
    return (np.maximum(abs(y), abs(x)) <= a) | (abs(y) + abs(x) <= c)


def default_selem(rank):
    """The structuring element of morphology without one: a pixel and its direct neighbours."""
    return generate_binary_structure(rank, 1)


def pad_for_eccentric_selems(selem):
    """The element with a row or column of zeros in front of each even side, so that it has a centre."""
    s = np.asarray(selem, bool)
    return np.pad(s, [(1 - n % 2, 0) for n in s.shape])
