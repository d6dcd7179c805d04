"""SQL for linear maps of 8x8 images: weights worked out from formulas, not by the kernels."""

from __future__ import annotations

import math

from .twins import PX

N = 8


def fold(i: int, n: int, mode: str) -> int | None:
    """The pixel that a place beyond the edge stands for; None for a constant 0."""
    if 0 <= i < n:
        return i
    if mode == "constant":
        return None
    if mode == "nearest":
        return min(max(i, 0), n - 1)
    if mode == "wrap":
        return i % n
    period = 2 * n if mode == "reflect" else 2 * n - 2
    i %= period
    return i if i < n else (period - 1 if mode == "reflect" else period) - i


def entries(rows: list[dict[int, float]]) -> list[tuple[int, int, float]]:
    """(out, in, weight) of a list of rows."""
    return [(o, i, w) for o, row in enumerate(rows) for i, w in row.items() if w]


def taps(values, n: int = N, mode: str = "reflect") -> list[dict[int, float]]:
    """A centred filter along an axis."""
    r, rows = len(values) // 2, []
    for o in range(n):
        row: dict[int, float] = {}
        for k, w in enumerate(values):
            i = fold(o + k - r, n, mode)
            if i is not None:
                row[i] = row.get(i, 0.0) + float(w)
        rows.append(row)
    return rows


def bell(sigma: float) -> list[float]:
    """A sampled Gaussian to four deviations, summing to 1."""
    r = int(4 * sigma + 0.5)
    g = [math.exp(-(t * t) / (2 * sigma * sigma)) for t in range(-r, r + 1)]
    return [x / sum(g) for x in g]


def slope(n: int = N) -> list[dict[int, float]]:
    """Central differences, one-sided at both ends."""
    return [{min(o + 1, n - 1): 1 / (min(o + 1, n - 1) - max(o - 1, 0)), max(o - 1, 0): -1 / (min(o + 1, n - 1) - max(o - 1, 0))} for o in range(n)]


def tent(places, n: int = N, mode: str = "constant") -> list[dict[int, float]]:
    """Linear interpolation at real places; outside a constant edge there is nothing."""
    rows = []
    for c in places:
        row: dict[int, float] = {}
        if mode != "constant" or 0 <= c <= n - 1:
            f = math.floor(c)
            for i, w in ((f, 1 - (c - f)), (f + 1, c - f)):
                i = fold(i, n, "nearest" if mode == "constant" else mode)
                row[i] = row.get(i, 0.0) + w
        rows.append(row)
    return rows


def cubic(t: float) -> float:
    """The cubic B-spline."""
    t = abs(t)
    return 2 / 3 - t * t + t**3 / 2 if t < 1 else (2 - t) ** 3 / 6 if t < 2 else 0.0


def _dense(rows: list[dict[int, float]], n: int) -> list[list[float]]:
    return [[row.get(i, 0.0) for i in range(n)] for row in rows]


def chained(*maps: list[dict[int, float]]) -> list[dict[int, float]]:
    """One map after another, the first given first."""
    out = maps[0]
    for m in maps[1:]:
        new = []
        for row in m:
            total: dict[int, float] = {}
            for k, w in row.items():
                for i, v in out[k].items():
                    total[i] = total.get(i, 0.0) + w * v
            new.append(total)
        out = new
    return out


def solved(rows: list[dict[int, float]], n: int = N) -> list[dict[int, float]]:
    """The inverse map, by elimination."""
    a = [r + [float(i == k) for k in range(n)] for i, r in enumerate(_dense(rows, n))]
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(a[r][c]))
        a[c], a[p] = a[p], a[c]
        a[c] = [v / a[c][c] for v in a[c]]
        for r in range(n):
            if r != c and a[r][c]:
                f = a[r][c]
                a[r] = [x - f * y for x, y in zip(a[r], a[c])]
    return [dict(enumerate(r[n:])) for r in a]


def coefficients(n: int = N) -> list[dict[int, float]]:
    """Cubic B-spline coefficients of samples mirrored at the ends."""
    return solved(taps([1 / 6, 2 / 3, 1 / 6], n, "mirror"), n)


def spline(places, n: int = N) -> list[dict[int, float]]:
    """Cubic B-spline interpolation at real places, mirrored at the ends."""
    rows = []
    for c in places:
        row: dict[int, float] = {}
        for i in range(math.floor(c) - 1, math.floor(c) + 3):
            k = fold(i, n, "mirror")
            row[k] = row.get(k, 0.0) + cubic(c - i)
        rows.append(row)
    return chained(coefficients(n), rows)


def along(source: str, name: str, axis: str, rows: list[dict[int, float]]) -> str:
    """A CTE: the map applied along one axis; outputs without a source are 0."""
    other = "x" if axis == "y" else "y"
    cells = ", ".join(f"({o}, {i}, {w!r}::DOUBLE)" for o, i, w in entries(rows) + [(o, 0, 0.0) for o, r in enumerate(rows) if not any(r.values())])
    columns = f"t.o AS y, q.{other}" if axis == "y" else f"q.{other}, t.o AS x"
    return f"{name} AS MATERIALIZED (SELECT q.image_id, {columns}, sum(t.w * q.v) AS v FROM {source} q JOIN (VALUES {cells}) AS t(o, i, w) ON q.{axis} = t.i GROUP BY ALL)"


def both(source: str, name: str, rows: list[dict[int, float]], columns: list[dict[int, float]] | None = None) -> str:
    """CTEs: a map along y, then one along x (the same, if none is given)."""
    return along(source, f"{name}_y", "y", rows) + ", " + along(f"{name}_y", name, "x", rows if columns is None else columns)


def smooth(source: str, name: str, sigma: float, mode: str = "reflect", n: int = N) -> str:
    return both(source, name, taps(bell(sigma), n, mode))


def picture(*ctes: str, value: str = "v", source: str | None = None, before: str = PX, recursive: bool = False) -> str:
    last = source or ctes[-1].rsplit(" AS MATERIALIZED (", 1)[0].rsplit(" ", 1)[-1]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([before, *ctes])} SELECT image_id, y::INT AS y, x::INT AS x, round({value}, 6) + 0.0 AS v FROM {last}"


def separable(rows, columns=None) -> str:
    return picture(both("px", "f", rows, columns), source="f")


def points(name: str, sql: str, source: str = "px", mode: str = "constant", n: int = N) -> str:
    """A CTE: linear interpolation at the places (y, x, sy, sx) that ``sql`` selects."""
    if mode == "mirror":
        m = 2 * n - 2
        sy, sx = (f"{n - 1} - abs((({c} % {m}) + {m}) % {m} - {n - 1})" for c in ("sy", "sx"))
    else:
        sy, sx = "sy", "sx"
    inside = f"sy BETWEEN 0 AND {n - 1} AND sx BETWEEN 0 AND {n - 1}" if mode == "constant" else "true"
    return f"{name}_c AS MATERIALIZED (SELECT y, x, {sy} AS sy, {sx} AS sx, {inside} AS inside FROM ({sql})), {name} AS MATERIALIZED (SELECT q.image_id, c.y, c.x, sum(CASE WHEN inside THEN greatest(0, 1 - abs(c.sy - q.y)) * greatest(0, 1 - abs(c.sx - q.x)) * q.v ELSE 0 END) AS v FROM {name}_c c CROSS JOIN {source} q GROUP BY ALL)"


GRID = "(SELECT a.k::INT AS y, b.k::INT AS x FROM range(0, 8) AS a(k), range(0, 8) AS b(k))"


def spectral(name: str, transfer: str, n: int = N, odd: str | None = None) -> str:
    """A CTE: images times a real transfer function of the signed frequencies u and v, cyclic on n x n.

    ``odd`` adds the imaginary part of the kernel as ``w``.
    """
    signed = f"CASE WHEN {{0}} <= {(n - 1) // 2} THEN {{0}} ELSE {{0}} - {n} END"
    h = f"{name}_h AS MATERIALIZED (SELECT u, v, ({transfer})::DOUBLE AS h FROM (SELECT ({signed.format('a.k')})::DOUBLE AS u, ({signed.format('b.k')})::DOUBLE AS v, a.k AS i, b.k AS j FROM range(0, {n}) AS a(k), range(0, {n}) AS b(k)))"
    k = f"{name}_k AS MATERIALIZED (SELECT a.k AS dy, b.k AS dx, sum(h * cos(2 * pi() * (u * a.k + v * b.k) / {n})) / {n * n} AS k, sum(h * sin(2 * pi() * (u * a.k + v * b.k) / {n})) / {n * n} AS s FROM {name}_h, range(0, {n}) AS a(k), range(0, {n}) AS b(k) GROUP BY ALL)"
    out = f"{name} AS MATERIALIZED (SELECT q.image_id, c.y, c.x, sum(k.k * q.v) AS v, sum(k.s * q.v) AS w FROM px q CROSS JOIN {GRID} c JOIN {name}_k k ON k.dy = (c.y - q.y + {n}) % {n} AND k.dx = (c.x - q.x + {n}) % {n} GROUP BY ALL)"
    return f"{h}, {k}, {out}"
