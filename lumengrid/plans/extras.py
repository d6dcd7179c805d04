"""Twins of queries of the catalogue that need more than one window, and further queries."""

from __future__ import annotations

import math

from . import catalog as C
from . import twins as T
from . import weights as W

SQL = C.ORACLE_SQL

# Spectra ----------------------------------------------------------------------------

_SINC = "CASE WHEN {0} = 0 THEN 1 ELSE sin(pi() * 3 * {0} / 8) / (pi() * 3 * {0} / 8) END"
_R = "(pi() * 3 / 8 * sqrt(u * u + v * v))"
_J1 = f"list_sum(list_transform(range(0, 25), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow({_R} / 2, 2 * k + 1) / (factorial(k::INT)::DOUBLE * factorial((k + 1)::INT)::DOUBLE)))"
_ONE_SIDED = "(CASE WHEN {0} IN (0, 4) THEN 1 WHEN {0} < 4 THEN 2 ELSE 0 END)"
_BLUR = "((1 + 2 * cos(2 * pi() * u / {n})) * (1 + 2 * cos(2 * pi() * v / {n})) / 9)"
_ROUGH = "(4 - 2 * cos(2 * pi() * u / 8) - 2 * cos(2 * pi() * v / 8))"
SQL["fourier_gaussian"] = W.picture(W.spectral("f", "exp(-2 * pi() * pi() * (u * u + v * v) / 64)"), source="f")
SQL["fourier_uniform"] = W.picture(W.spectral("f", f"({_SINC.format('u')}) * ({_SINC.format('v')})"), source="f")
SQL["fourier_ellipsoid"] = W.picture(W.spectral("f", f"CASE WHEN u = 0 AND v = 0 THEN 1 ELSE 2 * {_J1} / {_R} END"), source="f")
SQL["hilbert2"] = W.picture(W.spectral("f", f"{_ONE_SIDED.format('i')} * {_ONE_SIDED.format('j')}"), source="f", value="sqrt(v * v + w * w)")
SQL["wiener_deconvolve"] = W.picture(W.spectral("f", f"{_BLUR.format(n=8)} / ({_BLUR.format(n=8)} * {_BLUR.format(n=8)} + 0.1::DOUBLE * {_ROUGH} * {_ROUGH})"), source="f", value="greatest(least(v, 1), -1)")
SQL["lpi_inverse"] = W.picture(W.spectral("f", f"sign({_BLUR.format(n=17)}) * least(1 / abs({_BLUR.format(n=17)}), 2)", 17), source="f", value="abs(v)")
SQL["lpi_wiener"] = W.picture(W.spectral("f", f"{_BLUR.format(n=17)} / ({_BLUR.format(n=17)} * {_BLUR.format(n=17)} + 0.25)", 17), source="f", value="abs(v)")
SQL["fftconvolve"] = T.linear(T.ONE, "constant")

# Splines, warps, pyramids --------------------------------------------------------------

SQL["spline_filter"] = W.separable(W.coefficients())
SQL["shift_cubic"] = W.separable(W.spline([o - 0.5 for o in range(8)]))
SQL["map_coordinates"] = W.separable(W.spline([0.9 * o for o in range(8)]))
SQL["zoom"] = W.separable(W.tent([min(o * 7 / 15, 7.0) for o in range(16)]))
SQL["resize"] = W.separable(W.chained(W.taps(W.bell(0.3), mode="mirror"), W.tent([1.6 * o + 0.3 for o in range(5)], mode="mirror")))
SQL["rescale"] = W.separable(W.tent([abs(o * 2 / 3 - 1 / 6) if o < 6 else 7 - abs(o * 2 / 3 - 1 / 6 - 7) for o in range(12)], mode="mirror"))
_HALF = W.chained(W.taps(W.bell(2 / 3)), W.tent([2 * o + 0.5 for o in range(4)], mode="reflect"))
SQL["pyramid_reduce"] = W.separable(_HALF)
SQL["pyramid_expand"] = W.separable(W.chained(W.tent([o / 2 - 0.25 for o in range(16)], mode="reflect"), W.taps(W.bell(2 / 3), 16)))
SQL["pyramid_laplacian"] = f"WITH {W.PX}, {W.smooth('px', 'f', 2 / 3)} SELECT image_id, y, x, round(px.v - f.v, 6) + 0.0 AS v FROM px JOIN f USING (image_id, y, x)"
_C, _S = "cos(radians(30))", "sin(radians(30))"
SQL["rotate"] = W.picture(W.points("f", f"SELECT y, x, {_C} * (y - 3.5) + {_S} * (x - 3.5) + 3.5 AS sy, {_C} * (x - 3.5) - {_S} * (y - 3.5) + 3.5 AS sx FROM {W.GRID}"), source="f")
SQL["affine_transform"] = W.picture(W.points("f", f"SELECT y, x, y + 0.1::DOUBLE * x AS sy, 0.1::DOUBLE * y + x AS sx FROM {W.GRID}"), source="f")
SQL["warp"] = W.picture(W.points("f", f"SELECT y, x, y - 0.5 AS sy, x + 0.5 AS sx FROM {W.GRID}"), source="f")
SQL["warp_polar"] = W.picture(W.points("f", "SELECT a.k::INT AS y, r.k::INT AS x, r.k * sqrt(32.0::DOUBLE) / 6 * sin(radians(a.k)) + 3.5 AS sy, r.k * sqrt(32.0::DOUBLE) / 6 * cos(radians(a.k)) + 3.5 AS sx FROM range(0, 360) AS a(k), range(0, 6) AS r(k)"), source="f")
_RHO = "sqrt((y - 3.5) * (y - 3.5) + (x - 3.5) * (x - 3.5))"
_TURN = f"(2 * exp(-{_RHO} / ln(2.0)) + atan2(y - 3.5, x - 3.5))"
SQL["swirl"] = W.picture(W.points("f", f"SELECT y, x, 3.5 + {_RHO} * sin({_TURN}) AS sy, 3.5 + {_RHO} * cos({_TURN}) AS sx FROM {W.GRID}", mode="mirror"), source="f")

# Corners, ridges, windows -------------------------------------------------------------------

_EDGE, _BELL = [-1, 0, 1], [1, 2, 1]
_GRADS = ", ".join([W.both("px", "gy", W.taps(_EDGE, mode="constant"), W.taps(_BELL, mode="constant")), W.both("px", "gx", W.taps(_BELL, mode="constant"), W.taps(_EDGE, mode="constant"))])
_G1 = W.taps(W.bell(1.0), mode="constant")


def _product(a: str, b: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT a.image_id, a.y, a.x, a.v * b.v AS v FROM {a} a JOIN {b} b USING (image_id, y, x))"


def _joined(value: str, *names: str, by: str = "f") -> str:
    """A CTE ``f``: an expression of pixels of several images, each under its own name."""
    first, *rest = names
    joins = " ".join(f"JOIN {n} USING (image_id, y, x)" for n in rest)
    return f"{by} AS MATERIALIZED (SELECT image_id, y, x, {value} AS v FROM {first} {joins})"


_TENSOR = ", ".join([_GRADS, *[_product(p, q, f"p{n}") + ", " + W.both(f"p{n}", n, _G1) for n, p, q in (("a", "gy", "gy"), ("b", "gy", "gx"), ("c", "gx", "gx"))]])
_HI = "((a.v + c.v) / 2 + sqrt(4 * b.v * b.v + (a.v - c.v) * (a.v - c.v)) / 2)"
_LO = "((a.v + c.v) / 2 - sqrt(4 * b.v * b.v + (a.v - c.v) * (a.v - c.v)) / 2)"
_DET, _TRACE = "(a.v * c.v - b.v * b.v)", "(a.v + c.v)"
for _name, _value in {"structure_tensor_eigenvalues": _HI, "corner_shi_tomasi": _LO, "corner_harris": f"{_DET} - 0.05::DOUBLE * {_TRACE} * {_TRACE}", "corner_foerstner": f"CASE WHEN {_TRACE} = 0 THEN 0 ELSE {_DET} / {_TRACE} END"}.items():
    SQL[_name] = W.picture(_TENSOR, _joined(_value, "a", "b", "c"), source="f")

_SLOPE, _SAME = W.slope(), [{k: 1.0} for k in range(8)]
_HESSIAN = ", ".join([W.both("px", "g", _G1), W.both("g", "a", W.chained(_SLOPE, _SLOPE), _SAME), W.both("g", "b", _SLOPE, _SLOPE), W.both("g", "c", _SAME, W.chained(_SLOPE, _SLOPE))])
_BIG, _SMALL = (f"(CASE WHEN abs({_HI}) {op} abs({_LO}) THEN {_HI} ELSE {_LO} END)" for op in (">=", "<"))
_VESSEL = f"(CASE WHEN {_BIG} > 0 THEN exp(-pow({_SMALL} / {_BIG}, 2) / 0.5) * (1 - exp(-({_BIG} * {_BIG} + {_SMALL} * {_SMALL}) / 450)) ELSE 0 END)"
for _name, _value in {
    "hessian_matrix_det": _DET,
    "shape_index": f"CASE WHEN {_HI} = {_LO} AND {_HI} + {_LO} = 0 THEN 0 ELSE 2 / pi() * atan(({_LO} + {_HI}) / ({_LO} - {_HI})) END",
    "hessian_eigenvalues": f"CASE WHEN abs({_LO}) <= abs({_HI}) THEN {_HI} ELSE {_LO} END",
}.items():
    SQL[_name] = W.picture(_HESSIAN, _joined(_value, "a", "b", "c"), source="f")
# Ridges reflect the image at its edge, where features take it as 0.
_CURVED = _HESSIAN.replace(W.both("px", "g", _G1), W.smooth("px", "g", 1.0))
for _name, _value in {"sato": f"greatest({_HI}, 0)", "frangi": _VESSEL, "hessian_ridges": f"CASE WHEN {_VESSEL} <= 0 THEN 1 ELSE {_VESSEL} END"}.items():
    SQL[_name] = W.picture(_CURVED, _joined(_value, "a", "b", "c"), source="f")
SQL["meijering"] = W.picture(_CURVED, _joined(f"-1.5 * {_BIG}", "a", "b", "c", by="m"), "f AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN v < 0 THEN v / min(v) OVER (PARTITION BY image_id) ELSE 0 END AS v FROM m)", source="f")
_PLAIN = ", ".join([W.both("px", "gy", _SLOPE, _SAME), W.both("px", "gx", _SAME, _SLOPE), W.both("px", "a", W.chained(_SLOPE, _SLOPE), _SAME), W.both("px", "b", _SLOPE, _SLOPE), W.both("px", "c", _SAME, W.chained(_SLOPE, _SLOPE))])
SQL["corner_kitchen_rosenfeld"] = W.picture(_PLAIN, _joined("CASE WHEN gx.v * gx.v + gy.v * gy.v = 0 THEN 0 ELSE (c.v * gy.v * gy.v + a.v * gx.v * gx.v - 2 * b.v * gx.v * gy.v) / (gx.v * gx.v + gy.v * gy.v) END", "gy", "gx", "a", "b", "c"), source="f")
_E = {(k, k): 1.0 for k in range(3)}
SQL["match_template"] = f"WITH {W.PX}, t(dy, dx, w) AS (VALUES {', '.join(f'({a}, {b}, {_E.get((a, b), 0.0)}::DOUBLE)' for a in range(3) for b in range(3))}), s AS (SELECT p.image_id, p.y, p.x, sum(q.v) AS s1, sum(q.v * q.v) AS s2, sum(q.v * w) AS c FROM px p CROSS JOIN t JOIN px q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.y < 6 AND p.x < 6 GROUP BY 1, 2, 3) SELECT image_id, y, x, round(CASE WHEN sqrt(greatest((s2 - s1 * s1 / 9) * 2, 0)) > 1e-12 THEN (c - s1 / 3) / sqrt(greatest((s2 - s1 * s1 / 9) * 2, 0)) ELSE 0 END, 6) + 0.0 AS v FROM s"
_GABOR = []
_SD = (0.6931471805599453 / 2) ** 0.5 / 3.141592653589793 * 3 / 0.3
for _a in range(-6, 7):
    for _b in range(-6, 7):
        _GABOR.append((-_a, -_b, math.exp(-0.5 * (_a * _a + _b * _b) / _SD**2) / (2 * math.pi * _SD**2) * math.cos(2 * math.pi * 0.3 * _b)))
SQL["gabor"] = T.linear(_GABOR)
SQL["wiener_local"] = W.picture("m AS MATERIALIZED (SELECT p.image_id, p.y, p.x, sum(q.v) / 9 AS m, sum(q.v * q.v) / 9 - sum(q.v) / 9 * sum(q.v) / 9 AS s, any_value(p.v) AS v FROM px p JOIN px q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL)", "f AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN s < avg(s) OVER (PARTITION BY image_id) THEN m ELSE m + (v - m) * (1 - avg(s) OVER (PARTITION BY image_id) / s) END AS v FROM m)", source="f")
SQL["threshold_sauvola"] = T.pixels(T.step("px", "f", T.ONE, "avg(q.v) * (1 + 0.2 * (sqrt(greatest(avg(q.v * q.v) - avg(q.v) * avg(q.v), 0)) - 1))", "mirror"))
_SOBEL = SQL["sobel"]
SQL["sobel_masked"] = f"WITH e AS ({_SOBEL}), {W.PX}, k AS (SELECT p.image_id, p.y, p.x, count(*) AS n FROM px p JOIN px q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 AND q.v > -0.2 GROUP BY ALL) SELECT e.image_id, e.y, e.x, CASE WHEN k.n = 9 THEN e.v ELSE 0 END AS v FROM e LEFT JOIN k USING (image_id, y, x)"
SQL["structural_similarity"] = f"WITH {W.PX}, j AS (SELECT p.image_id // 2 AS image_id, p.y, p.x, p.v AS a, q.v AS b FROM px p JOIN px q ON q.image_id = p.image_id + 1 AND q.y = p.y AND q.x = p.x WHERE p.image_id % 2 = 0), m AS (SELECT c.image_id, c.y, c.x, avg(w.a) AS ua, avg(w.b) AS ub, 9.0 / 8 * (avg(w.a * w.a) - avg(w.a) * avg(w.a)) AS va, 9.0 / 8 * (avg(w.b * w.b) - avg(w.b) * avg(w.b)) AS vb, 9.0 / 8 * (avg(w.a * w.b) - avg(w.a) * avg(w.b)) AS vab FROM j c JOIN j w ON w.image_id = c.image_id AND abs(w.y - c.y) <= 1 AND abs(w.x - c.x) <= 1 WHERE c.y BETWEEN 1 AND 6 AND c.x BETWEEN 1 AND 6 GROUP BY ALL) SELECT image_id, 0 AS y, 0 AS x, round(avg((2 * ua * ub + 0.0004::DOUBLE) * (2 * vab + 0.0036::DOUBLE) / ((ua * ua + ub * ub + 0.0004::DOUBLE) * (va + vb + 0.0036::DOUBLE))), 6) + 0.0 AS v FROM m GROUP BY image_id"

# Morphology ------------------------------------------------------------------------------------

_BIT = "bx AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN v > 0 THEN 1 ELSE 0 END AS v FROM px)"
_DIAGONAL = "(VALUES (-1, -1), (-1, 1), (1, -1), (1, 1))"
_PLUS = "(VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))"
SQL["binary_hit_or_miss"] = W.picture(_BIT, f"f AS (SELECT p.image_id, p.y, p.x, CASE WHEN sum(CASE WHEN abs(q.y - p.y) + abs(q.x - p.x) <= 1 THEN q.v ELSE 0 END) = 5 AND sum(CASE WHEN abs(q.y - p.y) + abs(q.x - p.x) = 2 THEN 1 - q.v ELSE 0 END) = 4 THEN 1 ELSE 0 END AS v FROM bx p JOIN bx q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL)", source="f")
SQL["binary_propagation"] = SQL["apply_hysteresis_threshold"]
SQL["binary_fill_holes"] = W.picture("r AS (SELECT image_id, y, x FROM px WHERE v <= 0 AND (y IN (0, 7) OR x IN (0, 7)) UNION SELECT n.image_id, n.y, n.x FROM r JOIN px n ON n.image_id = r.image_id AND abs(n.y - r.y) + abs(n.x - r.x) = 1 WHERE n.v <= 0)", "f AS (SELECT px.image_id, px.y, px.x, CASE WHEN r.y IS NULL THEN 1 ELSE 0 END AS v FROM px LEFT JOIN r USING (image_id, y, x))", source="f", recursive=True)
_HOLES = C._LABELS.replace("WHERE v > 0", "WHERE v <= 0")
SQL["remove_small_holes"] = _HOLES + " SELECT px.image_id, px.y, px.x, CASE WHEN l.label IS NULL OR count(l.label) OVER (PARTITION BY px.image_id, l.label) < 3 THEN 1.0 ELSE 0.0 END AS v FROM px LEFT JOIN l ON l.image_id = px.image_id AND l.y = px.y AND l.x = px.x"
_FULL = C._LABELS + ", lab AS MATERIALIZED (SELECT px.image_id, px.y, px.x, px.v, coalesce(l.label, 0) AS label FROM px LEFT JOIN l ON l.image_id = px.image_id AND l.y = px.y AND l.x = px.x)"
_BORDER = _FULL + ", e AS (SELECT p.image_id, p.y, p.x, p.v, max(q.label) <> min(q.label) AS edge FROM lab p JOIN lab q ON q.image_id = p.image_id AND abs(q.y - p.y) + abs(q.x - p.x) <= 1 GROUP BY ALL)"
SQL["find_boundaries"] = _BORDER + " SELECT image_id, y, x, CASE WHEN edge THEN 1.0 ELSE 0.0 END AS v FROM e"
_NEAR8 = "JOIN lab q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1"
_OUTER = _BORDER + f", o AS MATERIALIZED (SELECT e.image_id, e.y, e.x, e.v, e.edge, p.label, e.edge AND (p.label = 0 OR t.touching) AS outside FROM e JOIN lab p USING (image_id, y, x) JOIN (SELECT p.image_id, p.y, p.x, max(q.label) <> min(CASE WHEN q.label = 0 THEN 1000 ELSE q.label END) AS touching FROM lab p {_NEAR8} GROUP BY ALL) t USING (image_id, y, x))"
SQL["find_boundaries_outer"] = _OUTER + " SELECT image_id, y, x, CASE WHEN outside THEN 1.0 ELSE 0.0 END AS v FROM o"
SQL["mark_boundaries"] = _OUTER + " SELECT image_id, y, (3 * x + c.k)::INT AS x, CASE WHEN outside THEN CASE WHEN c.k < 2 THEN 1.0 ELSE 0.0 END ELSE round(v, 6) + 0.0 END AS v FROM o, range(0, 3) AS c(k)"
SQL["mark_boundaries_outline"] = _BORDER + f", i AS MATERIALIZED (SELECT e.image_id, e.y, e.x, e.v, e.edge AND p.label > 0 AS edge FROM e JOIN lab p USING (image_id, y, x)), z AS (SELECT p.image_id, p.y, p.x, p.v, p.edge, bool_or(q.edge) AS near FROM i p {_NEAR8.replace('lab q', 'i q')} GROUP BY ALL) SELECT image_id, y, (3 * x + c.k)::INT AS x, CASE WHEN edge THEN CASE WHEN c.k = 0 THEN 1.0 ELSE 0.0 END WHEN near THEN CASE WHEN c.k = 2 THEN 1.0 ELSE 0.0 END ELSE round(v, 6) + 0.0 END AS v FROM z, range(0, 3) AS c(k)"
# Between pixels: what the surrounding pixels hold, and 0 beyond the edge.
SQL["find_boundaries_subpixel"] = _FULL + ", w AS MATERIALIZED (SELECT px.image_id, a.k AS y, b.k AS x FROM (SELECT DISTINCT image_id FROM px) px, range(0, 15) AS a(k), range(0, 15) AS b(k)), n AS (SELECT w.image_id, w.y, w.x, max(CASE WHEN w.y IN (0, 14) OR w.x IN (0, 14) THEN greatest(q.label, 0) ELSE q.label END) AS hi, min(CASE WHEN w.y IN (0, 14) OR w.x IN (0, 14) THEN least(q.label, 0) ELSE q.label END) AS lo FROM w JOIN lab q ON q.image_id = w.image_id AND abs(2 * q.y - w.y) <= 1 AND abs(2 * q.x - w.x) <= 1 GROUP BY ALL) SELECT image_id, y::INT AS y, x::INT AS x, CASE WHEN hi <> lo AND (y % 2 = 1 OR x % 2 = 1) THEN 1.0 ELSE 0.0 END AS v FROM n"


def _steps(first: str, step: str, times: int) -> str:
    """CTEs s0 to s<times>, each made of the one before ({0})."""
    return ", ".join([f"s0 AS MATERIALIZED ({first})"] + [f"s{k + 1} AS MATERIALIZED ({step.format(f's{k}')})" for k in range(times)])


SQL["grey_reconstruction"] = W.picture(_steps("SELECT image_id, y, x, v - 0.1::DOUBLE AS v, v AS top FROM px", "SELECT p.image_id, p.y, p.x, least(max(q.v), p.top) AS v, p.top FROM {0} p JOIN {0} q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY p.image_id, p.y, p.x, p.top", 40), source="s40")
_NEAR = ", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1))


def _curve(source: str, name: str, inner: str, outer: str) -> str:
    """Least (or greatest) of each of four lines through a pixel, then the greatest (or least) of the four."""
    lines = ("d.dy = d.dx", "d.dy = -d.dx", "d.dx = 0", "d.dy = 0")
    return f"{name} AS MATERIALIZED (SELECT p.image_id, p.y, p.x, {outer}({', '.join(f'{inner}(CASE WHEN {line} THEN q.v END)' for line in lines)}) AS v FROM {source} p CROSS JOIN (VALUES {_NEAR}) AS d(dy, dx) JOIN {source} q ON q.image_id = p.image_id AND q.y = least(greatest(p.y + d.dy, 0), 7) AND q.x = least(greatest(p.x + d.dx, 0), 7) GROUP BY ALL)"


def _level_sets(first: str, force, times: int, before: str = "") -> str:
    """Five rounds or so: a force on the level set, then one smoothing of its curve."""
    out = [*([before] if before else []), f"u0 AS MATERIALIZED ({first})"]
    for k in range(times):
        out.append(force(f"u{k}", f"m{k}"))
        a, b = (("max", "least"), ("min", "greatest")) if k % 2 == 0 else (("min", "greatest"), ("max", "least"))
        out += [_curve(f"m{k}", f"c{k}", *a), _curve(f"c{k}", f"u{k + 1}", *b)]
    return W.picture(*out, source=f"u{times}")


def _slopes(source: str, name: str) -> str:
    at = lambda axis, by: f"least(greatest(p.{axis} + {by}, 0), 7)"
    side = lambda n, axis, by: f"JOIN {source} {n} ON {n}.image_id = p.image_id AND {n}.y = {at('y', by) if axis == 'y' else 'p.y'} AND {n}.x = {at('x', by) if axis == 'x' else 'p.x'}"
    return f"{name} AS MATERIALIZED (SELECT p.image_id, p.y, p.x, p.v AS u, (b.v - a.v)::DOUBLE / (b.y - a.y) AS gy, (d.v - c.v)::DOUBLE / (d.x - c.x) AS gx FROM {source} p {side('a', 'y', -1)} {side('b', 'y', 1)} {side('c', 'x', -1)} {side('d', 'x', 1)})"


def _chan_vese(source: str, name: str) -> str:
    whole = "OVER (PARTITION BY image_id)"
    moved = f"(abs(gy) + abs(gx)) * (pow(v - sum(v * u) {whole} / (sum(u) {whole} + 1e-8), 2) - pow(v - sum(v * (1 - u)) {whole} / (sum(1 - u) {whole} + 1e-8), 2))"
    return f"{_slopes(source, name + 'g')}, {name} AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN f < 0 THEN 1 WHEN f > 0 THEN 0 ELSE u END AS v FROM (SELECT image_id, y, x, u, {moved} AS f FROM {name}g JOIN px USING (image_id, y, x)))"


def _geodesic(source: str, name: str) -> str:
    return f"{_slopes(source, name + 'g')}, {name} AS MATERIALIZED (SELECT a.image_id, a.y, a.x, CASE WHEN a.gy * e.gy + a.gx * e.gx > 0 THEN 1 WHEN a.gy * e.gy + a.gx * e.gx < 0 THEN 0 ELSE a.u END AS v FROM {name}g a JOIN edge e USING (image_id, y, x))"


SQL["morphological_chan_vese"] = _level_sets("SELECT image_id, y, x, CASE WHEN (y // 5 + x // 5) % 2 = 1 THEN 1 ELSE 0 END AS v FROM px", _chan_vese, 5)
_D1 = [t * w for t, w in zip(range(-4, 5), W.bell(1.0))]
_NEAREST = lambda values: W.taps(values, mode="nearest")
_INVERSE = ", ".join([W.both("px", "ny", _NEAREST(_D1), _NEAREST(W.bell(1.0))), W.both("px", "nx", _NEAREST(W.bell(1.0)), _NEAREST(_D1)), "gg AS MATERIALIZED (SELECT image_id, y, x, 1 / sqrt(1 + 10 * sqrt(ny.v * ny.v + nx.v * nx.v)) AS v FROM ny JOIN nx USING (image_id, y, x))"])
SQL["morphological_geodesic_active_contour"] = _level_sets("SELECT image_id, y, x, CASE WHEN 3 - sqrt((y - 3.5) * (y - 3.5) + (x - 3.5) * (x - 3.5)) > 0 THEN 1 ELSE 0 END AS v FROM px", _geodesic, 5, f"{_INVERSE}, {_slopes('gg', 'edge')}")
_TEN = "1 / 9.0::DOUBLE"
SQL["richardson_lucy"] = W.picture(
    _steps("SELECT image_id, y, x, 0.5::DOUBLE AS v, (v + 1) / 2 AS s FROM px", "SELECT p.image_id, p.y, p.x, p.v * sum(r.r) / 9 AS v, p.s FROM {0} p JOIN (SELECT a.image_id, a.y, a.x, a.s / (sum(b.v) / 9 + 1e-12) AS r FROM {0} a JOIN {0} b ON b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY a.image_id, a.y, a.x, a.s) r ON r.image_id = p.image_id AND abs(r.y - p.y) <= 1 AND abs(r.x - p.x) <= 1 GROUP BY p.image_id, p.y, p.x, p.v, p.s", 5),
    source="s5",
    value="least(greatest(v, -1), 1)",
)
_CODE = f"WITH {T.PX}, b AS MATERIALIZED (SELECT image_id, y, x FROM px WHERE v > 0), e AS MATERIALIZED (SELECT b.image_id, b.y, b.x FROM b JOIN b n ON n.image_id = b.image_id AND abs(n.y - b.y) + abs(n.x - b.x) <= 1 GROUP BY ALL HAVING count(*) < 5), k AS (SELECT px.image_id, px.y, px.x, sum(CASE abs(e.y - px.y) + abs(e.x - px.x) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END) AS c FROM px JOIN e ON e.image_id = px.image_id AND abs(e.y - px.y) <= 1 AND abs(e.x - px.x) <= 1 GROUP BY ALL), i AS (SELECT DISTINCT image_id FROM px)"
SQL["perimeter"] = _CODE + " SELECT i.image_id, 0 AS y, 0 AS x, round(coalesce(sum(CASE WHEN c IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN c IN (21, 33) THEN sqrt(2.0::DOUBLE) WHEN c IN (13, 23) THEN (1 + sqrt(2.0::DOUBLE)) / 2 ELSE 0 END), 0), 6) + 0.0 AS v FROM i LEFT JOIN k USING (image_id) GROUP BY 1"
_LINES = " + ".join(f"{w} * count(*) FILTER (WHERE (n.y - b.y, n.x - b.x) IN (({a}, {c}), ({-a}, {-c})))" for a, c, w in ((0, 1, "1.0"), (1, 0, "1.0"), (1, 1, "sqrt(0.5::DOUBLE)"), (1, -1, "sqrt(0.5::DOUBLE)")))
_EACH = "2 + 2 + 4 * sqrt(0.5::DOUBLE)"
SQL["perimeter_crofton"] = f"WITH {T.PX}, b AS MATERIALIZED (SELECT image_id, y, x FROM px WHERE v > 0), i AS (SELECT DISTINCT image_id FROM px), n AS (SELECT image_id, count(*) AS n FROM b GROUP BY 1), t AS (SELECT b.image_id, {_LINES} AS t FROM b JOIN b n ON n.image_id = b.image_id AND abs(n.y - b.y) <= 1 AND abs(n.x - b.x) <= 1 AND (n.y <> b.y OR n.x <> b.x) GROUP BY 1) SELECT image_id, 0 AS y, 0 AS x, round(pi() / 4 / 2 * (coalesce(n, 0) * ({_EACH}) - coalesce(t, 0)), 6) + 0.0 AS v FROM i LEFT JOIN n USING (image_id) LEFT JOIN t USING (image_id)"

# Thresholds and histograms -------------------------------------------------------------------------

_AS_PIXEL = "SELECT image_id, 0 AS y, 0 AS x, round({0}::DOUBLE, 6) + 0.0 AS v FROM {1}"
SQL["threshold_yen"] = C._H + ", p AS (SELECT image_id, bin, n / sum(n) OVER (PARTITION BY image_id) AS p FROM h), r AS (SELECT image_id, bin, sum(p) OVER u AS c, sum(p * p) OVER u AS q0, sum(p * p) OVER a - sum(p * p) OVER u AS q1, max(bin) OVER a AS last FROM p WINDOW u AS (PARTITION BY image_id ORDER BY bin), a AS (PARTITION BY image_id)), s AS (SELECT image_id, bin, CASE WHEN bin < last AND q1 > 1e-12 THEN round(-ln(q0 * q1) + 2 * ln(c * (1 - c)), 9) END AS score FROM r), m AS (SELECT image_id, max(score) AS best, max(bin) AS last FROM s GROUP BY 1) SELECT m.image_id, coalesce(min(s.bin), any_value(m.last))::INT AS threshold FROM m LEFT JOIN s ON s.image_id = m.image_id AND s.score = m.best GROUP BY 1"
SQL["threshold_triangle"] = C._H + f", g AS (SELECT image_id, min(bin) AS lo, max(bin) AS hi, max(n) AS height FROM h GROUP BY 1), t AS (SELECT g.*, (SELECT min(bin) FROM h WHERE h.image_id = g.image_id AND h.n = g.height) AS top FROM g), k AS (SELECT *, top - lo < hi - top AS flip, CASE WHEN top - lo < hi - top THEN 255 - hi ELSE lo END AS lo2, CASE WHEN top - lo < hi - top THEN 255 - top ELSE top END AS top2 FROM t), d AS (SELECT k.image_id, flip, lo2, s.k AS far, height::DOUBLE / sqrt(height * height + (top2 - lo2) * (top2 - lo2)) * s.k - (top2 - lo2)::DOUBLE / sqrt(height * height + (top2 - lo2) * (top2 - lo2)) * coalesce(h.n, 0) AS d FROM k JOIN range(0, 256) AS s(k) ON s.k < greatest(top2 - lo2, 1) LEFT JOIN h ON h.image_id = k.image_id AND h.bin = CASE WHEN flip THEN 255 - (lo2 + s.k) ELSE lo2 + s.k END), b AS (SELECT image_id, any_value(flip) AS flip, any_value(lo2) AS lo2, arg_max(far, (round(d, 9), -far)) AS far FROM d GROUP BY 1) {_AS_PIXEL.format('CASE WHEN flip THEN 255 - (lo2 + far) ELSE lo2 + far END', 'b')}"
SQL["threshold_multiotsu"] = C._H + ", c AS MATERIALIZED (SELECT image_id, bin, sum(n) OVER u AS w, sum(n * bin) OVER u AS s, sum(n) OVER a AS wa, sum(n * bin) OVER a AS sa FROM h WINDOW u AS (PARTITION BY image_id ORDER BY bin), a AS (PARTITION BY image_id)), p AS (SELECT a.image_id, a.bin AS t1, b.bin AS t2, a.s * a.s / a.w + (b.s - a.s) * (b.s - a.s) / (b.w - a.w) + (b.sa - b.s) * (b.sa - b.s) / (b.wa - b.w) AS score FROM c a JOIN c b ON b.image_id = a.image_id AND b.bin > a.bin WHERE b.w < b.wa), m AS (SELECT image_id, arg_max({'a': t1, 'b': t2}, (round(score, 6), -t2, -t1)) AS t FROM p GROUP BY 1) SELECT image_id, 0 AS y, k.x::INT AS x, round((CASE k.x WHEN 0 THEN t.a ELSE t.b END)::DOUBLE, 6) AS v FROM m, (VALUES (0), (1)) AS k(x)"
SQL["threshold_li"] = f"WITH RECURSIVE {T.PX}, i AS (SELECT image_id, min(v) AS base, list(v) AS vs FROM px GROUP BY 1), z AS (SELECT image_id, base, list_transform(vs, lambda e: e - base) AS vs FROM i), o AS (SELECT image_id, base, vs, list_sort(list_distinct(vs)) AS u FROM z), g AS (SELECT image_id, base, vs, list_min(list_transform(range(1, len(u)), lambda k: u[k + 1] - u[k])) / 2 AS tol, list_avg(vs) AS t FROM o), r AS (SELECT image_id, base, vs, tol, t, -2 * tol AS last, 0 AS k FROM g UNION ALL SELECT image_id, base, vs, tol, CASE WHEN mb = 0 OR mf = mb THEN t ELSE (mb - mf) / (ln(mb) - ln(mf)) END, t, k + 1 FROM (SELECT *, list_avg(list_filter(vs, lambda e: e > t)) AS mf, list_avg(list_filter(vs, lambda e: e <= t)) AS mb FROM r WHERE abs(t - last) > tol AND k < 500)), f AS (SELECT image_id, base + arg_max(t, k) AS t FROM r GROUP BY image_id, base) {_AS_PIXEL.format('t', 'f')}"
SQL["equalize_hist"] = f"WITH {T.PX}, b AS MATERIALIZED (SELECT image_id, least(floor((v + 1) / 2 * 64), 63)::INT AS bin, count(*) AS n FROM px WHERE v BETWEEN -1 AND 1 GROUP BY 1, 2), c AS MATERIALIZED (SELECT i.image_id, g.k AS bin, (SELECT coalesce(sum(n), 0) FROM b WHERE b.image_id = i.image_id AND b.bin <= g.k) / (SELECT sum(n) FROM b WHERE b.image_id = i.image_id) AS c FROM (SELECT DISTINCT image_id FROM b) i, range(0, 64) AS g(k)), a AS (SELECT image_id, y, x, (v + 1) / (2.0::DOUBLE / 64) - 0.5 AS p FROM px), l AS (SELECT *, least(greatest(floor(p), 0), 63)::INT AS k FROM a) SELECT l.image_id, l.y, l.x, round(c.c + (d.c - c.c) * least(greatest(l.p - l.k, 0), 1), 6) AS v FROM l JOIN c ON c.image_id = l.image_id AND c.bin = l.k JOIN c d ON d.image_id = l.image_id AND d.bin = least(l.k + 1, 63)"
SQL["match_histograms"] = f"WITH {T.PX}, {T.QX}, o AS (SELECT image_id, q AS v, sum(count(*)) OVER (PARTITION BY image_id ORDER BY q) / sum(count(*)) OVER (PARTITION BY image_id) AS q FROM qx GROUP BY image_id, q), r AS (SELECT q AS v, sum(count(*)) OVER (ORDER BY q) / sum(count(*)) OVER () AS q FROM qx GROUP BY q), s AS MATERIALIZED (SELECT v AS v1, q AS q1, coalesce(lag(v) OVER (ORDER BY q), v) AS v0, coalesce(lag(q) OVER (ORDER BY q), 0) AS q0 FROM r), m AS (SELECT o.image_id, o.v, v0 + (v1 - v0) * (o.q - q0) / (q1 - q0) AS t FROM o JOIN s ON o.q > s.q0 AND o.q <= s.q1) SELECT qx.image_id, qx.y, qx.x, round(m.t, 6) + 0.0 AS v FROM qx JOIN m ON m.image_id = qx.image_id AND m.v = qx.q"

# Regions ---------------------------------------------------------------------------------------------

_PI = "3.141592653589793::DOUBLE"
_TABLE = f"""g AS (SELECT image_id, label, count(*) AS n, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, avg(y) AS cy, avg(x) AS cx, min(v) AS lo, max(v) AS hi, avg(v) AS mean, sum(y * y) / count(*) AS yy, sum(x * x) / count(*) AS xx, sum(x * y) / count(*) AS xy FROM lab WHERE label <> 0 GROUP BY 1, 2),
e AS (SELECT *, (y1 - y0) * (x1 - x0) AS box, xx - cx * cx AS a, yy - cy * cy AS c, cx * cy - xy AS b FROM g), w AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS e0, greatest((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b), 0) AS e1 FROM e)
SELECT image_id, label, n AS area, y0 AS bbox_0, x0 AS bbox_1, y1 AS bbox_2, x1 AS bbox_3, box AS bbox_area, round(n / box, 6) AS extent, round(cy, 6) AS centroid_0, round(cx, 6) AS centroid_1, round(sqrt(4 * n / {_PI}), 6) AS equivalent_diameter, round(lo, 6) + 0.0 AS min_intensity, round(hi, 6) + 0.0 AS max_intensity, round(mean, 6) + 0.0 AS mean_intensity, round(a, 6) + 0.0 AS inertia_0_0, round(b, 6) + 0.0 AS inertia_0_1, round(c, 6) + 0.0 AS inertia_1_1,
 round(e0, 6) + 0.0 AS inertia_eigval_0, round(e1, 6) + 0.0 AS inertia_eigval_1, round(4 * sqrt(e0), 6) + 0.0 AS major_axis_length, round(4 * sqrt(e1), 6) + 0.0 AS minor_axis_length, round(CASE WHEN e0 > 0 THEN sqrt(greatest(1 - e1 / e0, 0)) ELSE 0 END, 6) + 0.0 AS eccentricity, round(CASE WHEN abs(a - c) < 1e-12 THEN CASE WHEN b < -1e-12 THEN -{_PI} / 4 ELSE {_PI} / 4 END WHEN abs(b) < 1e-12 THEN CASE WHEN c < a THEN -{_PI} / 2 ELSE 0 END ELSE 0.5 * atan2(-2 * b, c - a) END, 6) + 0.0 AS orientation FROM w"""
C.register("regionprops_all", lambda spark, sf: C.rounded(C.regions.region_table(C._labelled(spark, sf))), f"{_FULL}, {_TABLE}")
_OTSU = f"""WITH RECURSIVE {T.PX}, {T.step('px', 'sm', T.BOX).replace(' AS (', ' AS MATERIALIZED (', 1)}, qx AS MATERIALIZED (SELECT *, least(greatest(floor((v + 1) / 2 * 255.5), 0), 255)::INT AS q FROM sm), h AS (SELECT image_id, q AS bin, count(*) AS n FROM qx GROUP BY 1, 2)""" + C._RUN + """, sc AS (SELECT image_id, bin, round(w0 * (wa - w0) * (s0 / w0 - (sa - s0) / (wa - w0)) * (s0 / w0 - (sa - s0) / (wa - w0)), 6) AS score FROM r WHERE wa > w0), best AS (SELECT image_id, max(score) AS score FROM sc GROUP BY 1), cut AS MATERIALIZED (SELECT b.image_id, min(sc.bin) AS t FROM best b JOIN sc ON sc.image_id = b.image_id AND sc.score = b.score GROUP BY 1),
mx AS MATERIALIZED (SELECT qx.image_id, y, x, v FROM qx JOIN cut USING (image_id) WHERE q > t), rr AS (SELECT image_id, y, x, y * 8 + x AS root FROM mx UNION SELECT n.image_id, n.y, n.x, rr.root FROM rr JOIN mx n ON n.image_id = rr.image_id AND abs(n.y - rr.y) + abs(n.x - rr.x) = 1 WHERE rr.root < n.y * 8 + n.x), lab AS (SELECT image_id, y, x, v, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM (SELECT image_id, y, x, min(root) AS root FROM rr GROUP BY 1, 2, 3) JOIN mx USING (image_id, y, x)), """
C.register("smooth_threshold_label_measure", lambda spark, sf: C.rounded(C.flagship(spark, sf)), _OTSU + _TABLE)
SQL["moments"] = _FULL + " SELECT image_id, label, " + ", ".join(f"sum(pow(y, {i}) * pow(x, {j}))::DOUBLE AS m_{i}_{j}" for i in range(4) for j in range(4) if i + j <= 3) + " FROM lab WHERE label > 0 GROUP BY 1, 2"
SQL["region_moments"] = SQL["region_moments_weighted"].replace("px.v + 1 AS w", "1::DOUBLE AS w")
_M = f"WITH {T.PX}, t AS (SELECT image_id, y::DOUBLE AS y, x::DOUBLE AS x, v + 1 AS w FROM px), c AS (SELECT image_id, sum(w) AS m, sum(w * y) / sum(w) AS cy, sum(w * x) / sum(w) AS cx FROM t GROUP BY 1), d AS (SELECT image_id, m, w, y - cy AS a, x - cx AS b FROM t JOIN c USING (image_id)), n AS (SELECT image_id, " + ", ".join(f"sum(w * pow(a, {i}) * pow(b, {j})) / pow(abs(any_value(m)), {(i + j) / 2 + 1}) AS nu_{i}_{j}" for i in range(4) for j in range(4) if 2 <= i + j <= 3) + " FROM d GROUP BY 1)"
SQL["moments_hu"] = _M + SQL["region_moments_weighted"].split("FROM g),\n")[1].join([",\n", ""]).split("SELECT image_id, label")[0] + " SELECT image_id, 0 AS y, k.x::INT AS x, round([" + ", ".join(f"hu_{k}" for k in range(7)) + "][k.x + 1], 6) + 0.0 AS v FROM i, range(0, 7) AS k(x)"

# Signals -----------------------------------------------------------------------------------------------

_SIGNAL = "SELECT image_id, t::INT AS t, round({0}, 6) + 0.0 AS v FROM {1}"
SQL["oaconvolve"] = f"WITH {C._S} SELECT d.image_id, d.t, round(0.5 * d.v + 0.25 * coalesce(a.v, 0) + 0.25 * coalesce(b.v, 0), 6) + 0.0 AS v FROM d LEFT JOIN d a ON a.image_id = d.image_id AND a.t = d.t - 1 LEFT JOIN d b ON b.image_id = d.image_id AND b.t = d.t + 1"
_K720 = "k AS MATERIALIZED (SELECT e.k AS e, sum(CASE WHEN u.k IN (0, 360) THEN 1 ELSE 2 END * sin(2 * pi() * u.k * e.k / 720)) / 720 AS s FROM range(0, 361) AS u(k), range(0, 720) AS e(k) GROUP BY 1)"
SQL["hilbert_envelope"] = f"WITH {C._S}, {_K720}, w AS MATERIALIZED (SELECT * FROM d WHERE v <> 0), h AS (SELECT w.image_id, g.t AS t, sum(w.v * k.s) AS s FROM w CROSS JOIN range(0, 720) AS g(t) JOIN k ON k.e = (g.t - w.t + 720) % 720 GROUP BY 1, 2) SELECT d.image_id, d.t, round(sqrt(d.v * d.v + coalesce(h.s, 0) * coalesce(h.s, 0)), 6) + 0.0 AS v FROM d LEFT JOIN h USING (image_id, t)"
# Half as many samples: frequencies to 179, the one at 180 from its negative half alone, read at even places.
SQL["resample"] = f"WITH {C._S}, k AS MATERIALIZED (SELECT e.k AS e, (sum(CASE WHEN u.k = 0 THEN 1 WHEN u.k = 180 THEN 2 ELSE 2 END * cos(2 * pi() * u.k * e.k / 720))) / 720 AS s FROM range(0, 181) AS u(k), range(0, 720) AS e(k) GROUP BY 1), w AS MATERIALIZED (SELECT * FROM d WHERE v <> 0), h AS (SELECT w.image_id, g.t AS t, sum(w.v * k.s) AS s FROM w CROSS JOIN range(0, 360) AS g(t) JOIN k ON k.e = (2 * g.t - w.t + 720) % 720 GROUP BY 1, 2), u3 AS (SELECT DISTINCT image_id FROM d) SELECT u3.image_id, g.t::INT AS t, round(coalesce(h.s, 0), 6) + 0.0 AS v FROM u3 CROSS JOIN range(0, 360) AS g(t) LEFT JOIN h ON h.image_id = u3.image_id AND h.t = g.t"
_I0 = "list_sum(list_transform(range(0, 30), lambda k: pow({0} / 2, 2 * k) / pow(factorial(k::INT)::DOUBLE, 2)))"
_SINC3 = "CASE WHEN j = 30 THEN 1 ELSE sin(pi() * (j - 30) / 3) / (pi() * (j - 30) / 3) END"
SQL["resample_poly"] = f"WITH {C._S}, raw AS MATERIALIZED (SELECT a.k AS j, ({_SINC3.replace('j', 'a.k')}) * {_I0.format('(5 * sqrt(greatest(1 - pow((a.k - 30) / 30.0::DOUBLE, 2), 0)))')} AS h FROM range(0, 61) AS a(k)), k AS MATERIALIZED (SELECT j, 2 * h / (SELECT sum(h) FROM raw) AS h FROM raw), w AS MATERIALIZED (SELECT * FROM d WHERE v <> 0), c AS (SELECT w.image_id, (2 * w.t + k.j - 30) // 3 AS t, sum(w.v * k.h) AS s FROM w CROSS JOIN k WHERE (2 * w.t + k.j - 30) % 3 = 0 GROUP BY 1, 2), u3 AS (SELECT DISTINCT image_id FROM d) SELECT u3.image_id, g.t::INT AS t, round(coalesce(c.s, 0), 6) + 0.0 AS v FROM u3 CROSS JOIN range(0, 480) AS g(t) LEFT JOIN c ON c.image_id = u3.image_id AND c.t = g.t"

# Colours ---------------------------------------------------------------------------------------------

color, F = C.color, C.F


def _three(name: str, source: str, *values: str, names: str = "rgb") -> str:
    return f"{name} AS MATERIALIZED (SELECT l_suppkey, {', '.join(f'({v})::DOUBLE AS {n}' for v, n in zip(values, names))} FROM {source})"


def _times(matrix, names: str = "rgb", add=(0, 0, 0)) -> list[str]:
    return [" + ".join(f"{float(w)!r}::DOUBLE * {n}" for w, n in zip(row, names)) + f" + {float(s)!r}::DOUBLE" for row, s in zip(matrix, add)]


def _inverse(matrix) -> list[list[float]]:
    return W._dense(W.solved([dict(enumerate(row)) for row in matrix], 3), 3)


def _colours(*ctes: str, last: str) -> str:
    return f"WITH {', '.join([C._RGB, *ctes])}, o AS (SELECT l_suppkey, {', '.join(f'{n} AS c{k}' for k, n in enumerate('rgb'))} FROM {last}) {C._MEAN}"


for _name, _back, _matrix, _off in (("yuv2rgb", color.yuv2rgb, color.YUV_FROM_RGB, None), ("yiq2rgb", color.yiq2rgb, color.YIQ_FROM_RGB, None), ("ypbpr2rgb", color.ypbpr2rgb, color.YPBPR_FROM_RGB, None), ("ycbcr2rgb", color.ycbcr2rgb, color.YCBCR_FROM_RGB, (16, 128, 128)), ("ydbdr2rgb", color.ydbdr2rgb, color.YDBDR_FROM_RGB, None)):
    _inv = _inverse(_matrix)
    C.on_colours(_name, _back, _colours(_three("m", "c", *_times(_inv, add=[-sum(w * o for w, o in zip(row, _off or (0, 0, 0))) for row in _inv])), last="m"))
_GAMMA = [f"least(greatest(CASE WHEN {n} > 0.0031308 THEN 1.055 * pow(greatest({n}, 0), 1 / 2.4::DOUBLE) - 0.055 ELSE {n} * 12.92 END, 0), 1)" for n in "rgb"]
_LINEAR = [f"CASE WHEN {n} > 0.04045 THEN pow(({n} + 0.055) / 1.055, 2.4) ELSE {n} / 12.92 END" for n in "rgb"]
_FROM_XYZ = lambda source: [_three("lin", source, *_times(_inverse(color.XYZ_FROM_RGB))), _three("gam", "lin", *_GAMMA)]
_TO_XYZ = [_three("lin", "c", *_LINEAR), _three("xyz", "lin", *_times(color.XYZ_FROM_RGB))]
C.on_colours("xyz2rgb", color.xyz2rgb, _colours(*_FROM_XYZ("c"), last="gam"))
C.on_colours("rgb2rgbcie", color.rgb2rgbcie, _colours(*_TO_XYZ, _three("m", "xyz", *_times(color.RGB_CIE_FROM_XYZ)), last="m"))
C.on_colours(
    "rgbcie2rgb",
    lambda x: color.rgbcie2rgb(color.triple(x["a"] / 5, x["b"] / 5, x["c"] / 5)),
    _colours(_three("s", "c", "r / 5", "g / 5", "b / 5"), _three("m", "s", *_times(_inverse(color.RGB_CIE_FROM_XYZ))), *_FROM_XYZ("m"), last="gam"),
)
_HUE = "floor(r * 6)"
_P, _Q, _U = "b * (1 - g)", f"b * (1 - (r * 6 - {_HUE}) * g)", f"b * (1 - (1 - (r * 6 - {_HUE})) * g)"
_SEXTANTS = (("b", _U, _P), (_Q, "b", _P), (_P, "b", _U), (_P, _Q, "b"), (_U, _P, "b"), ("b", _P, _Q))
_HSV2RGB = [f"CASE {_HUE}::INT % 6 " + " ".join(f"WHEN {k} THEN {row[c]}" for k, row in enumerate(_SEXTANTS)) + " END" for c in range(3)]
C.on_colours("hsv2rgb", color.hsv2rgb, _colours(_three("m", "c", *_HSV2RGB), last="m"))
C.on_colours("convert_colorspace", lambda x: color.convert_colorspace(x, "HSV", "YUV"), _colours(_three("m", "c", *_HSV2RGB), _three("n", "m", *_times(color.YUV_FROM_RGB)), last="n"))
_TO_HSV = C._HSV.replace("AS c0", "AS r").replace("AS c1", "AS g").replace("hi AS c2 FROM h", "hi AS b FROM h").replace("o AS (", "hsv AS (")
C.on_colours("adapt_rgb_hsv_value", lambda x: color.adapt_rgb(x, lambda v: v * v, "hsv_value"), _colours(_TO_HSV, _three("w", "hsv", "r", "g", "b * b"), _three("m", "w", *_HSV2RGB), last="m"))
_WX, _WY, _WZ = color.WHITE["D65", "2"]
_U0, _V0 = 4 * _WX / (_WX + 15 * _WY + 3 * _WZ), 9 * _WY / (_WX + 15 * _WY + 3 * _WZ)
_LUM = f"(CASE WHEN g / {_WY!r}::DOUBLE > 0.008856 THEN 116 * cbrt(g / {_WY!r}::DOUBLE) - 16 ELSE 903.3 * g / {_WY!r}::DOUBLE END)"
C.on_colours(
    "rgb2luv",
    color.rgb2luv,
    _colours(*_TO_XYZ, _three("m", "xyz", _LUM, f"13 * {_LUM} * (4 * r / (r + 15 * g + 3 * b + 2.220446049250313e-16) - {_U0!r}::DOUBLE)", f"13 * {_LUM} * (9 * g / (r + 15 * g + 3 * b + 2.220446049250313e-16) - {_V0!r}::DOUBLE)"), last="m"),
)
_WIDE = lambda x: color.triple(x["a"] * 100, x["b"] * 100 - 25, x["c"] * 100 - 40)
_WIDE_SQL = _three("s", "c", "r * 100", "g * 100 - 25", "b * 100 - 40")
_CUBE = lambda t: f"(CASE WHEN {t} > 0.2068966 THEN pow({t}, 3) ELSE ({t} - 16.0 / 116) / 7.787 END)"
_LAB_XYZ = _three("xyz", "s", f"{_CUBE('(g / 500 + (r + 16) / 116)')} * {_WX!r}::DOUBLE", f"{_CUBE('((r + 16) / 116)')} * {_WY!r}::DOUBLE", f"{_CUBE('greatest((r + 16) / 116 - b / 200, 0)')} * {_WZ!r}::DOUBLE")
C.on_colours("lab2rgb", lambda x: color.let(_WIDE(x), color.lab2rgb), _colours(_WIDE_SQL, _LAB_XYZ, *_FROM_XYZ("xyz"), last="gam"))
C.on_colours("lab2xyz", lambda x: color.let(_WIDE(x), lambda y: color.lab2xyz(y)), _colours(_WIDE_SQL, _LAB_XYZ, last="xyz"))
_LUV_XYZ = [_three("uv", "s", f"CASE WHEN r > 7.999625 THEN pow((r + 16) / 116, 3) ELSE r / 903.3 END * {_WY!r}::DOUBLE", f"{_U0!r}::DOUBLE + g / (13 * r + 2.220446049250313e-16)", f"{_V0!r}::DOUBLE + b / (13 * r + 2.220446049250313e-16)"), _three("xyz", "uv", "9 * r * g / (4 * b)", "r", "r * (12 - 3 * g - 20 * b) / (4 * b)")]
_LUV_IN = lambda x: color.triple(x["a"] * 100, x["b"] * 20 - 5, x["c"] * 20 - 8)
_LUV_SQL = _three("s", "c", "r * 100", "g * 20 - 5", "b * 20 - 8")
C.on_colours("luv2rgb", lambda x: color.let(_LUV_IN(x), color.luv2rgb), _colours(_LUV_SQL, *_LUV_XYZ, *_FROM_XYZ("xyz"), last="gam"))
C.on_colours(
    "lab2lch",
    lambda x: color.let(_WIDE(x), color.lab2lch),
    _colours(_WIDE_SQL, _three("m", "s", "r", "sqrt(g * g + b * b)", "CASE WHEN atan2(b, g) < 0 THEN atan2(b, g) + 2 * pi() ELSE atan2(b, g) END"), last="m"),
)
C.on_colours("lch2lab", lambda x: color.lch2lab(color.triple(x["a"] * 100, x["b"] * 100, x["c"] * 7)), _colours(_three("m", "c", "r * 100", "g * 100 * cos(b * 7)", "g * 100 * sin(b * 7)"), last="m"))
_DENS = [f"ln(greatest({n}, 1e-6)) / ln(1e-6)" for n in "rgb"]
_UNMIX = [[row[j] for row in _inverse(color.RGB_FROM_HED)] for j in range(3)]
C.on_colours("rgb2hed", color.rgb2hed, _colours(_three("d", "c", *_DENS), _three("m", "d", *_times(_UNMIX)), last="m"))
_MIX = [[row[j] for row in color.RGB_FROM_HED] for j in range(3)]
C.on_colours(
    "hed2rgb",
    lambda x: color.hed2rgb(color.triple(x["a"] / 10, x["b"] / 10, x["c"] / 10)),
    _colours(_three("s", "c", "r / 10", "g / 10", "b / 10"), _three("m", "s", *[f"least(greatest(exp(ln(1e-6) * ({v})), 0), 1)" for v in _times(_MIX)]), last="m"),
)
C.on_colours(
    "rgba2rgb",
    lambda x: color.rgba2rgb(x, x["c"], (0.2, 0.5, 1.0)),
    _colours(_three("m", "c", *[f"least(greatest((1 - b) * {bg}::DOUBLE + b * {n}, 0), 1)" for n, bg in zip("rgb", (0.2, 0.5, 1.0))]), last="m"),
)
_GRAY_SQL = "0.2125::DOUBLE * r + 0.7154::DOUBLE * g + 0.0721::DOUBLE * b"
for _name, _gray, _wide in (("rgb2gray", color.rgb2gray, color.gray2rgb), ("rgb2grey", color.rgb2grey, color.grey2rgb)):
    C.on_colours(_name, lambda x, a=_gray, b=_wide: color.let(a(x), b), _colours(_three("m", "c", _GRAY_SQL, _GRAY_SQL, _GRAY_SQL), last="m"))
C.on_colours("gray2rgba", lambda x: color.let(color.gray2rgba(x["a"], x["b"]), lambda y: color.triple(y["a"], y["c"], y["alpha"])), _colours(_three("m", "c", "r", "r", "g"), last="m"))
C.on_colours(
    "get_xyz_coords",
    lambda x: color.let(color.rgb2xyz(x), lambda y: color.triple(*[y[k] / w for k, w in zip("abc", color.get_xyz_coords("d50", "10"))])),
    _colours(*_TO_XYZ, _three("m", "xyz", "r / 0.9672062750333777", "g", "b / 0.8142801513128616"), last="m"),
)
_PAL = ", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for k, (a, b, c) in enumerate([(1, 0, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 0.502, 0), (0.294, 0, 0.51), (1, 0.549, 0), (0, 1, 1), (1, 0.753, 0.796), (0.604, 0.804, 0.196)]))
SQL["label2rgb"] = _FULL + f", pal(k, r, g, b) AS (VALUES {_PAL}) SELECT image_id, y, x, " + ", ".join(f"round(CASE WHEN label = 0 THEN (v + 1) / 2 ELSE 0.3::DOUBLE * {c} + 0.7::DOUBLE * (v + 1) / 2 END, 6) AS {n}" for c, n in zip("rgb", "abc")) + " FROM lab LEFT JOIN pal ON pal.k = (label - 1) % 10"
_H1, _H2 = (f"(CASE WHEN {a} = 0 AND {b} = 0 THEN 0 WHEN atan2({b}, {a}) < 0 THEN atan2({b}, {a}) + 2 * pi() ELSE atan2({b}, {a}) END)" for a, b in (("ap1", "b1"), ("ap2", "b2")))
_DELTA = f"""WITH t AS (SELECT l_suppkey, l_quantity / 50 AS q, abs(l_discount) * 10 AS d, abs(l_tax) * 10 AS t FROM lineitem),
a AS (SELECT l_suppkey, q * 100 AS l1, d * 200 - 100 AS a1, t * 200 - 100 AS b1, (1 - q) * 100 AS l2, t * 200 - 100 AS a2, d * 200 - 100 AS b2 FROM t),
k AS (SELECT *, sqrt(a1 * a1 + b1 * b1) AS c1, sqrt(a2 * a2 + b2 * b2) AS c2, CASE WHEN atan2(b1, a1) < 0 THEN degrees(atan2(b1, a1)) + 360 ELSE degrees(atan2(b1, a1)) END AS h1 FROM a),
m AS (SELECT *, 2 * (c1 * c2 - (a1 * a2 + b1 * b2)) AS dh2, 1 + 0.5 * (1 - sqrt(pow((c1 + c2) / 2, 7) / (pow((c1 + c2) / 2, 7) + pow(25.0::DOUBLE, 7)))) AS gg FROM k),
n AS (SELECT *, a1 * gg AS ap1, a2 * gg AS ap2, CASE WHEN h1 BETWEEN 164 AND 345 THEN 0.56 + 0.2 * abs(cos(radians(h1 + 168))) ELSE 0.36 + 0.4 * abs(cos(radians(h1 + 35))) END AS ct, sqrt(pow(c1, 4) / (pow(c1, 4) + 1900)) AS cf, CASE WHEN l1 < 16 THEN 0.511 ELSE 0.040975 * l1 / (1 + 0.01765 * l1) END AS csl, 0.638 + 0.0638 * c1 / (1 + 0.0131 * c1) AS csc FROM m),
p AS (SELECT *, sqrt(ap1 * ap1 + b1 * b1) AS cp1, sqrt(ap2 * ap2 + b2 * b2) AS cp2, {_H1} AS hp1, {_H2} AS hp2 FROM n),
r AS (SELECT *, CASE WHEN cp1 * cp2 = 0 THEN 0 WHEN hp2 - hp1 > pi() THEN hp2 - hp1 - 2 * pi() WHEN hp2 - hp1 < -pi() THEN hp2 - hp1 + 2 * pi() ELSE hp2 - hp1 END AS dh, CASE WHEN cp1 * cp2 = 0 THEN hp1 + hp2 WHEN abs(hp2 - hp1) <= pi() THEN (hp1 + hp2) / 2 WHEN hp1 + hp2 < 2 * pi() THEN (hp1 + hp2) / 2 + pi() ELSE (hp1 + hp2) / 2 - pi() END AS hm, (cp1 + cp2) / 2 AS cm, (l1 + l2) / 2 AS lm FROM p),
s AS (SELECT *, (l2 - l1) / (1 + 0.015 * (lm - 50) * (lm - 50) / sqrt(20 + (lm - 50) * (lm - 50))) AS x, (cp2 - cp1) / (1 + 0.045 * cm) AS y, 2 * sqrt(cp1 * cp2) * sin(dh / 2) / (1 + 0.015 * cm * (1 - 0.17 * cos(hm - pi() / 6) + 0.24 * cos(2 * hm) + 0.32 * cos(3 * hm + pi() / 30) - 0.2 * cos(4 * hm - 63 * pi() / 180))) AS z, -2 * sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25.0::DOUBLE, 7))) * sin(radians(60 * exp(-pow((degrees(hm) - 275) / 25, 2)))) AS rt FROM r)
SELECT l_suppkey, round(avg(sqrt((l1 - l2) * (l1 - l2) + (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2))), 6) AS cie76,
 round(avg(sqrt(greatest((l1 - l2) * (l1 - l2) + pow((c1 - c2) / (1 + 0.045 * c1), 2) + dh2 / pow(1 + 0.015 * c1, 2), 0))), 6) AS ciede94, round(avg(sqrt(greatest(x * x + y * y + z * z + rt * y * z, 0))), 6) AS ciede2000,
 round(avg(sqrt(greatest(pow((l1 - l2) / csl, 2) + pow((c1 - c2) / csc, 2) + dh2 / pow(csc * (cf * ct + 1 - cf), 2), 0))), 6) AS cmc FROM s GROUP BY 1"""
SQL["delta_e"] = _DELTA
C.register("get_dH2", C.hue_differences, _DELTA.split("SELECT l_suppkey, round(avg(sqrt((l1")[0] + "SELECT l_suppkey, round(avg(dh2), 6) + 0.0 AS dh2 FROM s GROUP BY 1")
