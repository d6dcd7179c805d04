"""Queries of single functions: transforms and fits, footprints, unitary spectra, level sets, grids, registration."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, filters, geometry, interpolate, morphology, scalar, signal, vision
from ..operators import fits, regions, shapes, views
from ..operators.runtime import map_images, map_pairs, pixels
from ..sources.images import embedding_images
from . import catalog as C
from . import extras  # noqa: F401  registers what is built upon here
from . import twins as T
from . import weights as W

SQL = C.ORACLE_SQL

# Filters and edges ------------------------------------------------------------------------

_second = lambda x, axis, mode, cval: filters.correlate1d(x, [1, -2, 1], axis, mode, cval)
C.on_images("generic_laplace", lambda x: filters.generic_laplace(x, _second), SQL["laplace"])
_sobel = lambda x, axis, mode, cval: filters.sobel(x, axis - 1, mode, cval)
_DIFF, _TRI, _SAME = [-1, 0, 1], [1, 2, 1], [{k: 1.0} for k in range(8)]
C.on_images(
    "generic_gradient_magnitude",
    lambda x: filters.generic_gradient_magnitude(x, _sobel),
    T.two(W.both("px", "a", W.taps(_DIFF), W.taps(_TRI)), W.both("px", "b", W.taps(_TRI), W.taps(_DIFF)), "sqrt(a.v * a.v + b.v * b.v)"),
)
_FE, _FS = list(filters.FARID_EDGE), list(filters.FARID_SMOOTH)
C.on_images("farid_h", filters.farid_h, W.separable(W.taps(_FE), W.taps(_FS)))
C.on_images("farid_v", filters.farid_v, W.separable(W.taps(_FS), W.taps(_FE)))
C.on_images("roberts_pos_diag", filters.roberts_pos_diag, T.linear([(1, 1, 1), (0, 0, -1)]))
C.on_images("roberts_neg_diag", filters.roberts_neg_diag, T.linear([(1, 0, 1), (0, 1, -1)]))
_SD = math.sqrt(math.log(2) / 2) / math.pi * 3 / 0.45
_R = math.ceil(3 * _SD)
C.on_images(
    "gabor_kernel",
    lambda x: filters.correlate(x, filters.gabor_kernel(0.45).imag),
    T.linear([(a, b, math.exp(-0.5 * (a * a + b * b) / _SD**2) / (2 * math.pi * _SD**2) * math.sin(2 * math.pi * 0.45 * b)) for a in range(-_R, _R + 1) for b in range(-_R, _R + 1)]),
)
C.on_images(
    "window",
    lambda x: x * signal.window_nd("hann", x.shape[1:]),
    f"WITH {T.PX} SELECT image_id, y, x, round(v * (0.5 - 0.5 * cos(2 * pi() * y / 7)) * (0.5 - 0.5 * cos(2 * pi() * x / 7)), 6) + 0.0 AS v FROM px",
)


def _corner_peaks(spark: SparkSession, sf: str) -> DataFrame:
    def kernel(x):
        out = np.zeros_like(x)
        for k, at in enumerate(vision.corner_peaks(x, 1)):
            out[k][tuple(at.T)] = 1
        return out

    return pixels(map_images(embedding_images(spark, sf).select("image_id", "shape", "img"), kernel)).where("v > 0").select("image_id", "y", "x")


C.register(
    "corner_peaks",
    _corner_peaks,
    f"WITH {T.PX} SELECT p.image_id, p.y, p.x FROM px p JOIN px q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 WHERE p.y BETWEEN 1 AND 6 AND p.x BETWEEN 1 AND 6 GROUP BY p.image_id, p.y, p.x, p.v HAVING p.v = max(q.v) AND p.v > (SELECT min(v) FROM px l WHERE l.image_id = p.image_id)",
)

# Grids, lines, integrals, pyramids -----------------------------------------------------------

C.on_images("spline_filter1d", lambda x: interpolate.spline_filter1d(x, 3, 1), W.separable(W.coefficients(), _SAME))
_KNOTS = (0.0, 1.0, 2.5, 4.0, 5.0, 7.0, 9.0, 12.0)
_XI = [(0.0, 0.0), (0.4, 2.6), (2.5, 11.9), (6.1, 4.4), (12.0, 12.0), (11.0, 0.3), (4.49, 5.01), (3.3, 8.2)]


def _on_grid(method: str, call):
    """A kernel: values on uneven knots, read at fixed points, one row per image."""
    return lambda x: np.moveaxis(call([_KNOTS, _KNOTS], np.moveaxis(x, 0, -1), np.array(_XI), method), -1, 0)[:, None, :]


def _grid_sql(method: str) -> str:
    def one(q: float) -> list[tuple[int, float]]:
        i = max(k for k in range(7) if _KNOTS[k] < q or k == 0)
        f = (q - _KNOTS[i]) / (_KNOTS[i + 1] - _KNOTS[i])
        return [(i if f <= 0.5 else i + 1, 1.0)] if method == "nearest" else [(i, 1 - f), (i + 1, f)]

    cells = ", ".join(f"({k}, {i}, {j}, {a * b!r}::DOUBLE)" for k, (p, q) in enumerate(_XI) for i, a in one(p) for j, b in one(q))
    return f"WITH {T.PX} SELECT image_id, 0 AS y, c.k AS x, round(sum(c.w * v), 6) + 0.0 AS v FROM px JOIN (VALUES {cells}) AS c(k, i, j, w) ON c.i = y AND c.j = px.x GROUP BY ALL"


_interpolator = lambda p, v, xi, method: interpolate.RegularGridInterpolator(p, v, method)(xi)
for _name, _method, _call in (("RegularGridInterpolator", "linear", _interpolator), ("RegularGridInterpolator_nearest", "nearest", _interpolator), ("interpn", "linear", interpolate.interpn), ("interpn_nearest", "nearest", interpolate.interpn)):
    C.on_images(_name, _on_grid(_method, _call), _grid_sql(_method))
C.on_images(
    "profile_line",
    lambda x: interpolate.profile_line(x, (1, 1), (6, 4), 1, 1)[:, None, :],
    W.picture(W.points("f", f"SELECT 0 AS y, k::INT AS x, 1 + 5.0 * k / {math.ceil(math.hypot(5, 3) + 1) - 1} AS sy, 1 + 3.0 * k / {math.ceil(math.hypot(5, 3) + 1) - 1} AS sx FROM range(0, {math.ceil(math.hypot(5, 3) + 1)}) AS g(k)"), source="f"),
)
C.on_images(
    "pyramid_gaussian",
    lambda x: list(interpolate.pyramid_gaussian(x, 2))[2],
    W.separable(W.chained(W.chained(W.taps(W.bell(2 / 3)), W.tent([2 * o + 0.5 for o in range(4)], mode="reflect")), W.taps(W.bell(2 / 3), 4), W.tent([2 * o + 0.5 for o in range(2)], 4, "reflect"))),
)
C.on_images("get_pyramid", lambda x: vision.get_pyramid(x, 2.0, 10, 3)[0], SQL["pyramid_reduce"])
C.on_images(
    "warp_coords",
    lambda x: interpolate.map_coordinates(x, interpolate.warp_coords(lambda p: p[:, ::-1] * 0.9, (8, 8)), 1, "constant"),
    W.picture(W.points("f", f"SELECT y, x, 0.9::DOUBLE * x AS sy, 0.9::DOUBLE * y AS sx FROM {W.GRID}"), source="f"),
)


def _integrate(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over a window of each image from its integral image."""
    rows = regions.integral_image(C.image_pixels(spark, sf)).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "integral"))), lambda p: p["integral"]).alias("s"))
    windows = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("r0", "c0", "r1", "c1"), w)]) for w in ((0, 0, 7, 7), (2, 3, 5, 6), (0, 4, 3, 4))]))
    one = rows.select("image_id", "s", windows.alias("w"))
    w = F.col("w")
    return one.select("image_id", w["r0"].alias("r0"), w["c0"].alias("c0"), (F.round(geometry.integrate(F.col("s"), 8, w["r0"], w["c0"], w["r1"], w["c1"]), 6) + F.lit(0.0)).alias("total"))


C.register(
    "integrate",
    _integrate,
    f"WITH {T.PX} SELECT image_id, r0, c0, round(sum(v), 6) + 0.0 AS total FROM px JOIN (VALUES (0, 0, 7, 7), (2, 3, 5, 6), (0, 4, 3, 4)) AS w(r0, c0, r1, c1) ON y BETWEEN r0 AND r1 AND x BETWEEN c0 AND c1 GROUP BY ALL",
)

# Unitary spectra -----------------------------------------------------------------------------------

_both = lambda z: z.real - z.imag  # noqa: E731  one number that both parts enter
_GO, _BACK = "cos({0}) + sin({0})", "cos({0}) - sin({0})"


def _dft(wave: str, weight: str = "1", width: int = 8, columns: int = 8) -> str:
    turn = "(2 * pi() * (c.y * q.y + c.x * q.x) / 8)"
    return f"WITH {T.PX}, c AS (SELECT a.k::INT AS y, b.k::INT AS x FROM range(0, 8) AS a(k), range(0, {width}) AS b(k)) SELECT q.image_id, c.y, c.x, round(sum(q.v * ({weight}) * ({wave.format(turn)})) / 8, 6) + 0.0 AS v FROM px q CROSS JOIN c WHERE q.x < {columns} GROUP BY ALL"


for _name, _kernel, _text in (
    ("ufftn", lambda x: _both(signal.ufftn(x)), _dft(_GO)), ("ufft2", lambda x: _both(signal.ufft2(x)), _dft(_GO)),
    ("uifftn", lambda x: _both(signal.uifftn(x)), _dft(_BACK)), ("uifft2", lambda x: _both(signal.uifft2(x)), _dft(_BACK)),
    ("urfftn", lambda x: _both(signal.urfftn(x)), _dft(_GO, width=5)), ("urfft2", lambda x: _both(signal.urfft2(x)), _dft(_GO, width=5)),
    ("uirfftn", lambda x: signal.uirfftn(x[:, :, :5], (8, 8)), _dft("cos({0})", "CASE WHEN q.x IN (0, 4) THEN 1 ELSE 2 END", columns=5)), ("uirfft2", lambda x: signal.uirfft2(x[:, :, :5], (8, 8)), _dft("cos({0})", "CASE WHEN q.x IN (0, 4) THEN 1 ELSE 2 END", columns=5)),
):
    C.on_images(_name, _kernel, _text)
C.per_image("image_quad_norm", lambda x: signal.image_quad_norm(signal.ufftn(x)), f"WITH {T.PX} SELECT image_id, 0 AS y, 0 AS x, round(sum(v * v), 6) + 0.0 AS v FROM px GROUP BY 1")
C.on_images("laplacian", lambda x: signal.through_fft(x, lambda s: s * signal.laplacian(2, (8, 8))[0]), T.linear([(0, 0, 4), (-1, 0, -1), (1, 0, -1), (0, -1, -1), (0, 1, -1)], "wrap"))
_IR = [[0.0, 0.1, 0.0], [0.3, 0.4, 0.2], [0.0, 0.0, 0.1]]
C.on_images(
    "ir2tf",
    lambda x: signal.through_fft(x, lambda s: s * signal.ir2tf(np.array(_IR), (8, 8))),
    T.linear([(1 - a, 1 - b, w) for a, row in enumerate(_IR) for b, w in enumerate(row) if w], "wrap"),
)
C.on_images("choose_conv_method", lambda x: signal.convolve(x, np.ones((3, 3)), "same", signal.choose_conv_method(x, np.ones((3, 3)))), T.linear(T.ONE, "constant"))

# Footprints ----------------------------------------------------------------------------------------

m = morphology
_cells = lambda test, r: [(a, b, 1) for a in range(-r, r + 1) for b in range(-r, r + 1) if test(a, b)]
for _name, _shape, _taps in (
    ("square", m.square(3), _cells(lambda a, b: True, 1)), ("rectangle", m.rectangle(1, 5), [(0, b, 1) for b in range(-2, 3)]), ("diamond", m.diamond(2), _cells(lambda a, b: abs(a) + abs(b) <= 2, 2)),
    ("disk", m.disk(2), _cells(lambda a, b: a * a + b * b <= 4, 2)), ("octagon", m.octagon(3, 2), _cells(lambda a, b: abs(a) + abs(b) <= 4 and max(abs(a), abs(b)) <= 3, 3)),
    ("generate_binary_structure", m.generate_binary_structure(2, 2), _cells(lambda a, b: True, 1)), ("iterate_structure", m.iterate_structure(m.generate_binary_structure(2, 1), 3), _cells(lambda a, b: abs(a) + abs(b) <= 3, 3)), ("default_selem", m.default_selem(2), _cells(lambda a, b: abs(a) + abs(b) <= 1, 1)),
    ("pad_for_eccentric_selems", m.pad_for_eccentric_selems(np.ones((2, 3), bool)), [(a, b, 1) for a in (0, 1) for b in (-1, 0, 1)]),
):
    C.on_images(
        _name,
        lambda x,
        s=_shape: m.grey_dilation(x, footprint=s),
        T.chain("max", taps=[(a, b, w) for a, b, w in _taps] if _name != "pad_for_eccentric_selems" else [(-a, b, w) for a, b, w in _taps]),
    )


def _volumes(name: str, kernel, reach: str) -> None:
    """The embeddings as 4x4x4 volumes: a dilation by a 3-D footprint, by flat place."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        cubes = embedding_images(spark, sf).select("image_id", F.array(F.lit(4), F.lit(4), F.lit(4)).alias("shape"), "img")
        return map_images(cubes, kernel).select("image_id", F.posexplode("img").alias("p", "_v")).select("image_id", "p", (F.round("_v", 6) + F.lit(0.0)).alias("v"))

    C.register(
        name,
        query,
        f"WITH c AS (SELECT image_id, y * 8 + x AS p, (y * 8 + x) // 16 AS a, ((y * 8 + x) // 4) % 4 AS b, (y * 8 + x) % 4 AS c, v FROM (WITH {T.PX} SELECT * FROM px)) SELECT p.image_id, p.p::INT AS p, round(max(q.v), 6) + 0.0 AS v FROM c p JOIN c q ON q.image_id = p.image_id AND {reach} GROUP BY 1, 2",
    )


_A, _B, _D = "abs(q.a - p.a)", "abs(q.b - p.b)", "abs(q.c - p.c)"
_volumes("cube", lambda x: m.grey_dilation(x, footprint=m.cube(3)), f"greatest({_A}, {_B}, {_D}) <= 1")
_volumes("octahedron", lambda x: m.grey_dilation(x, footprint=m.octahedron(1)), f"{_A} + {_B} + {_D} <= 1")
_volumes("ball", lambda x: m.grey_dilation(x, footprint=m.ball(1)), f"{_A} * {_A} + {_B} * {_B} + {_D} * {_D} <= 1")

# Level sets ---------------------------------------------------------------------------------------------

_DISK = "CASE WHEN 3 - sqrt((y - 3.5) * (y - 3.5) + (x - 3.5) * (x - 3.5)) > 0 THEN v ELSE 0 END"
for _name, _set in (("disk_level_set", vision.disk_level_set), ("circle_level_set", vision.circle_level_set)):
    C.on_images(_name, lambda x, s=_set: x * s(x.shape[1:]), f"WITH {T.PX} SELECT image_id, y, x, round({_DISK}, 6) + 0.0 AS v FROM px")
C.on_images(
    "checkerboard_level_set",
    lambda x: x * vision.checkerboard_level_set(x.shape[1:], 3),
    f"WITH {T.PX} SELECT image_id, y, x, round(CASE WHEN (y // 3 + x // 3) % 2 = 1 THEN v ELSE 0 END, 6) + 0.0 AS v FROM px",
)
from .extras import _INVERSE, _curve  # noqa: E402

C.on_images("sup_inf", vision.sup_inf, W.picture(_curve("px", "f", "min", "greatest"), source="f"))
C.on_images("inf_sup", vision.inf_sup, W.picture(_curve("px", "f", "max", "least"), source="f"))
C.on_images("inverse_gaussian_gradient", lambda x: vision.inverse_gaussian_gradient(x, 10, 1), W.picture(_INVERSE, source="gg"))

# Types and values -------------------------------------------------------------------------------------------

C._scalars(
    "img_as_float",
    lambda a,
    b: {"whole": scalar.img_as_float(F.floor(a * 255).cast("int"), "uint8"), "signed": scalar.img_as_float((F.floor(a * 65535) - 32768).cast("int"), "int16"), "same": scalar.img_as_float(a, "float64")},
    {"whole": "floor(a * 255) / 255", "signed": "(floor(a * 65535) - 32768 + 0.5) * 2 / 65535", "same": "a"},
)
C._scalars(
    "convert_whole_numbers",
    lambda a,
    b: {k: scalar.convert(x, s, t) / (1 << 16 if t == "uint32" else 1) for k, x, s, t in (("u8_i16", F.floor(a * 255), "uint8", "int16"), ("u8_u32", F.floor(a * 255), "uint8", "uint32"), ("i16_u8", F.floor(a * 65535) - 32768, "int16", "uint8"), ("i16_i8", F.floor(a * 65535) - 32768, "int16", "int8"), ("i8_i16", F.floor(a * 255) - 128, "int8", "int16"))},
    {"u8_i16": "floor(floor(a * 255) * 257 / 2)::BIGINT", "u8_u32": "floor(a * 255) * 16843009 / 65536", "i16_u8": "greatest(floor((floor(a * 65535) - 32768) / 128), 0)::BIGINT", "i16_i8": "floor((floor(a * 65535) - 32768) / 256)::BIGINT", "i8_i16": "(floor(a * 255) * 257 - 32768)::BIGINT"},
)
C._scalars("img_as_float32", lambda a, b: {"v": scalar.img_as_float32(F.floor(a * 255).cast("int"), "uint8").cast("double")}, {"v": "(floor(a * 255) / 255)::FLOAT::DOUBLE"})
C._scalars("img_as_float64", lambda a, b: {"v": scalar.img_as_float64(F.floor(a * 255).cast("int"), "uint8")}, {"v": "floor(a * 255) / 255"})
C._scalars(
    "dtype_limits",
    lambda a,
    b: {k: F.lit(float(v)) + 0.0 * a for k, v in zip(("low", "high", "positive"), (*scalar.dtype_limits("int16"), scalar.dtype_limits("int16", True)[0]))},
    {"low": "-32768.0::DOUBLE", "high": "32767.0::DOUBLE", "positive": "0.0::DOUBLE"},
)
C.register(
    "ArrayMap",
    lambda spark,
    sf: views.ArrayMap([1, 5, 7, 200], [10.0, 50.0, 70.0, 2.5])(C.levels(spark, sf).select("image_id", "y", "x", F.col("q").cast("long").alias("v"))).select("image_id", "y", "x", F.col("v").cast("double").alias("v")),
    f"WITH {T.PX}, {T.QX} SELECT image_id, y, x, (CASE q WHEN 1 THEN 10 WHEN 5 THEN 50 WHEN 7 THEN 70 WHEN 200 THEN 2.5 ELSE 0 END)::DOUBLE AS v FROM qx",
)
C.register(
    "ndim",
    lambda spark,
    sf: embedding_images(spark, sf).select("image_id", F.size("shape").alias("ndim"), F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape")),
    "SELECT vec_id AS image_id, 2 AS ndim, '8x8' AS shape FROM embeddings",
)

# Regions as images, moments of coordinates ----------------------------------------------------------------------

_LAB = C._LABELS + ", lab AS MATERIALIZED (SELECT px.image_id, px.y, px.x, px.v, coalesce(l.label, 0) AS label FROM px LEFT JOIN l ON l.image_id = px.image_id AND l.y = px.y AND l.x = px.x), box AS MATERIALIZED (SELECT image_id, label, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM lab WHERE label > 0 GROUP BY 1, 2)"
C.register(
    "region_images",
    lambda spark,
    sf: C.rounded(regions.region_images(C._labelled(spark, sf))),
    _LAB + " SELECT b.image_id, b.label, p.y - b.y0 AS y, p.x - b.x0 AS x, p.label = b.label AS image, round(CASE WHEN p.label = b.label THEN p.v ELSE 0 END, 6) + 0.0 AS intensity_image FROM box b JOIN lab p ON p.image_id = b.image_id AND p.y BETWEEN b.y0 AND b.y1 AND p.x BETWEEN b.x0 AND b.x1",
)
C.register(
    "region_coords",
    lambda spark,
    sf: regions.region_coords(C._labelled(spark, sf)).select("image_id", "label", F.array_join(F.transform("coords", lambda c: F.concat_ws(":", c["y"].cast("string"), c["x"].cast("string"))), ",").alias("coords")),
    _LAB + " SELECT image_id, label, string_agg(y || ':' || x, ',' ORDER BY y, x) AS coords FROM lab WHERE label > 0 GROUP BY 1, 2",
)
C.register(
    "local_centroid",
    lambda spark,
    sf: C.rounded(regions.local_centroids(C._labelled(spark, sf).withColumn("v", F.col("v") + 1))),
    _LAB + " SELECT l.image_id, l.label, round(avg(l.y) - any_value(y0), 6) + 0.0 AS local_centroid_0, round(avg(l.x) - any_value(x0), 6) + 0.0 AS local_centroid_1, round(sum((v + 1) * (y - y0)) / sum(v + 1), 6) + 0.0 AS weighted_local_centroid_0, round(sum((v + 1) * (x - x0)) / sum(v + 1), 6) + 0.0 AS weighted_local_centroid_1 FROM lab l JOIN box b USING (image_id, label) GROUP BY 1, 2",
)


def _points(spark: SparkSession, sf: str) -> DataFrame:
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    return line.select(F.col("l_suppkey").alias("label"), F.col("l_quantity").alias("y"), (F.col("l_linenumber") * 3).cast("double").alias("x"))


_ORDERS = [(i, j) for i in range(4) for j in range(4) if i + j <= 3]
C.register(
    "moments_coords",
    lambda spark,
    sf: C.rounded(regions.moments(_points(spark, sf), 3, ["label"]), 3),
    "SELECT l_suppkey AS label, " + ", ".join(f"round(sum(pow(l_quantity, {i}) * pow(l_linenumber * 3, {j}))::DOUBLE, 3) + 0.0 AS m_{i}_{j}" for i, j in _ORDERS) + " FROM lineitem GROUP BY 1",
)
_C3 = [(i, j) for i, j in _ORDERS if i + j >= 2]
C.register(
    "moments_coords_central",
    lambda spark,
    sf: C.rounded(shapes.region_moments(_points(spark, sf), None, ["label"]).select("label", *[(F.col(f"mu_{i}_{j}") / F.col("m_0_0")).alias(f"mu_{i}_{j}") for i, j in _C3]), 3),
    "WITH t AS (SELECT l_suppkey AS label, l_quantity::DOUBLE AS y, (l_linenumber * 3)::DOUBLE AS x FROM lineitem), c AS (SELECT label, avg(y) AS cy, avg(x) AS cx FROM t GROUP BY 1) SELECT label, " + ", ".join(f"round(avg(pow(y - cy, {i}) * pow(x - cx, {j})), 3) + 0.0 AS mu_{i}_{j}" for i, j in _C3) + " FROM t JOIN c USING (label) GROUP BY 1",
)
C.register(
    "inertia_tensor",
    lambda spark,
    sf: C.rounded(regions.region_table(C._labelled(spark, sf)).select("image_id", "label", "inertia_0_0", "inertia_0_1", "inertia_1_1", "inertia_eigval_0", "inertia_eigval_1")),
    f"SELECT image_id, label, inertia_0_0, inertia_0_1, inertia_1_1, inertia_eigval_0, inertia_eigval_1 FROM ({SQL['regionprops_all']})",
)

# Registration ------------------------------------------------------------------------------------------------------

_PAIRS = f"{T.PX}, j AS MATERIALIZED (SELECT p.image_id // 2 AS image_id, p.y, p.x, p.v AS a, q.v AS b FROM px p JOIN px q ON q.image_id = p.image_id + 1 AND q.y = p.y AND q.x = p.x WHERE p.image_id % 2 = 0)"
_TURN = "(2 * pi() * (c.y * j.y + c.x * j.x) / 8)"
_CROSS = f"WITH {_PAIRS}, f AS MATERIALIZED (SELECT j.image_id, c.y, c.x, sum(a * cos({_TURN})) AS ar, -sum(a * sin({_TURN})) AS ai, sum(b * cos({_TURN})) AS br, -sum(b * sin({_TURN})) AS bi FROM j CROSS JOIN {W.GRID} c GROUP BY ALL), k AS MATERIALIZED (SELECT image_id, y, x, ar * br + ai * bi AS re, ai * br - ar * bi AS im FROM f), n AS MATERIALIZED (SELECT image_id, y, x, re AS a, im AS b FROM k), r AS MATERIALIZED (SELECT j.image_id, c.y, c.x, sqrt(pow(sum(j.a * cos({_TURN}) - j.b * sin({_TURN})), 2) + pow(sum(j.a * sin({_TURN}) + j.b * cos({_TURN})), 2)) / 64 AS r FROM n j CROSS JOIN {W.GRID} c GROUP BY ALL), w AS (SELECT image_id, arg_max({{'y': y, 'x': x}}, (round(r, 9), -y, -x)) AS s FROM r GROUP BY 1) SELECT image_id, 0 AS y, g.x::INT AS x, (CASE WHEN g.x = 0 THEN CASE WHEN s.y > 4 THEN s.y - 8 ELSE s.y END ELSE CASE WHEN s.x > 4 THEN s.x - 8 ELSE s.x END END)::DOUBLE AS v FROM w, (VALUES (0), (1)) AS g(x)"


def _on_pairs(name: str, kernel, sql: str | None = None) -> None:
    C.register(name, lambda spark, sf: pixels(map_pairs(C._pairs(spark, sf), kernel, ["image_id"])), sql)


_on_pairs("register_translation", lambda a, b: vision.register_translation(a, b).reshape(len(a), 1, 2), _CROSS)
_MASKED = f"WITH {_PAIRS}, s AS MATERIALIZED (SELECT p.image_id, p.y - q.y + 7 AS y, p.x - q.x + 7 AS x, sum(p.a) FILTER (WHERE p.a > -0.2 AND q.b > -0.2) AS sa, sum(q.b) FILTER (WHERE p.a > -0.2 AND q.b > -0.2) AS sb, sum(p.a * p.a) FILTER (WHERE p.a > -0.2 AND q.b > -0.2) AS saa, sum(q.b * q.b) FILTER (WHERE p.a > -0.2 AND q.b > -0.2) AS sbb, sum(p.a * q.b) FILTER (WHERE p.a > -0.2 AND q.b > -0.2) AS sab, count(*) FILTER (WHERE p.a > -0.2 AND q.b > -0.2) AS n FROM j p JOIN j q ON q.image_id = p.image_id GROUP BY ALL), c AS MATERIALIZED (SELECT image_id, y, x, n, max(n) OVER (PARTITION BY image_id) AS most, sab - sa * sb / n AS top, sqrt(greatest(saa - sa * sa / n, 0) * greatest(sbb - sb * sb / n, 0)) AS bottom FROM s), f AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN bottom > 1e-9 AND n >= 0.3 * most THEN greatest(least(top / bottom, 1), -1) ELSE 0 END AS v FROM c)"
_on_pairs(
    "cross_correlate_masked",
    lambda a,
    b: vision.cross_correlate_masked(a, b, a > -0.2, b > -0.2),
    _MASKED + " SELECT image_id, y::INT AS y, x::INT AS x, round(coalesce(v, 0), 6) + 0.0 AS v FROM f",
)
_BEST = _MASKED + ", w AS (SELECT image_id, arg_max({'y': y, 'x': x}, (round(v, 9), -y, -x)) AS s FROM f GROUP BY 1) SELECT image_id, 0 AS y, g.x::INT AS x, (CASE WHEN g.x = 0 THEN s.y ELSE s.x END - 7)::DOUBLE AS v FROM w, (VALUES (0), (1)) AS g(x)"
SQL["masked_registration"] = _BEST
_on_pairs("masked_register_translation", lambda a, b: vision.masked_register_translation(a, b, a > -0.2, b > -0.2).reshape(len(a), 1, 2), _BEST)
_on_pairs(
    "resize_flow",
    lambda a,
    b: vision.resize_flow(np.stack([a, b], 1), (4, 4)).reshape(len(a), -1, 4),
    f"WITH {_PAIRS} SELECT image_id, (y // 2 + k * 4)::INT AS y, (x // 2)::INT AS x, round(0.5 * CASE WHEN k = 0 THEN a ELSE b END, 6) + 0.0 AS v FROM j, range(0, 2) AS g(k) WHERE y % 2 = 1 AND x % 2 = 1",
)
_on_pairs(
    "get_warp_points",
    lambda a,
    b: np.stack([vision.get_warp_points(np.indices((8, 8)), np.stack([p, q])).sum(0) for p, q in zip(a, b)]),
    f"WITH {_PAIRS} SELECT image_id, y, x, round(y + a + x + b, 6) + 0.0 AS v FROM j",
)
_added = lambda a, b, flow: flow + np.stack([a, b], 1)  # noqa: E731  a solver that only adds what it is given
_on_pairs("coarse_to_fine", lambda a, b: vision.coarse_to_fine(a, b, _added, 3, 8)[:, 0], f"WITH {_PAIRS} SELECT image_id, y, x, round(a, 6) + 0.0 AS v FROM j")

# Transforms fitted and applied ---------------------------------------------------------------------------------------

#: The maps that the points of the fitting queries went through.
_HOMOGRAPHY = [[1.2, 0.1, 3.0], [-0.2, 0.9, 5.0], [0.001, 0.002, 1.0]]
_AFFINE = [[1.5, -0.4, 2.0], [0.3, 0.8, -1.0], [0.0, 0.0, 1.0]]
_COS, _SIN = math.cos(0.4), math.sin(0.4)
_EUCLIDEAN = [[_COS, -_SIN, 3.0], [_SIN, _COS, -2.0], [0.0, 0.0, 1.0]]
_SIMILAR = [[1.7 * _COS, -1.7 * _SIN, 3.0], [1.7 * _SIN, 1.7 * _COS, -2.0], [0.0, 0.0, 1.0]]
#: Second camera: turned about the vertical axis and moved; the essential matrix is [t]x R.
_EPIPOLAR = (np.array([[0, -0.1, 0.2], [0.1, 0, -1.0], [-0.2, 1.0, 0]]) @ np.array([[_COS, 0, _SIN], [0, 1, 0], [-_SIN, 0, _COS]])).tolist()


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_nationkey", (F.col("c_custkey") % 17).cast("double").alias("x"), (F.col("c_custkey") % 23 / 2).cast("double").alias("y"), (F.col("c_custkey") % 7 + 4).cast("double").alias("z"))


_XY = "p AS (SELECT c_nationkey, (c_custkey % 17)::DOUBLE AS x, (c_custkey % 23 / 2)::DOUBLE AS y FROM customer)"


def _moved(spark: SparkSession, sf: str, matrix) -> DataFrame:
    u, v = geometry.ProjectiveTransform(matrix).columns(F.col("x"), F.col("y"))
    return _customers(spark, sf).select("c_nationkey", "x", "y", u.alias("u"), v.alias("v"))


def _seen_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Points in space as two cameras see them."""
    x, y, z = (F.col(c) for c in "xyz")
    px, py = x - 8, y - 5
    a, b, c = _COS * px + _SIN * z + 1.0, py + 0.2, -_SIN * px + _COS * z + 0.1
    return _customers(spark, sf).select("c_nationkey", (px / z).alias("x"), (py / z).alias("y"), (a / c).alias("u"), (b / c).alias("v")).where(F.abs(F.col("u")) < 50)


def _constants(matrix) -> str:
    return "SELECT c_nationkey, " + ", ".join(f"round({matrix[i][j]!r}::DOUBLE, 6) + 0.0 AS m_{i}_{j}" for i in range(3) for j in range(3)) + " FROM customer GROUP BY 1"


_KEY = ["c_nationkey"]
for _name, _matrix, _fit in (
    ("ProjectiveTransform_estimate", _HOMOGRAPHY, lambda p: fits.fit_projective(p, _KEY)), ("AffineTransform_estimate", _AFFINE, lambda p: fits.fit_projective(p, _KEY, True)),
    ("EuclideanTransform_estimate", _EUCLIDEAN, lambda p: fits.fit_similarity(p, _KEY, False)), ("SimilarityTransform_estimate", _SIMILAR, lambda p: fits.fit_similarity(p, _KEY)),
):
    C.register(_name, lambda spark, sf, a=_matrix, b=_fit: C.rounded(b(_moved(spark, sf, a))), _constants(_matrix))


def _scaled(fit: DataFrame) -> DataFrame:
    """A matrix known up to a factor, by its greatest entry in size."""
    entries = F.array(*[F.col(c) for c in fits.PARAMS])
    top = F.array_max(F.transform(entries, lambda v: F.struct(F.round(F.abs(v), 9).alias("a"), v.alias("v"))))["v"]
    return fit.select("c_nationkey", *[(F.col(c) / top).alias(c) for c in fits.PARAMS])


_TOP = max((v for row in _EPIPOLAR for v in row), key=abs)
_MATCHED = "SELECT c_nationkey, " + ", ".join(f"round({_EPIPOLAR[i][j] / _TOP!r}::DOUBLE, 6) + 0.0 AS m_{i}_{j}" for i in range(3) for j in range(3)) + " FROM customer GROUP BY 1"
C.register("FundamentalMatrixTransform_estimate", lambda spark, sf: C.rounded(_scaled(fits.fit_fundamental(_seen_twice(spark, sf), _KEY))), _MATCHED)
C.register(
    "FundamentalMatrixTransform_residuals",
    lambda spark,
    sf: fits.epipolar_residuals(_seen_twice(spark, sf), fits.fit_fundamental(_seen_twice(spark, sf), _KEY), _KEY).groupBy("c_nationkey").agg((F.max("residual") < 1e-6).alias("exact")),
    "SELECT DISTINCT c_nationkey, true AS exact FROM customer",
)
C.register(
    "EssentialMatrixTransform_estimate",
    lambda spark,
    sf: C.rounded(_singular(fits.fit_fundamental(_seen_twice(spark, sf), _KEY, True))),
    "SELECT DISTINCT c_nationkey, 0.0::DOUBLE AS determinant FROM customer",
)


def _singular(fit: DataFrame) -> DataFrame:
    """The determinant of each matrix over the cube of its length: 0 for any epipolar geometry."""
    a = [[F.col(f"m_{i}_{j}") for j in range(3)] for i in range(3)]
    det = a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    length = F.sqrt(sum((v * v for r in a for v in r), F.lit(0.0)))
    return fit.select("c_nationkey", (det / (length * length * length)).alias("determinant"))


def _apply(matrix, inverse: bool = False):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        t = geometry.ProjectiveTransform(matrix)
        t = geometry.ProjectiveTransform(np.linalg.inv(t.params)) if inverse else t
        u, v = t.columns(F.col("x"), F.col("y"))
        c = _customers(spark, sf)
        return C.rounded(c.groupBy("c_nationkey").agg(F.avg(u).alias("u"), F.avg(v).alias("v"), F.avg(u * v).alias("uv")))

    return query


def _apply_sql(matrix) -> str:
    a = [" + ".join(f"{float(w)!r}::DOUBLE * {n}" for w, n in zip(row, ("x", "y", "1"))) for row in matrix]
    return f"WITH {_XY}, q AS (SELECT c_nationkey, ({a[0]}) / ({a[2]}) AS u, ({a[1]}) / ({a[2]}) AS v FROM p) SELECT c_nationkey, round(avg(u), 6) + 0.0 AS u, round(avg(v), 6) + 0.0 AS v, round(avg(u * v), 6) + 0.0 AS uv FROM q GROUP BY 1"


def _product(a, b) -> list[list[float]]:
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


_BACKWARD = W._dense(W.solved([dict(enumerate(row)) for row in _HOMOGRAPHY], 3), 3)
C.register("ProjectiveTransform", _apply(_HOMOGRAPHY), _apply_sql(_HOMOGRAPHY))
C.register("matrix_transform", _apply(_AFFINE), _apply_sql(_AFFINE))
C.register("ProjectiveTransform_inverse", _apply(_HOMOGRAPHY, True), _apply_sql(_BACKWARD))
C.register("ProjectiveTransform_add", _apply((geometry.AffineTransform(_AFFINE) + geometry.ProjectiveTransform(_HOMOGRAPHY)).params.tolist()), _apply_sql(_product(_HOMOGRAPHY, _AFFINE)))
_PARTS = geometry.AffineTransform(scale=(1.2, 0.7), rotation=0.3, shear=0.2, translation=(4, -1))
C.register("AffineTransform", _apply(_PARTS.params.tolist()), _apply_sql([[1.2 * math.cos(0.3), -0.7 * math.sin(0.5), 4], [1.2 * math.sin(0.3), 0.7 * math.cos(0.5), -1], [0, 0, 1]]))
C.register(
    "AffineTransform_properties",
    lambda spark,
    sf: C.rounded(fits.properties(fits.fit_projective(_moved(spark, sf, _PARTS.params.tolist()), _KEY, True), _KEY)),
    "SELECT DISTINCT c_nationkey, 1.2::DOUBLE AS scale_x, 0.7::DOUBLE AS scale_y, 0.3::DOUBLE AS rotation, 0.2::DOUBLE AS shear, 4.0::DOUBLE AS translation_x, -1.0::DOUBLE AS translation_y FROM customer",
)
C.register(
    "ProjectiveTransform_residuals",
    lambda spark,
    sf: C.rounded(fits.residuals(_moved(spark, sf, _HOMOGRAPHY).withColumn("u", F.col("u") + 0.3), spark.createDataFrame([(k, *[v for row in _HOMOGRAPHY for v in row]) for k in range(25)], f"c_nationkey int, {', '.join(f'{p} double' for p in fits.PARAMS)}"), _KEY).groupBy("c_nationkey").agg(F.avg("residual").alias("residual"))),
    "SELECT DISTINCT c_nationkey, 0.3::DOUBLE AS residual FROM customer",
)
_SRC = [(0.0, 0.0), (7.0, 0.0), (0.0, 7.0), (7.0, 7.0)]
_EST = geometry.estimate_transform("affine", np.array(_SRC), geometry.ProjectiveTransform(_AFFINE)(np.array(_SRC)))
C.register("estimate_transform", _apply(_EST.params.tolist()), _apply_sql(_AFFINE))
_TERMS = [1.0, 0.5, -0.2, 0.03, 0.01, -0.02], [2.0, -0.1, 0.7, 0.0, 0.02, 0.01]


def _bent(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    poly = lambda c: c[0] + c[1] * x + c[2] * y + c[3] * x * x + c[4] * x * y + c[5] * y * y
    return _customers(spark, sf).select("c_nationkey", "x", "y", poly(_TERMS[0]).alias("u"), poly(_TERMS[1]).alias("v"))


C.register(
    "PolynomialTransform_estimate",
    lambda spark,
    sf: C.rounded(fits.fit_polynomial(_bent(spark, sf), _KEY)),
    "SELECT DISTINCT c_nationkey, " + ", ".join(f"{v!r}::DOUBLE AS {n}_{k}" for n, row in zip("ab", _TERMS) for k, v in enumerate(row)) + " FROM customer",
)


def _piecewise():
    """A kernel that warps by maps on the triangles of five points, all from one affine map."""
    def kernel(x):
        t = geometry.PiecewiseAffineTransform()
        src = np.array([(-1.0, -1.0), (8.0, -1.0), (-1.0, 8.0), (8.0, 8.0), (3.3, 4.1)])
        t.estimate(src, src @ np.array([[0.9, 0.05], [-0.1, 0.8]]) + (0.55, 0.7))
        return interpolate.warp(x, t)

    return kernel


C.on_images(
    "PiecewiseAffineTransform_estimate",
    _piecewise(),
    W.picture(W.points("f", f"SELECT y, x, 0.05::DOUBLE * x + 0.8::DOUBLE * y + 0.7 AS sy, 0.9::DOUBLE * x - 0.1::DOUBLE * y + 0.55 AS sx FROM {W.GRID}"), source="f"),
)

# Shapes of regions ------------------------------------------------------------------------------------------------------

# Middles of the sides of a region's pixels, in half pixels, the outermost of each row: all that can lie on its hull.
_SIDES = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(a, b)"
_OUTER = "SELECT g, y, min(x) AS lo, max(x) AS hi FROM (SELECT g, 2 * y + d.a AS y, 2 * x + d.b AS x FROM {0}, " + _SIDES + ") GROUP BY 1, 2"
_ENDS = "SELECT DISTINCT g, y, x FROM (SELECT g, y, lo AS x FROM {0} UNION ALL SELECT g, y, hi AS x FROM {0})"
# Edges that leave every other point on one side, or between their ends; a pixel is in the hull if it is on that side of all.
_TURN3 = "((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x))"
_HULL = f"""w AS MATERIALIZED ({_OUTER.format('b')}), e AS MATERIALIZED ({_ENDS.format('w')}), side_ AS MATERIALIZED (SELECT p.g, p.y AS py, p.x AS px, q.y AS qy, q.x AS qx FROM e p JOIN e q ON q.g = p.g AND (q.y <> p.y OR q.x <> p.x) JOIN e r ON r.g = p.g GROUP BY p.g, p.x, p.y, q.x, q.y HAVING min({_TURN3}) >= 0 AND min(CASE WHEN {_TURN3} = 0 THEN (r.x - p.x) * (q.x - r.x) + (r.y - p.y) * (q.y - r.y) ELSE 0 END) >= 0),
conv AS MATERIALIZED (SELECT c.g, c.y, c.x FROM (SELECT k.g, a.k::INT AS y, d.k::INT AS x FROM (SELECT g, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM b GROUP BY 1) k, range(0, 8) AS a(k), range(0, 8) AS d(k) WHERE a.k BETWEEN y0 AND y1 AND d.k BETWEEN x0 AND x1) c JOIN side_ s ON s.g = c.g GROUP BY ALL HAVING min((qx - px) * (2 * c.y - py) - (qy - py) * (2 * c.x - px)) >= 0),
hull AS MATERIALIZED (SELECT g, count(*)::DOUBLE AS convex_area FROM conv GROUP BY 1), cw AS MATERIALIZED ({_OUTER.format('conv')}), ce AS MATERIALIZED ({_ENDS.format('cw')}), far AS MATERIALIZED (SELECT p.g, sqrt(max((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x))) / 2 AS feret FROM ce p JOIN ce q ON q.g = p.g GROUP BY 1)"""
_MASKS = f"WITH {T.PX}, i AS (SELECT DISTINCT image_id FROM px), b AS MATERIALIZED (SELECT image_id AS g, y, x FROM px WHERE v > 0), {_HULL} "
SQL["convex_area"] = _MASKS + "SELECT i.image_id, 0 AS y, 0 AS x, round(coalesce(convex_area, 0), 6) AS v FROM i LEFT JOIN hull ON g = image_id"
SQL["feret_diameter_max"] = _MASKS + "SELECT i.image_id, 0 AS y, 0 AS x, round(coalesce(feret, 0), 6) AS v FROM i LEFT JOIN far ON g = image_id"
_NEAR8 = "abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1"
SQL["region_shapes"] = f"""{_LAB}, b AS MATERIALIZED (SELECT image_id * 1000 + label AS g, y, x FROM lab WHERE label > 0), n AS MATERIALIZED (SELECT g, count(*) AS area FROM b GROUP BY 1), {_HULL},
out AS MATERIALIZED (SELECT c.g, c.y, c.x, c.edge FROM (SELECT box.image_id * 1000 + box.label AS g, a.k::INT AS y, d.k::INT AS x, a.k IN (y0 - 1, y1 + 1) OR d.k IN (x0 - 1, x1 + 1) AS edge FROM box, range(-1, 9) AS a(k), range(-1, 9) AS d(k) WHERE a.k BETWEEN y0 - 1 AND y1 + 1 AND d.k BETWEEN x0 - 1 AND x1 + 1) c LEFT JOIN b USING (g, y, x) WHERE b.y IS NULL),
flood AS (SELECT g, y, x FROM out WHERE edge UNION SELECT n.g, n.y, n.x FROM flood p JOIN out n ON n.g = p.g AND {_NEAR8}), inner_ AS (SELECT o.g, count(*) - (SELECT count(*) FROM flood f WHERE f.g = o.g) AS holes FROM out o GROUP BY 1),
border AS MATERIALIZED (SELECT p.g, p.y, p.x FROM b p JOIN b n ON n.g = p.g AND abs(n.y - p.y) + abs(n.x - p.x) <= 1 GROUP BY ALL HAVING count(*) < 5),
code AS (SELECT p.g, p.y, p.x, sum(CASE abs(n.y - p.y) + abs(n.x - p.x) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END) AS c FROM (SELECT DISTINCT g, y + a.k AS y, x + d.k AS x FROM border, range(-1, 2) AS a(k), range(-1, 2) AS d(k)) p JOIN border n ON n.g = p.g AND {_NEAR8} GROUP BY ALL),
round_ AS (SELECT g, sum(CASE WHEN c IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN c IN (21, 33) THEN sqrt(2.0::DOUBLE) WHEN c IN (13, 23) THEN (1 + sqrt(2.0::DOUBLE)) / 2 ELSE 0 END) AS perimeter FROM code GROUP BY 1),
touch AS (SELECT p.g, count(*) FILTER (WHERE abs(n.y - p.y) + abs(n.x - p.x) = 1) AS side, count(*) FILTER (WHERE abs(n.y - p.y) = 1 AND abs(n.x - p.x) = 1) AS diag FROM b p JOIN b n ON n.g = p.g AND {_NEAR8} AND (n.y <> p.y OR n.x <> p.x) GROUP BY 1),
quad AS (SELECT p.g, p.y, p.x, count(*) AS n, max(CASE WHEN n.y = p.y AND n.x = p.x THEN 1 ELSE 0 END) AS a, max(CASE WHEN n.y = p.y + 1 AND n.x = p.x + 1 THEN 1 ELSE 0 END) AS d FROM (SELECT DISTINCT g, y - a.k AS y, x - c.k AS x FROM b, range(0, 2) AS a(k), range(0, 2) AS c(k)) p JOIN b n ON n.g = p.g AND n.y - p.y IN (0, 1) AND n.x - p.x IN (0, 1) GROUP BY ALL),
euler AS (SELECT g, (count(*) FILTER (WHERE n = 1) - count(*) FILTER (WHERE n = 3) - 2 * count(*) FILTER (WHERE n = 2 AND a = d)) // 4 AS euler FROM quad GROUP BY 1)
SELECT (n.g // 1000)::BIGINT AS image_id, (n.g % 1000)::BIGINT AS label, n.area, (n.area + holes)::BIGINT AS filled_area, round(convex_area, 6) AS convex_area, round(n.area / convex_area, 6) AS solidity, round(coalesce(perimeter, 0), 6) AS perimeter, round(pi() / 8 * (n.area * (4 + 4 * sqrt(0.5::DOUBLE)) - coalesce(side, 0) - coalesce(diag, 0) * sqrt(0.5::DOUBLE)), 6) AS perimeter_crofton, euler::BIGINT AS euler_number, round(feret, 6) AS feret_diameter_max
FROM n JOIN hull USING (g) JOIN far USING (g) JOIN inner_ USING (g) LEFT JOIN round_ USING (g) LEFT JOIN touch USING (g) JOIN euler USING (g)"""

# To a quarter of a pixel: the coarse shift first, then places around it.
_COARSE = _CROSS.rsplit(" SELECT image_id, 0 AS y", 1)[0]
_WAVE = "(2 * pi() * (CASE WHEN k.y < 4 THEN k.y ELSE k.y - 8 END * g.sy + CASE WHEN k.x < 4 THEN k.x ELSE k.x - 8 END * g.sx) / 8)"
SQL["phase_cross_correlation"] = _COARSE + f", g AS MATERIALIZED (SELECT image_id, a.k AS iy, b.k AS ix, CASE WHEN s.y > 4 THEN s.y - 8 ELSE s.y END + (a.k - 3) / 4.0::DOUBLE AS sy, CASE WHEN s.x > 4 THEN s.x - 8 ELSE s.x END + (b.k - 3) / 4.0::DOUBLE AS sx FROM w, range(0, 6) AS a(k), range(0, 6) AS b(k)), z AS (SELECT g.image_id, g.iy, g.ix, g.sy, g.sx, pow(sum(k.a * cos({_WAVE}) - k.b * sin({_WAVE})), 2) + pow(sum(k.a * sin({_WAVE}) + k.b * cos({_WAVE})), 2) AS r FROM g JOIN n k ON k.image_id = g.image_id GROUP BY ALL), t AS (SELECT image_id, arg_max({{'y': sy, 'x': sx}}, (round(r, 6), -iy, -ix)) AS s FROM z GROUP BY 1) SELECT image_id, 0 AS y, o.x::INT AS x, round((CASE WHEN o.x = 0 THEN s.y ELSE s.x END)::DOUBLE, 6) + 0.0 AS v FROM t, (VALUES (0), (1)) AS o(x)"

# Tables, windows and streams -----------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def _round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Images written as a table and read again."""
    path = f"{scratch(spark)}/images"
    images.write_images(embedding_images(spark, sf).select("image_id", "shape", "img"), path)
    return pixels(images.read_images(spark, path))


def _streamed(spark: SparkSession, sf: str, change, name: str) -> DataFrame:
    """A query over the embeddings as they arrive in a stream, run until the input is used up."""
    folder = scratch(spark)
    source = f"{folder}/in"
    embedding_images(spark, sf).select("image_id", "shape", "img").repartition(4).write.parquet(source)
    arriving = stream.stream_images(spark, source, spark.read.parquet(source).schema, 2)
    stream.write(change(arriving), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    """The last state of a running histogram, kept by batch."""
    folder = scratch(spark)
    source, out = f"{folder}/in", f"{folder}/out"
    embedding_images(spark, sf).select("image_id", "shape", "img").repartition(4).write.parquet(source)
    arriving = stream.stream_images(spark, source, spark.read.parquet(source).schema, 1)
    keep = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)
    stream.running_histogram(arriving, 16, -1.0, 1.0).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(out)
    return kept.groupBy("bin").agg(F.max_by("n", "batch").alias("n"))


from ..operators.runtime import scratch  # noqa: E402
from ..sources import images  # noqa: E402
from ..streaming import images as stream  # noqa: E402

C.register("table_round_trip", _round_trip, f"WITH {T.PX} SELECT image_id, y, x, round(v, 6) + 0.0 AS v FROM px")
C.register("stream_filter", lambda spark, sf: pixels(_streamed(spark, sf, lambda s: stream.filtered(s, filters.uniform_filter), "filter")), SQL["uniform_filter"])
C.register("stream_histogram", _counted, f"WITH {T.PX} SELECT least(floor((v + 1) / 2.0 * 16), 15)::INT AS bin, count(*) AS n FROM px WHERE v BETWEEN -1 AND 1 GROUP BY 1")
C.register(
    "event_windows",
    lambda spark,
    sf: C.rounded(stream.event_grid(_events(spark, sf), "6 hours").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))),
    "SELECT user_id, strftime(to_timestamp(floor(epoch(ts) / 21600) * 21600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start, round(sum(value), 6) + 0.0 AS v, count(*) AS n FROM events GROUP BY 1, 2",
)
C.register(
    "event_sliding_windows",
    lambda spark,
    sf: C.rounded(stream.event_grid(_events(spark, sf), "6 hours", "3 hours").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))),
    "SELECT user_id, strftime(to_timestamp((floor(epoch(ts) / 10800) - k) * 10800) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start, round(sum(value), 6) + 0.0 AS v, count(*) AS n FROM events, range(0, 2) AS g(k) GROUP BY 1, 2",
)
C.register(
    "event_sessions",
    lambda spark,
    sf: C.rounded(stream.event_sessions(_events(spark, sf), "2 hours").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))),
    "WITH g AS (SELECT user_id, ts, value, CASE WHEN epoch(ts) - epoch(lag(ts) OVER u) < 7200 THEN 0 ELSE 1 END AS begins FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, round(sum(value), 6) + 0.0 AS v, count(*) AS n FROM s GROUP BY user_id, k",
)
C.register(
    "label_rollup",
    lambda spark,
    sf: C.rounded(regions.label_rollup(C._labelled(spark, sf))).fillna(-1, ["image_id", "label"]),
    _LAB + " SELECT coalesce(image_id, -1) AS image_id, coalesce(label, -1) AS label, count(*) AS n, round(sum(v), 6) + 0.0 AS sum, round(min(v), 6) + 0.0 AS minimum, round(max(v), 6) + 0.0 AS maximum FROM lab WHERE label > 0 GROUP BY ROLLUP (lab.image_id, lab.label)",
)

# Edges by hysteresis, descriptors, local equalisation, polygons ----------------------------------------------------------------

_SMOOTH = W.taps(W.bell(0.5), mode="constant")
_BLEED = [sum(row.values()) for row in _SMOOTH]
_EVEN = "g AS MATERIALIZED (SELECT image_id, y, x, v / (" + " * ".join(f"[{', '.join(f'{v!r}::DOUBLE' for v in _BLEED)}][{c} + 1]" for c in "yx") + " + 2.220446049250313e-16) AS v FROM s)"
_AT = ", ".join(f"max(CASE WHEN q.y - p.y = {a} AND q.x - p.x = {b} THEN q.m END) AS m{'no'[a > 0] if a else 'z'}{'no'[b > 0] if b else 'z'}" for a in (-1, 0, 1) for b in (-1, 0, 1))
_SAME_SIGN, _STEEP = "(gy >= 0) = (gx >= 0)", "abs(gy) >= abs(gx)"
_W = f"CASE WHEN {_STEEP} THEN CASE WHEN gy = 0 THEN 0 ELSE abs(gx / gy) END ELSE abs(gy / gx) END"
_END1 = f"CASE WHEN {_STEEP} THEN (1 - w) * moz + w * CASE WHEN {_SAME_SIGN} THEN moo ELSE mon END ELSE (1 - w) * mzo + w * CASE WHEN {_SAME_SIGN} THEN moo ELSE mno END END"
_END2 = f"CASE WHEN {_STEEP} THEN (1 - w) * mnz + w * CASE WHEN {_SAME_SIGN} THEN mnn ELSE mno END ELSE (1 - w) * mzn + w * CASE WHEN {_SAME_SIGN} THEN mnn ELSE mon END END"
SQL["canny"] = f"""WITH RECURSIVE {T.PX}, {W.both('px', 's', _SMOOTH)}, {_EVEN}, {W.both('g', 'gy', W.taps(_DIFF), W.taps(_TRI))}, {W.both('g', 'gx', W.taps(_TRI), W.taps(_DIFF))},
m AS MATERIALIZED (SELECT image_id, y, x, gy.v AS gy, gx.v AS gx, sqrt(gy.v * gy.v + gx.v * gx.v) AS m FROM gy JOIN gx USING (image_id, y, x)),
k AS MATERIALIZED (SELECT p.image_id, p.y, p.x, p.gy, p.gx, {_AT} FROM m p JOIN m q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 WHERE p.y BETWEEN 1 AND 6 AND p.x BETWEEN 1 AND 6 GROUP BY p.image_id, p.y, p.x, p.gy, p.gx),
t AS MATERIALIZED (SELECT image_id, y, x, mzz AS v FROM (SELECT *, {_W} AS w FROM k) WHERE mzz > 0 AND mzz >= {_END1} AND mzz >= {_END2} AND mzz >= 0.05),
r AS (SELECT image_id, y, x FROM t WHERE v >= 0.2 UNION SELECT n.image_id, n.y, n.x FROM r JOIN t n ON n.image_id = r.image_id AND abs(n.y - r.y) <= 1 AND abs(n.x - r.x) <= 1)
SELECT px.image_id, px.y, px.x, CASE WHEN r.y IS NULL THEN 0.0 ELSE 1.0 END AS v FROM px LEFT JOIN r USING (image_id, y, x)"""
_RING = ", ".join(f"({h + 1}, {a}, {b})" for h, (a, b) in enumerate(((0, 2), (2, 0), (0, -2), (-2, 0))))
_AHEAD = [{o + 1: 1.0, o: -1.0} if o < 7 else {7: 0.0} for o in range(8)]
SQL["daisy"] = f"""WITH {T.PX}, {W.both('px', 'gy', _AHEAD, _SAME)}, {W.both('px', 'gx', _SAME, _AHEAD)}, o AS MATERIALIZED (SELECT image_id * 10 + k AS image_id, y, x, sqrt(gy.v * gy.v + gx.v * gx.v) * exp(4 / pi() * cos(atan2(gy.v, gx.v) - (k * pi() / 2 - pi()))) AS v FROM gy JOIN gx USING (image_id, y, x), range(0, 4) AS r(k)),
{W.smooth('o', 'near', 1.0)}, c AS (SELECT a.k AS py, b.k AS px FROM range(0, 2) AS a(k), range(0, 2) AS b(k)), d AS (SELECT n.image_id, py * 2 + px AS y, n.image_id % 10 AS x, n.v FROM near n JOIN c ON n.y = 2 + 2 * py AND n.x = 2 + 2 * px UNION ALL SELECT n.image_id, py * 2 + px, h * 4 + n.image_id % 10, n.v FROM near n CROSS JOIN c JOIN (VALUES {_RING}) AS g(h, dy, dx) ON n.y = 2 + 2 * py + dy AND n.x = 2 + 2 * px + dx)
SELECT image_id // 10 AS image_id, y::INT AS y, x::INT AS x, round((v + 1e-10) / sum(v + 1e-10) OVER (PARTITION BY image_id // 10, y), 6) + 0.0 AS v FROM d"""
C.on_images(
    "equalize_adapthist",
    lambda x: vision.equalize_adapthist(x, 4),
    f"""WITH RECURSIVE {T.PX}, g AS MATERIALIZED (SELECT image_id, y, x, round_even(least(greatest(v, 0), 1) * 65535, 0) AS g FROM px), s AS MATERIALIZED (SELECT image_id, y, x, min(g) OVER i AS lo, max(g) OVER i AS hi, g FROM g WINDOW i AS (PARTITION BY image_id)),
q AS MATERIALIZED (SELECT image_id, y, x, (CASE WHEN hi > lo THEN round_even((g - lo) / (hi - lo) * 16383, 0) ELSE least(g, 16383) END)::INT // 65 AS q FROM s),
h0 AS MATERIALIZED (SELECT image_id, y // 4 AS ty, x // 4 AS tx, list_transform(range(0, 256), lambda k: list_contains(list(q), k)::INT) AS h, (16 - count(DISTINCT q))::INT AS spare FROM q GROUP BY ALL),
r AS (SELECT *, 0 AS start FROM h0 UNION ALL SELECT image_id, ty, tx, h2, (spare - list_sum(h2) + list_sum(h))::INT, start + 1 FROM (SELECT *, list_transform(h, lambda v, i: CASE WHEN v < 1 AND i > start AND (i - 1 - start) % step = 0 THEN 1 ELSE v END) AS h2 FROM (SELECT *, greatest(1, (256 - list_sum(h))::INT // spare) AS step FROM r WHERE spare > 0))),
t AS MATERIALIZED (SELECT image_id, ty, tx, h FROM r WHERE spare <= 0),
e AS (SELECT q.image_id, q.y, q.x, q.q, least(greatest((y + 2) // 4 + a.k - 1, 0), 1) AS ty, least(greatest((x + 2) // 4 + c.k - 1, 0), 1) AS tx, abs(1 - a.k - ((y + 2) % 4) / 4.0::DOUBLE) * abs(1 - c.k - ((x + 2) % 4) / 4.0::DOUBLE) AS w FROM q, range(0, 2) AS a(k), range(0, 2) AS c(k)),
f AS MATERIALIZED (SELECT e.image_id, e.y, e.x, floor(sum(w * floor(least(list_sum(t.h[1 : e.q + 1]) * 1023.9375::DOUBLE, 16383)))) AS v FROM e JOIN t USING (image_id, ty, tx) GROUP BY ALL)
SELECT image_id, y, x, round(CASE WHEN max(v) OVER i > min(v) OVER i THEN (v - min(v) OVER i) / (max(v) OVER i - min(v) OVER i) ELSE v / 65535 END, 6) + 0.0 AS v FROM f WINDOW i AS (PARTITION BY image_id)""",
)


def _polygons(degree: int, closed: bool):
    """A kernel: the first two rows of an image are the corners' coordinates; the new corners are two rows again."""
    def kernel(x):
        out = []
        for img in x:
            p = img[:2].T
            out.append(geometry.subdivide_polygon(np.vstack([p, p[:1]]) if closed else p, degree).T)
        return np.stack(out)

    return kernel


def _subdivision(degree: int, closed: bool) -> str:
    even, odd = geometry.SUBDIVISION[degree]
    rows: list[dict[int, float]] = []
    n = 8 if closed else 8 - len(even) + 1
    for k in range(n):
        for mask in (odd, even):
            row: dict[int, float] = {}
            for j, w in enumerate(mask):
                i = (k + (len(mask) - 1) // 2 - j) % 8 if closed else k + len(mask) - 1 - j
                row[i] = row.get(i, 0.0) + w / 2**degree
            rows.append(row)
    return W.picture("c AS MATERIALIZED (SELECT * FROM px WHERE y < 2)", W.along("c", "f", "x", rows + rows[:1] if closed else rows), source="f")


C.on_images("subdivide_polygon", _polygons(2, False), _subdivision(2, False))
C.on_images("subdivide_polygon_closed", _polygons(3, True), _subdivision(3, True))

# Dense flow ------------------------------------------------------------------------------------------------------------------------

_MIRROR5 = W.taps([0.2] * 5, mode="mirror")


def _lucas_kanade(k: int) -> str:
    """CTEs: one round of warping and solving, from flow ``fl<k>`` to ``fl<k + 1>``."""
    at = lambda axis, flow: f"least(greatest(f.{axis} + f.{flow}, 0), 7)"
    moved = f"mv{k} AS MATERIALIZED (SELECT f.image_id, f.y, f.x, sum(greatest(0, 1 - abs({at('y', 'vy')} - j.y)) * greatest(0, 1 - abs({at('x', 'vx')} - j.x)) * j.b) AS v FROM fl{k} f JOIN j ON j.image_id = f.image_id GROUP BY ALL)"
    slopes = W.both(f"mv{k}", f"dy{k}", W.slope(), _SAME) + ", " + W.both(f"mv{k}", f"dx{k}", _SAME, W.slope())
    error = f"er{k} AS MATERIALIZED (SELECT f.image_id, f.y, f.x, a.v AS gy, b.v AS gx, a.v * f.vy + b.v * f.vx + j.a - m.v AS e FROM fl{k} f JOIN dy{k} a USING (image_id, y, x) JOIN dx{k} b USING (image_id, y, x) JOIN mv{k} m USING (image_id, y, x) JOIN j USING (image_id, y, x))"
    parts = {"yy": "gy * gy", "xy": "gy * gx", "xx": "gx * gx", "ye": "gy * e", "xe": "gx * e"}
    means = ", ".join(f"p{n}{k} AS MATERIALIZED (SELECT image_id, y, x, {v} AS v FROM er{k}), {W.both(f'p{n}{k}', f'{n}{k}', _MIRROR5)}" for n, v in parts.items())
    det = "(a.v * c.v - b.v * b.v)"
    solved = f"fl{k + 1} AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN abs({det}) > 1e-14 THEN (c.v * d.v - b.v * e.v) / {det} ELSE 0 END AS vy, CASE WHEN abs({det}) > 1e-14 THEN (a.v * e.v - b.v * d.v) / {det} ELSE 0 END AS vx FROM yy{k} a JOIN xy{k} b USING (image_id, y, x) JOIN xx{k} c USING (image_id, y, x) JOIN ye{k} d USING (image_id, y, x) JOIN xe{k} e USING (image_id, y, x))"
    return ", ".join([moved, slopes, error, means, solved])


SQL["optical_flow_ilk"] = f"WITH {_PAIRS}, fl0 AS MATERIALIZED (SELECT image_id, y, x, 0.0::DOUBLE AS vy, 0.0::DOUBLE AS vx FROM j), {_lucas_kanade(0)}, {_lucas_kanade(1)} SELECT image_id, (y + 8 * k)::INT AS y, x, round(CASE WHEN k = 0 THEN vy ELSE vx END, 6) + 0.0 AS v FROM fl2, range(0, 2) AS g(k)"


def _at(name: str, source: str, dy: int, dx: int) -> str:
    return f"LEFT JOIN {source} {name} ON {name}.image_id = p.image_id AND {name}.y = p.y + {dy} AND {name}.x = p.x + {dx}"


def _divergence(source: str, name: str) -> str:
    """Backward differences of the dual field (p0, p1), the last ones from its neighbour alone, beside ``v``."""
    part = lambda f, axis: f"CASE WHEN p.{axis} = 0 THEN p.{f} WHEN p.{axis} = 7 THEN -{f}b.{f} ELSE p.{f} - {f}b.{f} END"
    return f"{name} AS MATERIALIZED (SELECT p.image_id, p.y, p.x, p.v, p.p0, p.p1, {part('p0', 'y')} + {part('p1', 'x')} AS div FROM {source} p {_at('p0b', source, -1, 0)} {_at('p1b', source, 0, -1)})"


def _ascent(source: str, name: str, field: str, step: str, scale: str) -> str:
    """One step of the dual field along the forward differences of ``field``."""
    g0, g1 = (f"(CASE WHEN p.{axis} = 7 THEN 0 ELSE {n}.f - p.f END)" for n, axis in (("a", "y"), ("b", "x")))
    fields = f"(SELECT *, {field} AS f FROM {source})"
    return f"{name} AS MATERIALIZED (SELECT p.image_id, p.y, p.x, p.v, (p.p0 + {step} * {g0}) / (1 + {scale} * sqrt({g0} * {g0} + {g1} * {g1})) AS p0, (p.p1 + {step} * {g1}) / (1 + {scale} * sqrt({g0} * {g0} + {g1} * {g1})) AS p1 FROM {fields} p {_at('a', fields, 1, 0)} {_at('b', fields, 0, 1)})"


_ROUNDS = 12
_CHAMBOLLE = ["t0 AS MATERIALIZED (SELECT image_id, y, x, v, 0.0::DOUBLE AS p0, 0.0::DOUBLE AS p1 FROM px)"]
for _k in range(_ROUNDS):
    _CHAMBOLLE.append(_divergence(f"t{_k}", f"d{_k}"))
    if _k + 1 < _ROUNDS:
        _CHAMBOLLE.append(_ascent(f"d{_k}", f"t{_k + 1}", "v + div", "0.25", "2.5"))
C.on_images("denoise_tv_chambolle_steps", lambda x: vision.denoise_tv_chambolle(x, 0.1, 0.0, 12), W.picture(*_CHAMBOLLE, source=f"d{_ROUNDS - 1}", value="v + div"))


def _total_variation(source: str, name: str) -> str:
    """Two dual steps and the smoothed field of a table (image_id, y, x, v)."""
    out = [f"{name}t0 AS MATERIALIZED (SELECT image_id, y, x, v, 0.0::DOUBLE AS p0, 0.0::DOUBLE AS p1 FROM {source})"]
    for k in range(2):
        out += [_divergence(f"{name}t{k}", f"{name}d{k}"), _ascent(f"{name}d{k}", f"{name}t{k + 1}", "div + v / 0.3::DOUBLE", "0.25", "0.25")]
    return ", ".join([*out, _divergence(f"{name}t2", f"{name}d2"), f"{name} AS MATERIALIZED (SELECT image_id, y, x, v + 0.3::DOUBLE * div AS v FROM {name}d2)"])


def _tvl1_warp(k: int) -> str:
    """One warp: components of the flow are images 2 i and 2 i + 1 of ``fw<k>``."""
    median = lambda c, i: T.step(f"fw{k}", f"me{k}", T.ONE, "list_sort(list(q.v))[5]").replace(" AS (", " AS MATERIALIZED (", 1)
    start = f"st{k} AS MATERIALIZED (SELECT a.image_id // 2 AS image_id, a.y, a.x, a.v AS vy, b.v AS vx FROM me{k} a JOIN me{k} b ON b.image_id = a.image_id + 1 AND b.y = a.y AND b.x = a.x WHERE a.image_id % 2 = 0)"
    at = lambda axis, flow: f"least(greatest(f.{axis} + f.{flow}, 0), 7)"
    moved = f"tm{k} AS MATERIALIZED (SELECT f.image_id, f.y, f.x, sum(greatest(0, 1 - abs({at('y', 'vy')} - j.y)) * greatest(0, 1 - abs({at('x', 'vx')} - j.x)) * j.b) AS v FROM st{k} f JOIN j ON j.image_id = f.image_id GROUP BY ALL)"
    slopes = W.both(f"tm{k}", f"ty{k}", W.slope(), _SAME) + ", " + W.both(f"tm{k}", f"tx{k}", _SAME, W.slope())
    rest = f"re{k} AS MATERIALIZED (SELECT s.image_id, s.y, s.x, gy.v AS gy, gx.v AS gx, m.v - (gy.v * s.vy + gx.v * s.vx) - j.a AS rest FROM st{k} s JOIN ty{k} gy USING (image_id, y, x) JOIN tx{k} gx USING (image_id, y, x) JOIN tm{k} m USING (image_id, y, x) JOIN j USING (image_id, y, x))"
    out, now = [median("v", 0), start, moved, slopes, rest, f"it{k}_0 AS MATERIALIZED (SELECT * FROM me{k})"], f"it{k}_0"
    for i in range(3):
        norm, rho = "(r.gy * r.gy + r.gx * r.gx)", "(r.rest + r.gy * a.v + r.gx * b.v)"
        step = f"CASE WHEN abs({rho}) <= 4.5::DOUBLE * {norm} THEN -{rho} / CASE WHEN {norm} = 0 THEN 1 ELSE {norm} END ELSE -sign({rho}) * 4.5::DOUBLE END"
        out.append(f"vv{k}_{i} AS MATERIALIZED (SELECT 2 * r.image_id + c.k AS image_id, r.y, r.x, CASE WHEN c.k = 0 THEN a.v + ({step}) * r.gy ELSE b.v + ({step}) * r.gx END AS v FROM re{k} r JOIN {now} a ON a.image_id = 2 * r.image_id AND a.y = r.y AND a.x = r.x JOIN {now} b ON b.image_id = 2 * r.image_id + 1 AND b.y = r.y AND b.x = r.x CROSS JOIN range(0, 2) AS c(k))")
        now = f"it{k}_{i + 1}"
        out.append(_total_variation(f"vv{k}_{i}", now))
    return ", ".join([*out, f"fw{k + 1} AS MATERIALIZED (SELECT * FROM {now})"])


SQL["optical_flow_tvl1"] = f"WITH {_PAIRS}, fw0 AS MATERIALIZED (SELECT 2 * image_id + k AS image_id, y, x, 0.0::DOUBLE AS v FROM j, range(0, 2) AS g(k)), {_tvl1_warp(0)}, {_tvl1_warp(1)} SELECT image_id // 2 AS image_id, (y + 8 * (image_id % 2))::INT AS y, x, round(v, 6) + 0.0 AS v FROM fw2"


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    labels = map_images(embedding_images(spark, sf).select("image_id", "shape", "img"), lambda x: m.label(x > 0))
    return shapes.filled_images(labels)


C.register("filled_convex_images", _filled, f"""{_LAB}, b AS MATERIALIZED (SELECT image_id * 1000 + label AS g, y, x FROM lab WHERE label > 0), {_HULL},
cell AS MATERIALIZED (SELECT box.image_id * 1000 + box.label AS g, y0, x0, a.k::INT AS y, d.k::INT AS x, a.k IN (y0 - 1, y1 + 1) OR d.k IN (x0 - 1, x1 + 1) AS edge FROM box, range(-1, 9) AS a(k), range(-1, 9) AS d(k) WHERE a.k BETWEEN y0 - 1 AND y1 + 1 AND d.k BETWEEN x0 - 1 AND x1 + 1),
out AS MATERIALIZED (SELECT c.* FROM cell c LEFT JOIN b USING (g, y, x) WHERE b.y IS NULL), flood AS (SELECT g, y, x FROM out WHERE edge UNION SELECT n.g, n.y, n.x FROM flood p JOIN out n ON n.g = p.g AND {_NEAR8})
SELECT (c.g // 1000)::BIGINT AS image_id, (c.g % 1000)::BIGINT AS label, (c.y - c.y0)::INT AS y, (c.x - c.x0)::INT AS x, f.y IS NULL AS filled, v.y IS NOT NULL AS convex FROM cell c LEFT JOIN flood f ON f.g = c.g AND f.y = c.y AND f.x = c.x LEFT JOIN conv v ON v.g = c.g AND v.y = c.y AND v.x = c.x WHERE NOT c.edge""")

# Single thresholds, choices and polygons --------------------------------------------------------------------------------------------

_BINS = 32
_levels32 = lambda x: np.clip(np.floor((x + 1) / 2 * _BINS), 0, _BINS - 1).astype(int)


def _valleys():
    """A kernel: the valley between two peaks of each image's histogram, -1 without one."""
    def kernel(x):
        found = [vision.threshold_minimum(np.bincount(i.ravel(), minlength=32)) for i in np.clip(np.floor((x + 1) / 2 * 32), 0, 31).astype(int)]
        return [-1 if v is None else v for v in found]

    return kernel


_NEXT = f"least(i + 1, {_BINS})"
_PEAK = f"h[i] > h[greatest(i - 1, 1)] AND h[i] >= h[{_NEXT}] AND (h[i] > h[{_NEXT}] OR h[i] > h[CASE WHEN i = {_BINS} THEN 1 ELSE least(i + 2, {_BINS}) END])"
_PEAKS = f"list_filter(range(1, {_BINS + 1}), lambda i: {_PEAK})"
C.per_image("threshold_minimum", _valleys(), f"""WITH RECURSIVE {T.PX}, q AS (SELECT image_id, least(greatest(floor((v + 1) / 2 * {_BINS}), 0), {_BINS - 1})::INT AS b FROM px), c AS (SELECT i.image_id, list(coalesce(n, 0)::DOUBLE ORDER BY g.k) AS h FROM (SELECT DISTINCT image_id FROM q) i CROSS JOIN range(0, {_BINS}) AS g(k) LEFT JOIN (SELECT image_id, b, count(*) AS n FROM q GROUP BY 1, 2) n ON n.image_id = i.image_id AND n.b = g.k GROUP BY 1),
r AS (SELECT image_id, h, 0 AS k, {_PEAKS} AS p FROM c UNION ALL SELECT image_id, h, k, {_PEAKS} FROM (SELECT image_id, list_transform(range(1, {_BINS + 1}), lambda i: (h[greatest(i - 1, 1)] + h[i] + h[{_NEXT}]) / 3) AS h, k + 1 AS k FROM r WHERE len(p) > 2 AND k < 10000)), f AS (SELECT image_id, arg_max(h, k) AS h, arg_max(p, k) AS p FROM r GROUP BY 1)
SELECT image_id, 0 AS y, 0 AS x, (CASE WHEN len(p) = 2 THEN p[1] - 1 + list_position(h[p[1]:p[2]], list_min(h[p[1]:p[2]])) - 1 ELSE -1 END)::DOUBLE AS v FROM f""")
C.per_image("try_all_threshold", lambda x: np.nan_to_num(np.stack(list(vision.try_all_threshold((x + 1) / 2).values()), 1).astype(float), nan=-1.0))
C.per_image("calibrate_denoiser", lambda x: np.stack(vision.calibrate_denoiser(x, filters.gaussian_filter, [{"sigma": 0.3}, {"sigma": 0.6}, {"sigma": 1.2}], 2), 1))


def _simplified():
    """A kernel: which points of each image's first row, as a line over its columns, stay under a tolerance."""
    def kernel(x):
        line = [np.stack([np.arange(8.0), i[0] * 10], 1) for i in x]
        return [np.isin(np.arange(8.0), geometry.approximate_polygon(p, 0.8)[:, 0]).astype(float) for p in line]

    return kernel


C.per_image("approximate_polygon", _simplified())

# Parameters: fill values, origins, modes by axis, volumes ------------------------------------------------------------------------------

f = filters
C.on_images("uniform_filter_cval", lambda x: f.uniform_filter(x, 3, "constant", 0.5), T.pixels(T.step("px", "f", T.ONE, "(sum(q.v) + 0.5 * (9 - count(*))) / 9", "constant")))
C.on_images(
    "median_filter_cval",
    lambda x: f.median_filter(x, 3, None, "constant", -1.0),
    T.pixels(T.step("px", "f", T.ONE, "list_sort(list_concat(list(q.v), list_transform(range(0, 9 - count(*)), lambda k: -1.0::DOUBLE)))[5]", "constant")),
)
C.on_images(
    "maximum_filter_cval",
    lambda x: f.maximum_filter(x, 3, None, "constant", 0.1),
    T.pixels(T.step("px", "f", T.ONE, "CASE WHEN count(*) < 9 THEN greatest(max(q.v), 0.1) ELSE max(q.v) END", "constant")),
)
C.on_images("uniform_filter_axis_modes", lambda x: f.uniform_filter(x, (3, 5), ("nearest", "wrap")), W.separable(W.taps([1 / 3] * 3, mode="nearest"), W.taps([0.2] * 5, mode="wrap")))
C.on_images("gaussian_filter_axis_modes", lambda x: f.gaussian_filter(x, (0.7, 1.2), 0, ("mirror", "constant")), W.separable(W.taps(W.bell(0.7), mode="mirror"), W.taps(W.bell(1.2), mode="constant")))
C.on_images("sobel_axis_modes", lambda x: f.sobel(x, 0, ("wrap", "nearest")), W.separable(W.taps(_DIFF, mode="wrap"), W.taps(_TRI, mode="nearest")))
C.on_images("correlate1d_origin", lambda x: f.correlate1d(x, [1, -2, 4], 1, origin=1), T.linear([(-2, 0, 1), (-1, 0, -2), (0, 0, 4)]))
C.on_images("convolve_origin", lambda x: f.convolve(x, [[1.0, 2.0, 0.5]], origin=(0, -1)), T.linear([(0, 0, 1), (0, -1, 2), (0, -2, 0.5)]))
C.on_images("minimum_filter_origin", lambda x: f.minimum_filter(x, 3, origin=(1, -1)), T.pixels(T.step("px", "f", [(a, b, 1) for a in (-2, -1, 0) for b in (0, 1, 2)], "min(q.v)")))
C.on_images(
    "rank_filter_origin",
    lambda x: f.rank_filter(x, 4, (3, 3), None, "mirror", 0.0, (0, 1)),
    T.pixels(T.step("px", "f", [(a, b, 1) for a in (-1, 0, 1) for b in (-2, -1, 0)], "list_sort(list(q.v))[5]", "mirror")),
)

_CUBES = f"c AS MATERIALIZED (SELECT image_id, y * 8 + x AS p, (y * 8 + x) // 16 AS a, ((y * 8 + x) // 4) % 4 AS b, (y * 8 + x) % 4 AS c, v FROM (WITH {T.PX} SELECT * FROM px))"
_REACH3 = ", ".join(f"({o}, {k}, {W.fold(o + k, 4, 'reflect')})" for o in range(4) for k in (-1, 0, 1))


def _stencil(name: str, kernel, value: str) -> None:
    """A 3x3x3 window over the embeddings as 4x4x4 volumes, reflected at the faces."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        cubes = embedding_images(spark, sf).select("image_id", F.array(F.lit(4), F.lit(4), F.lit(4)).alias("shape"), "img")
        return map_images(cubes, kernel).select("image_id", F.posexplode("img").alias("p", "_v")).select("image_id", "p", (F.round("_v", 6) + F.lit(0.0)).alias("v"))

    C.register(
        name,
        query,
        f"WITH {_CUBES}, t(o, k, i) AS (VALUES {_REACH3}) SELECT p.image_id, p.p::INT AS p, round({value}, 6) + 0.0 AS v FROM c p JOIN t ta ON ta.o = p.a JOIN t tb ON tb.o = p.b JOIN t tc ON tc.o = p.c JOIN c q ON q.image_id = p.image_id AND q.a = ta.i AND q.b = tb.i AND q.c = tc.i GROUP BY 1, 2",
    )


_stencil("uniform_filter_3d", f.uniform_filter, "sum(q.v) / 27")
_stencil("median_filter_3d", f.median_filter, "list_sort(list(q.v))[14]")
_stencil("sobel_3d", lambda x: f.sobel(x, 1), "sum(q.v * tb.k * (2 - abs(ta.k)) * (2 - abs(tc.k)))")
_stencil("laplace_3d", f.laplace, "sum(q.v * CASE abs(ta.k) + abs(tb.k) + abs(tc.k) WHEN 0 THEN -6 WHEN 1 THEN 1 ELSE 0 END)")
_stencil("grey_erosion_3d", lambda x: m.grey_erosion(x, 3), "min(q.v)")
_stencil("grey_dilation_3d", lambda x: m.grey_dilation(x, footprint=m.generate_binary_structure(3, 2)), "max(CASE WHEN abs(ta.k) + abs(tb.k) + abs(tc.k) <= 2 THEN q.v END)")


def _label_volumes(spark: SparkSession, sf: str) -> DataFrame:
    cubes = embedding_images(spark, sf).select("image_id", F.array(F.lit(4), F.lit(4), F.lit(4)).alias("shape"), "img")
    return map_images(cubes, lambda x: m.label(x > 0)).select("image_id", F.posexplode("img").alias("p", "_v")).select("image_id", "p", F.col("_v").cast("int").alias("label"))


C.register(
    "label_3d",
    _label_volumes,
    f"WITH RECURSIVE {_CUBES}, mx AS MATERIALIZED (SELECT * FROM c WHERE v > 0), r AS (SELECT image_id, a, b, c, p, p AS root FROM mx UNION SELECT n.image_id, n.a, n.b, n.c, n.p, r.root FROM r JOIN mx n ON n.image_id = r.image_id AND abs(n.a - r.a) + abs(n.b - r.b) + abs(n.c - r.c) = 1 WHERE r.root < n.p), l AS (SELECT image_id, p, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM (SELECT image_id, p, min(root) AS root FROM r GROUP BY 1, 2)) SELECT c.image_id, c.p::INT AS p, coalesce(l.label, 0)::INT AS label FROM c LEFT JOIN l ON l.image_id = c.image_id AND l.p = c.p",
)

# The same colours by their CSS codes.
_CSS = (
    "aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000 blanchedalmond ffebcd blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887 "
    "cadetblue 5f9ea0 chartreuse 7fff00 chocolate d2691e coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc crimson dc143c cyan 00ffff darkblue 00008b darkcyan 008b8b darkgoldenrod b8860b darkgray a9a9a9 darkgreen 006400 darkgrey a9a9a9 "
    "darkkhaki bdb76b darkmagenta 8b008b darkolivegreen 556b2f darkorange ff8c00 darkorchid 9932cc darkred 8b0000 darksalmon e9967a darkseagreen 8fbc8f darkslateblue 483d8b darkslategray 2f4f4f darkslategrey 2f4f4f darkturquoise 00ced1 darkviolet 9400d3 "
    "deeppink ff1493 deepskyblue 00bfff dimgray 696969 dimgrey 696969 dodgerblue 1e90ff firebrick b22222 floralwhite fffaf0 forestgreen 228b22 fuchsia ff00ff gainsboro dcdcdc ghostwhite f8f8ff gold ffd700 goldenrod daa520 gray 808080 green 008000 greenyellow adff2f grey 808080 "
    "honeydew f0fff0 hotpink ff69b4 indianred cd5c5c indigo 4b0082 ivory fffff0 khaki f0e68c lavender e6e6fa lavenderblush fff0f5 lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6 lightcoral f08080 lightcyan e0ffff lightgoldenrodyellow fafad2 lightgray d3d3d3 lightgreen 90ee90 lightgrey d3d3d3 "
    "lightpink ffb6c1 lightsalmon ffa07a lightseagreen 20b2aa lightskyblue 87cefa lightslategray 778899 lightslategrey 778899 lightsteelblue b0c4de lightyellow ffffe0 lime 00ff00 limegreen 32cd32 linen faf0e6 magenta ff00ff maroon 800000 mediumaquamarine 66cdaa mediumblue 0000cd mediumorchid ba55d3 mediumpurple 9370db "
    "mediumseagreen 3cb371 mediumslateblue 7b68ee mediumspringgreen 00fa9a mediumturquoise 48d1cc mediumvioletred c71585 midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead navy 000080 oldlace fdf5e6 olive 808000 olivedrab 6b8e23 orange ffa500 orangered ff4500 orchid da70d6 "
    "palegoldenrod eee8aa palegreen 98fb98 paleturquoise afeeee palevioletred db7093 papayawhip ffefd5 peachpuff ffdab9 peru cd853f pink ffc0cb plum dda0dd powderblue b0e0e6 purple 800080 red ff0000 rosybrown bc8f8f royalblue 4169e1 saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57 seashell fff5ee sienna a0522d silver c0c0c0 "
    "skyblue 87ceeb slateblue 6a5acd slategray 708090 slategrey 708090 snow fffafa springgreen 00ff7f steelblue 4682b4 tan d2b48c teal 008080 thistle d8bfd8 tomato ff6347 turquoise 40e0d0 violet ee82ee wheat f5deb3 white ffffff whitesmoke f5f5f5 yellow ffff00 yellowgreen 9acd32"
)
_CODES = ", ".join(f"('{n}', '0x{c[:2]}', '0x{c[2:4]}', '0x{c[4:]}')" for n, c in zip(_CSS.split()[::2], _CSS.split()[1::2]))
C.register(
    "color_dict",
    lambda spark, sf: spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", color.palette(F.col("s_suppkey")).alias("c")).select("s_suppkey", "c.name", "c.r", "c.g", "c.b"),
    f"WITH t(name, r, g, b) AS (VALUES {_CODES}), n AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS k, count(*) OVER () AS m FROM t) SELECT s_suppkey, name, round(r::INT / 255, 3) AS r, round(g::INT / 255, 3) AS g, round(b::INT / 255, 3) AS b FROM supplier JOIN n ON k = s_suppkey % m",
)
