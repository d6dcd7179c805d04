"""Registered queries of the image and signal engine, and their SQL twins.

Image queries read ``embeddings`` as 8x8 images; colour queries read three
columns of ``lineitem`` as channels; label queries use l_suppkey or the sign of
a pixel.  Where a query has a twin in SQL both are registered under one name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, filters, geometry, interpolate, morphology, scalar, signal, vision
from ..operators import histograms, regions, shapes, tiles, views
from ..operators.runtime import map_images, map_pairs, pixels
from ..sources.images import embedding_images, event_signals
from . import twins as T

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def on_images(name: str, kernel, sql: str | None = None) -> None:
    """A query that maps every image by a kernel and returns its pixels."""
    register(name, lambda spark, sf: pixels(map_images(embedding_images(spark, sf).select("image_id", "shape", "img"), kernel)), sql)


def per_image(name: str, kernel, sql: str | None = None) -> None:
    """A query whose kernel returns a few numbers per image, as pixels of a one-row image."""
    on_images(name, lambda x: np.asarray(kernel(x), float).reshape(len(x), 1, -1), sql)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, since engines sum in different orders."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def image_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(embedding_images(spark, sf), digits=None)


def levels(spark: SparkSession, sf: str) -> DataFrame:
    return image_pixels(spark, sf).withColumn("q", histograms.quantised(F.col("v")))


# Linear filters ---------------------------------------------------------------

f = filters
on_images("uniform_filter", f.uniform_filter, T.linear(T.BOX))
on_images("uniform_filter_mirror", lambda x: f.uniform_filter(x, 3, "mirror"), T.linear(T.BOX, "mirror"))
on_images("uniform_filter_nearest", lambda x: f.uniform_filter(x, 3, "nearest"), T.linear(T.BOX, "nearest"))
on_images("uniform_filter_wrap", lambda x: f.uniform_filter(x, 3, "wrap"), T.linear(T.BOX, "wrap"))
on_images("uniform_filter_constant", lambda x: f.uniform_filter(x, 3, "constant"), T.linear(T.BOX, "constant"))
on_images("uniform_filter1d", lambda x: f.uniform_filter1d(x, 5, 2), T.linear([(0, k, 0.2) for k in range(-2, 3)]))
on_images("correlate_nd", lambda x: f.correlate(x, [[1, 2, 0], [0, -1, 3], [0.5, 0, 1]]), T.linear([(-1, -1, 1), (-1, 0, 2), (0, 0, -1), (0, 1, 3), (1, -1, 0.5), (1, 1, 1)]))
on_images("convolve_nd", lambda x: f.convolve(x, [[1, 2, 0], [0, -1, 3], [0.5, 0, 1]]), T.linear([(1, 1, 1), (1, 0, 2), (0, 0, -1), (0, -1, 3), (-1, 1, 0.5), (-1, -1, 1)]))
on_images("correlate1d", lambda x: f.correlate1d(x, [1, -2, 4], 1), T.linear([(-1, 0, 1), (0, 0, -2), (1, 0, 4)]))
on_images("convolve1d", lambda x: f.convolve1d(x, [1, -2, 4], 1), T.linear([(1, 0, 1), (0, 0, -2), (-1, 0, 4)]))
_g = lambda s, o=0: T.odd(f.gaussian_taps(s, o).tolist())
on_images("gaussian_filter1d", lambda x: f.gaussian_filter1d(x, 1.0, 2), T.linear(T.outer([(0, 1.0)], _g(1.0))))
on_images("gaussian_filter", lambda x: f.gaussian_filter(x, 0.7), T.linear(T.outer(_g(0.7), _g(0.7))))
on_images("gaussian_filter_order1", lambda x: f.gaussian_filter(x, 0.7, (1, 0)), T.linear(T.outer(_g(0.7, 1), _g(0.7))))
_lap = [(a, b, w) for a, b, w in T.outer(_g(0.7, 2), _g(0.7)) + T.outer(_g(0.7), _g(0.7, 2))]
on_images("gaussian_laplace", lambda x: f.gaussian_laplace(x, 0.7), T.linear(_lap))
on_images("difference_of_gaussians", lambda x: f.difference_of_gaussians(x, 0.5, 0.8, "reflect"), T.linear(T.outer(_g(0.5), _g(0.5)) + [(a, b, -w) for a, b, w in T.outer(_g(0.8), _g(0.8))]))
on_images("laplace", f.laplace, T.linear([(-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1), (0, 0, -4)]))
_EDGE, _tap = [(-1, -1.0), (1, 1.0)], lambda w: T.odd(list(w))
on_images("ndimage_sobel", lambda x: f.sobel(x, 0), T.linear(T.outer(_EDGE, _tap((1, 2, 1)))))
on_images("ndimage_prewitt", lambda x: f.prewitt(x, 1), T.linear(T.outer(_tap((1, 1, 1)), _EDGE)))


def _magnitude(smooth, scale=0.5):
    s = [(k, w / sum(smooth)) for k, w in _tap(smooth)]
    e = [(k, w * scale) for k, w in _EDGE]
    return T.two(T.step("px", "a", T.outer(e, s)), T.step("px", "b", T.outer(s, e)), "sqrt((a.v * a.v + b.v * b.v) / 2)")


for _name, _smooth in (("sobel", f.SOBEL), ("scharr", f.SCHARR), ("prewitt", f.PREWITT)):
    on_images(_name, lambda x, s=_smooth: f.edge_magnitude(x, s), _magnitude(_smooth))
    on_images(f"{_name}_h", lambda x, s=_smooth: f._edge(x, 0, s), T.linear(T.outer([(k, w / 2) for k, w in _EDGE], [(k, w / sum(_smooth)) for k, w in _tap(_smooth)])))
    on_images(f"{_name}_v", lambda x, s=_smooth: f._edge(x, 1, s), T.linear(T.outer([(k, w / sum(_smooth)) for k, w in _tap(_smooth)], [(k, w / 2) for k, w in _EDGE])))
on_images(
    "farid",
    f.farid,
    T.two(T.step("px", "a", T.outer(_tap(f.FARID_EDGE), _tap(f.FARID_SMOOTH))), T.step("px", "b", T.outer(_tap(f.FARID_SMOOTH), _tap(f.FARID_EDGE))), "sqrt((a.v * a.v + b.v * b.v) / 2)"),
)
on_images("roberts", f.roberts, T.two(T.step("px", "a", [(0, 0, 1), (1, 1, -1)]), T.step("px", "b", [(1, 0, 1), (0, 1, -1)]), "sqrt(a.v * a.v + b.v * b.v) / sqrt(2.0)"))
on_images(
    "gaussian_gradient_magnitude",
    lambda x: f.gaussian_gradient_magnitude(x, 0.7),
    T.two(T.step("px", "a", T.outer(_g(0.7, 1), _g(0.7))), T.step("px", "b", T.outer(_g(0.7), _g(0.7, 1))), "sqrt(a.v * a.v + b.v * b.v)"),
)
on_images("unsharp_mask", lambda x: f.unsharp_mask(x, 0.7, 2.0), T.two(T.step("px", "a", T.outer(_g(0.7), _g(0.7))), T.step("px", "b", [(0, 0, 1)]), "least(greatest(p.v + 2.0 * (p.v - a.v), CASE WHEN min(p.v) OVER (PARTITION BY p.image_id) < 0 THEN -1 ELSE 0 END), 1)"))
on_images(
    "gradient",
    lambda x: f.gradient(x, 1),
    f"WITH {T.PX} SELECT p.image_id, p.y, p.x, round((b.v - a.v) / (b.y - a.y), 6) + 0.0 AS v FROM px p JOIN px a ON a.image_id = p.image_id AND a.x = p.x AND a.y = greatest(p.y - 1, 0) JOIN px b ON b.image_id = p.image_id AND b.x = p.x AND b.y = least(p.y + 1, 7)",
)
on_images("wiener_local", f.wiener_local)
on_images("gabor", lambda x: f.gabor(x, 0.3)[0])
on_images("lpi_filter", lambda x: signal.through_fft(x, lambda s: s * signal.ir2tf(np.full((3, 3), 1 / 9), x.shape[1:])), T.linear(T.BOX, "wrap"))

# Order statistics and morphology ------------------------------------------------

on_images("minimum_filter", f.minimum_filter, T.chain("min"))
on_images("maximum_filter", f.maximum_filter, T.chain("max"))
on_images("minimum_filter1d", lambda x: f.minimum_filter1d(x, 3, 1), T.chain("min", taps=[(-1, 0, 1), (0, 0, 1), (1, 0, 1)]))
on_images("maximum_filter1d", lambda x: f.maximum_filter1d(x, 3, 2), T.chain("max", taps=[(0, -1, 1), (0, 0, 1), (0, 1, 1)]))
_nth = lambda k, taps=T.ONE: T.pixels(T.step("px", "s0", taps, f"list_sort(list(q.v))[{k}]"))
on_images("median_filter", f.median_filter, _nth(5))
on_images("rank_filter", lambda x: f.rank_filter(x, 2), _nth(3))
on_images("rank_filter_footprint", lambda x: f.rank_filter(x, -2, footprint=morphology.diamond(1)), _nth(4, T.CROSS))
on_images("percentile_filter", lambda x: f.percentile_filter(x, 80), _nth(8))
m = morphology
on_images("grey_erosion", m.grey_erosion, T.chain("min"))
on_images("grey_dilation", m.grey_dilation, T.chain("max"))
on_images("grey_opening", m.grey_opening, T.chain("min", "max"))
on_images("grey_closing", m.grey_closing, T.chain("max", "min"))
_open, _close = T.step("px", "a0", T.ONE, "min(q.v)") + ", " + T.step("a0", "a", T.ONE, "max(q.v)"), T.step("px", "b0", T.ONE, "max(q.v)") + ", " + T.step("b0", "b", T.ONE, "min(q.v)")
on_images("white_tophat", m.white_tophat, T.two(_open, _close, "p.v - a.v"))
on_images("black_tophat", m.black_tophat, T.two(_open, _close, "b.v - p.v"))
_min, _max = T.step("px", "a", T.ONE, "min(q.v)"), T.step("px", "b", T.ONE, "max(q.v)")
on_images("morphological_gradient", m.morphological_gradient, T.two(_min, _max, "b.v - a.v"))
on_images("morphological_laplace", m.morphological_laplace, T.two(_min, _max, "b.v + a.v - 2 * p.v"))


def _binary(*aggs: str, taps=T.CROSS) -> str:
    """Outside pixels count as 0: a tap that finds nothing lowers the count."""
    ctes, source = ["bx AS (SELECT image_id, y, x, CASE WHEN v > 0 THEN 1 ELSE 0 END AS v FROM px)"], "bx"
    for k, agg in enumerate(aggs):
        value = f"CASE WHEN sum(q.v) = {len(taps)} THEN 1 ELSE 0 END" if agg == "erode" else "max(q.v)"
        ctes.append(T.step(source, f"s{k}", taps, value, "constant"))
        source = f"s{k}"
    return T.pixels(*ctes)


on_images("binary_erosion", lambda x: m.binary_erosion(x > 0), _binary("erode"))
on_images("binary_dilation", lambda x: m.binary_dilation(x > 0), _binary("dilate"))
on_images("binary_opening", lambda x: m.binary_opening(x > 0), _binary("erode", "dilate"))
on_images("binary_closing", lambda x: m.binary_closing(x > 0), _binary("dilate", "erode"))
on_images("binary_hit_or_miss", lambda x: m.binary_hit_or_miss(x > 0))
on_images("binary_propagation", lambda x: m.binary_propagation(x > 0.2, mask=x > 0))
on_images("binary_fill_holes", lambda x: m.binary_fill_holes(x > 0))
on_images("grey_reconstruction", lambda x: m.reconstruction(x - 0.1, x))
on_images("remove_small_holes", lambda x: m.remove_small_holes(x > 0, 3))
on_images("find_boundaries", lambda x: m.find_boundaries(m.label(x > 0)))

_MASK = "mx AS (SELECT image_id, y, x FROM px WHERE v > 0)"
_REACH = "r AS (SELECT image_id, y, x, y * 8 + x AS root FROM mx UNION SELECT n.image_id, n.y, n.x, r.root FROM r JOIN mx n ON n.image_id = r.image_id AND abs(n.y - r.y) + abs(n.x - r.x) = 1 WHERE r.root < n.y * 8 + n.x)"
_LABELS = f"WITH RECURSIVE {T.PX}, {_MASK}, {_REACH}, l AS (SELECT image_id, y, x, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM (SELECT image_id, y, x, min(root) AS root FROM r GROUP BY 1, 2, 3))"
on_images(
    "label",
    lambda x: m.label(x > 0),
    f"{_LABELS} SELECT px.image_id, px.y, px.x, coalesce(l.label, 0)::DOUBLE AS v FROM px LEFT JOIN l ON l.image_id = px.image_id AND l.y = px.y AND l.x = px.x",
)
on_images(
    "apply_hysteresis_threshold",
    lambda x: m.hysteresis(x, 0.0, 0.2),
    f"{_LABELS} SELECT px.image_id, px.y, px.x, CASE WHEN max(CASE WHEN l.label IS NOT NULL THEN px.v END) OVER (PARTITION BY px.image_id, l.label) > 0.2 THEN 1.0 ELSE 0.0 END AS v FROM px LEFT JOIN l ON l.image_id = px.image_id AND l.y = px.y AND l.x = px.x",
)


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels with the label of their component of positive values, in one pass of the kernel."""
    images = embedding_images(spark, sf).select("image_id", "shape", "img")
    both = map_images(images, lambda x: np.stack([x, m.label(x > 0)], 1))
    one = both.select("image_id", F.posexplode(F.slice("img", 1, 64)).alias("p", "v"), F.slice("img", 65, 64).alias("lab"))
    return one.select("image_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), "v", F.get("lab", F.col("p")).cast("int").alias("label"))


_REGION_SQL = _LABELS + """, g AS (SELECT px.image_id, l.label, count(*) AS n, min(px.y) AS y0, min(px.x) AS x0, max(px.y) + 1 AS y1, max(px.x) + 1 AS x1, avg(px.y) AS cy, avg(px.x) AS cx,
 min(v) AS lo, max(v) AS hi, avg(v) AS mean, sum(px.y * px.y) AS yy, sum(px.x * px.x) AS xx, sum(px.x * px.y) AS xy FROM px JOIN l ON l.image_id = px.image_id AND l.y = px.y AND l.x = px.x GROUP BY 1, 2),
e AS (SELECT *, xx / n - cx * cx AS a, yy / n - cy * cy AS c, cx * cy - xy / n AS b FROM g)
SELECT image_id, label, n AS area, y0 AS bbox_0, x0 AS bbox_1, y1 AS bbox_2, x1 AS bbox_3, round(cy, 6) AS centroid_0, round(cx, 6) AS centroid_1, round(lo, 6) AS min_intensity, round(hi, 6) AS max_intensity, round(mean, 6) AS mean_intensity,
 round((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b), 6) + 0.0 AS inertia_eigval_0, round(4 * sqrt((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)), 6) + 0.0 AS major_axis_length FROM e"""


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    t = regions.region_table(_labelled(spark, sf))
    r = lambda c: (F.round(c, 6) + F.lit(0.0)).alias(c)
    return t.select("image_id", "label", "area", "bbox_0", "bbox_1", "bbox_2", "bbox_3", *map(r, ("centroid_0", "centroid_1", "min_intensity", "max_intensity", "mean_intensity", "inertia_eigval_0", "major_axis_length")))


register("regionprops_table", _regions, _REGION_SQL)
register("regionprops_all", lambda spark, sf: regions.region_table(_labelled(spark, sf)))
register("moments", lambda spark, sf: regions.moments(_labelled(spark, sf).where("label > 0"), 3))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Smooth, threshold by Otsu, label and measure every image."""
    images = embedding_images(spark, sf).select("image_id", "shape", "img")

    def kernel(x: np.ndarray) -> np.ndarray:
        smooth = filters.uniform_filter(x)
        q = np.clip(np.floor((smooth + 1) / 2 * 255.5), 0, 255).astype(int)
        counts = np.stack([np.bincount(i.ravel(), minlength=256) for i in q])
        return np.stack([smooth, morphology.label(q > vision.threshold_otsu(counts)[:, None, None])], 1)

    lab = map_images(images, kernel)
    one = lab.select("image_id", F.posexplode(F.arrays_zip(F.slice("img", 1, 64).alias("v"), F.slice("img", 65, 64).alias("l"))).alias("p", "z"))
    table = one.select("image_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.col("z.v").alias("v"), F.col("z.l").cast("int").alias("label"))
    return regions.region_table(table)


register("smooth_threshold_label_measure", flagship)

# Histograms and thresholds ------------------------------------------------------

_H = f"WITH {T.PX}, {T.QX}, h AS (SELECT image_id, q AS bin, count(*) AS n FROM qx GROUP BY 1, 2)"
_RUN = ", r AS (SELECT *, sum(n) OVER w AS w0, sum(n * bin) OVER w AS s0, sum(n) OVER a AS wa, sum(n * bin) OVER a AS sa, lead(bin) OVER w AS nb FROM h WINDOW w AS (PARTITION BY image_id ORDER BY bin), a AS (PARTITION BY image_id))"


def _hist(spark: SparkSession, sf: str) -> DataFrame:
    return levels(spark, sf).groupBy("image_id", F.col("q").alias("bin")).agg(F.count("*").alias("n"))


register(
    "histogram",
    lambda spark,
    sf: histograms.histogram(image_pixels(spark, sf), 16, -1.0, 1.0),
    f"WITH {T.PX} SELECT image_id, least(floor((v + 1) / 2.0 * 16), 15)::INT AS bin, count(*) AS n FROM px WHERE v BETWEEN -1 AND 1 GROUP BY 1, 2",
)
register(
    "cumulative_distribution",
    lambda spark,
    sf: histograms.cumulative_distribution(_hist(spark, sf)).select("image_id", "bin", "n", F.round("cdf", 9).alias("cdf")),
    _H + " SELECT image_id, bin, n, round(sum(n) OVER (PARTITION BY image_id ORDER BY bin) / sum(n) OVER (PARTITION BY image_id), 9) AS cdf FROM h",
)
register(
    "threshold_otsu",
    lambda spark,
    sf: histograms.threshold_otsu(_hist(spark, sf)),
    _H + _RUN + ", c AS (SELECT image_id, bin, round(w0 * (wa - w0) * (s0 / w0 - (sa - s0) / (wa - w0)) * (s0 / w0 - (sa - s0) / (wa - w0)), 6) AS score FROM r WHERE wa > w0), m AS (SELECT image_id, max(score) AS score FROM c GROUP BY 1), b AS (SELECT c.image_id, min(c.bin) AS t FROM c JOIN m ON c.image_id = m.image_id AND c.score = m.score GROUP BY 1) SELECT h.image_id, coalesce(min(b.t), max(h.bin)) AS threshold FROM h LEFT JOIN b ON b.image_id = h.image_id GROUP BY 1",
)
register(
    "threshold_isodata",
    lambda spark,
    sf: histograms.threshold_isodata(_hist(spark, sf)),
    _H + _RUN + ", c AS (SELECT image_id, bin, coalesce(nb, bin + 1) AS nb, CASE WHEN wa > w0 THEN floor((s0 / w0 + (sa - s0) / (wa - w0)) / 2) END AS t FROM r) SELECT image_id, coalesce(min(CASE WHEN t >= bin AND t < nb THEN t END), max(bin))::INT AS threshold FROM c GROUP BY 1",
)
register("threshold_yen", lambda spark, sf: histograms.threshold_yen(_hist(spark, sf)))
register(
    "threshold_mean",
    lambda spark,
    sf: histograms.threshold_mean(image_pixels(spark, sf)).select("image_id", (F.round("threshold", 9) + F.lit(0.0)).alias("threshold")),
    f"WITH {T.PX} SELECT image_id, round(avg(v), 9) + 0.0 AS threshold FROM px GROUP BY 1",
)
register(
    "shannon_entropy",
    lambda spark,
    sf: histograms.shannon_entropy(levels(spark, sf)).select("image_id", F.round("entropy", 9).alias("entropy")),
    _H + ", p AS (SELECT image_id, n / sum(n) OVER (PARTITION BY image_id) AS p FROM h) SELECT image_id, round(-sum(p * ln(p)) / ln(2.0), 9) AS entropy FROM p GROUP BY 1",
)
register("equalize_hist", lambda spark, sf: histograms.equalize_hist(image_pixels(spark, sf), 64, -1.0, 1.0).select("image_id", "y", "x", F.round("eq", 6).alias("v")))
register(
    "match_histograms",
    lambda spark,
    sf: histograms.match_histograms(levels(spark, sf).select("image_id", "y", "x", F.col("q").cast("double").alias("v")), levels(spark, sf).select(F.col("q").cast("double").alias("v"))).select("image_id", "y", "x", (F.round("matched", 6) + F.lit(0.0)).alias("v")),
)


def _multiotsu(x: np.ndarray) -> list:
    """Two levels per image; null where fewer than three levels occur."""
    found = [vision.threshold_multiotsu(np.bincount(q, minlength=256)) for q in np.clip(np.floor((x.reshape(len(x), -1) + 1) / 2 * 255.5), 0, 255).astype(int)]
    return [None if f is None else np.array([f], float) for f in found]


on_images("threshold_multiotsu", _multiotsu)
for _name, _kernel in (("threshold_li", vision.threshold_li), ("threshold_triangle", lambda x: [vision.threshold_triangle(np.bincount(q, minlength=256)) for q in np.clip(np.floor((x.reshape(len(x), -1) + 1) / 2 * 255.5), 0, 255).astype(int)])):
    per_image(_name, _kernel)
for _name, _kernel in (("threshold_local", lambda x: vision.threshold_local(x, 3, "mean")), ("threshold_niblack", lambda x: vision.threshold_niblack(x, 3)), ("threshold_sauvola", lambda x: vision.threshold_sauvola(x, 3)), ("equalize_adapthist", vision.equalize_adapthist)):
    on_images(
        _name,
        _kernel,
        T.linear(T.BOX) if _name == "threshold_local" else T.pixels(T.step("px", "f", [(a, b, 1) for a, b, _ in T.BOX], "avg(q.v) - 0.2 * sqrt(greatest(avg(q.v * q.v) - avg(q.v) * avg(q.v), 0))", "mirror")) if _name == "threshold_niblack" else None,
    )

# Pixel windows, blocks, pairs ------------------------------------------------------

register(
    "integral_image",
    lambda spark,
    sf: regions.integral_image(image_pixels(spark, sf)).select("image_id", "y", "x", (F.round("integral", 6) + F.lit(0.0)).alias("v")),
    f"WITH {T.PX} SELECT p.image_id, p.y, p.x, round(sum(q.v), 6) + 0.0 AS v FROM px p JOIN px q ON q.image_id = p.image_id AND q.y <= p.y AND q.x <= p.x GROUP BY 1, 2, 3",
)
register(
    "block_reduce",
    lambda spark,
    sf: regions.block_reduce(image_pixels(spark, sf), (2, 4), F.max).select("image_id", "y", "x", F.round("v", 6).alias("v")),
    f"WITH {T.PX} SELECT image_id, (y // 2)::INT AS y, (x // 4)::INT AS x, round(max(v), 6) AS v FROM px GROUP BY ALL",
)
register(
    "block_reduce_mean",
    lambda spark, sf: regions.block_reduce(image_pixels(spark, sf), (3, 5), F.avg).select("image_id", "y", "x", (F.round("v", 6) + F.lit(0.0)).alias("v")),
    f"WITH {T.PX} SELECT image_id, (y // 3)::INT AS y, (x // 5)::INT AS x, round(sum(v) / 15, 6) + 0.0 AS v FROM px GROUP BY ALL",
)
on_images(
    "downscale_local_mean",
    lambda x: interpolate.downscale_local_mean(x, (2, 2)),
    f"WITH {T.PX} SELECT image_id, (y // 2)::INT AS y, (x // 2)::INT AS x, round(avg(v), 6) + 0.0 AS v FROM px GROUP BY ALL",
)
register(
    "rank_order",
    lambda spark,
    sf: regions.rank_order(levels(spark, sf), "image_id", "q").select("image_id", "y", "x", "rank"),
    f"WITH {T.PX}, {T.QX} SELECT image_id, y, x, dense_rank() OVER (PARTITION BY image_id ORDER BY q) - 1 AS rank FROM qx",
)
register(
    "map_array",
    lambda spark,
    sf: regions.map_array(levels(spark, sf).select("image_id", "y", "x", F.col("q").cast("long").alias("v")), spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("in_val"), F.col("p_size").alias("out_val"))).select("image_id", "y", "x", F.col("v").cast("int").alias("v")),
    f"WITH {T.PX}, {T.QX} SELECT image_id, y, x, coalesce(p_size, 0)::INT AS v FROM qx LEFT JOIN part ON p_partkey = q",
)
register(
    "relabel_sequential",
    lambda spark,
    sf: regions.relabel_sequential(levels(spark, sf).withColumn("label", F.floor(F.col("q") / 8).cast("int"))).select("image_id", "y", "x", "new_label"),
    f"WITH {T.PX}, {T.QX} SELECT image_id, y, x, CASE WHEN q // 8 = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY image_id ORDER BY q // 8) END AS new_label FROM qx",
)
register(
    "join_segmentations",
    lambda spark,
    sf: regions.join_segmentations(levels(spark, sf).withColumn("a", (F.col("q") > 127).cast("int")).withColumn("b", F.floor(F.col("y") / 4).cast("int")), "a", "b").select("image_id", "y", "x", "joint"),
    f"WITH {T.PX}, {T.QX} SELECT image_id, y, x, CASE WHEN q <= 127 AND y < 4 THEN 0 ELSE dense_rank() OVER (PARTITION BY image_id, q <= 127 AND y < 4 ORDER BY (q > 127)::INT, y // 4) END::INT AS joint FROM qx",
)
register(
    "remove_small_objects",
    lambda spark,
    sf: regions.remove_small_objects(_labelled(spark, sf), 4).select("image_id", "y", "x", "label"),
    _LABELS + " SELECT px.image_id, px.y, px.x, CASE WHEN l.label IS NULL OR count(l.label) OVER (PARTITION BY px.image_id, l.label) < 4 THEN 0 ELSE l.label END AS label FROM px LEFT JOIN l ON l.image_id = px.image_id AND l.y = px.y AND l.x = px.x",
)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = embedding_images(spark, sf)
    a, b = e.where("image_id % 2 = 0").withColumn("pair", F.floor(F.col("image_id") / 2)), e.where("image_id % 2 = 1").select(F.floor(F.col("image_id") / 2).alias("pair"), F.col("img").alias("other"))
    return a.join(b, "pair").select(F.col("pair").alias("image_id"), "shape", "img", "other")


def _pair_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = image_pixels(spark, sf)
    half = lambda k: p.where(F.col("image_id") % 2 == k).withColumn("image_id", F.floor(F.col("image_id") / 2))
    return regions.pair_metrics(half(0), half(1), 2.0).select("image_id", *[F.round(c, 6).alias(c) for c in ("mse", "nrmse", "psnr")])


register(
    "image_metrics",
    _pair_metrics,
    f"WITH {T.PX}, j AS (SELECT (p.image_id // 2) AS image_id, p.v AS p, q.v AS q FROM px p JOIN px q ON q.image_id = p.image_id + 1 AND q.y = p.y AND q.x = p.x WHERE p.image_id % 2 = 0), g AS (SELECT image_id, avg((p - q) * (p - q)) AS mse, avg(p * p) AS pp FROM j GROUP BY 1) SELECT image_id, round(mse, 6) AS mse, round(sqrt(mse) / sqrt(pp), 6) AS nrmse, round(10 * log10(4.0 / mse), 6) AS psnr FROM g",
)
on_pairs = lambda name, kernel: register(name, lambda spark, sf: pixels(map_pairs(_pairs(spark, sf), kernel, ["image_id"])))
on_pairs("structural_similarity", lambda a, b: vision.structural_similarity(a, b, 3).reshape(-1, 1, 1))
on_pairs("phase_cross_correlation", lambda a, b: vision.phase_cross_correlation(a, b, 4).reshape(len(a), 1, 2))
on_pairs("optical_flow_ilk", lambda a, b: vision.optical_flow_ilk(a, b, 2, 2).reshape(len(a), -1, a.shape[2]))
on_pairs("optical_flow_tvl1", lambda a, b: vision.optical_flow_tvl1(a, b, warps=2, iters=3).reshape(len(a), -1, a.shape[2]))

# Gathers, spectra, features, restoration -------------------------------------------

on_images(
    "shift_nearest",
    lambda x: interpolate.shift(x, (1, -2), 0, "nearest"),
    f"WITH {T.PX} SELECT p.image_id, p.y, p.x, round(q.v, 6) + 0.0 AS v FROM px p JOIN px q ON q.image_id = p.image_id AND q.y = greatest(p.y - 1, 0) AND q.x = least(p.x + 2, 7)",
)
on_images(
    "shift_linear",
    lambda x: interpolate.shift(x, (0.25, 0), 1, "nearest"),
    f"WITH {T.PX} SELECT p.image_id, p.y, p.x, round(0.75 * p.v + 0.25 * q.v, 6) + 0.0 AS v FROM px p JOIN px q ON q.image_id = p.image_id AND q.y = greatest(p.y - 1, 0) AND q.x = p.x",
)
for _name, _kernel in {
    "shift_cubic": lambda x: interpolate.shift(x, (0.5, 0.5), 3, "mirror"), "zoom": lambda x: interpolate.zoom(x, 2, 1), "rotate": lambda x: interpolate.rotate(x, 30, False, 1), "affine_transform": lambda x: interpolate.affine_transform(x, [[1, 0.1], [0.1, 1]], 0, None, 1),
    "map_coordinates": lambda x: interpolate.map_coordinates(x, np.indices((8, 8)) * 0.9, 3, "mirror"), "spline_filter": interpolate.spline_filter, "warp": lambda x: interpolate.warp(x, [[1, 0, 0.5], [0, 1, -0.5], [0, 0, 1]]), "warp_polar": interpolate.warp_polar, "swirl": lambda x: interpolate.swirl(x, strength=2, radius=5),
    "resize": lambda x: interpolate.resize(x, (5, 5)), "rescale": lambda x: interpolate.rescale(x, 1.5), "pyramid_reduce": interpolate.pyramid_reduce, "pyramid_expand": interpolate.pyramid_expand, "pyramid_laplacian": lambda x: list(interpolate.pyramid_laplacian(x, 1))[0],
    "fourier_gaussian": lambda x: signal.through_fft(x, lambda s: signal.fourier_gaussian(s, 1)), "fourier_uniform": lambda x: signal.through_fft(x, lambda s: signal.fourier_uniform(s, 3)), "fourier_ellipsoid": lambda x: signal.through_fft(x, lambda s: signal.fourier_ellipsoid(s, 3)),
    "fftconvolve": lambda x: signal.fftconvolve(x, np.ones((3, 3)), "same"), "hilbert2": lambda x: np.abs(signal.hilbert2(x)), "hessian_matrix_det": vision.hessian_matrix_det, "shape_index": lambda x: np.nan_to_num(vision.shape_index(x)), "structure_tensor_eigenvalues": lambda x: vision.structure_tensor_eigenvalues(x)[0],
    "corner_harris": vision.corner_harris, "corner_shi_tomasi": vision.corner_shi_tomasi, "corner_foerstner": lambda x: vision.corner_foerstner(x)[0], "corner_kitchen_rosenfeld": vision.corner_kitchen_rosenfeld, "canny": lambda x: vision.canny(x, 0.5, 0.05, 0.2),
    "match_template": lambda x: vision.match_template(x, np.eye(3)), "sato": lambda x: vision.ridges(x, (1,)), "meijering": lambda x: vision.ridges(x, (1,), "meijering"), "frangi": lambda x: vision.ridges(x, (1,), "frangi"),
    "denoise_tv_chambolle": vision.denoise_tv_chambolle, "richardson_lucy": lambda x: vision.richardson_lucy((x + 1) / 2, np.full((3, 3), 1 / 9), 5), "wiener_deconvolve": lambda x: vision.wiener_deconvolve(x, np.full((3, 3), 1 / 9), 0.1), "unsupervised_wiener": lambda x: vision.unsupervised_wiener(x, np.full((3, 3), 1 / 9), 20, 5),
    "morphological_chan_vese": lambda x: vision.morphological_chan_vese(x, 5), "morphological_geodesic_active_contour": lambda x: vision.morphological_geodesic_active_contour(vision.inverse_gaussian_gradient(x, 10, 1), 5), "random_noise": vision.random_noise,
}.items():
    on_images(_name, _kernel)
on_images(
    "fourier_shift",
    lambda x: signal.through_fft(x, lambda s: signal.fourier_shift(s, (1, 2))),
    f"WITH {T.PX} SELECT p.image_id, p.y, p.x, round(q.v, 6) + 0.0 AS v FROM px p JOIN px q ON q.image_id = p.image_id AND q.y = (p.y + 7) % 8 AND q.x = (p.x + 6) % 8",
)
on_images("convolve2d", lambda x: signal.convolve2d(x, np.ones((3, 3)), "same"), T.linear(T.ONE, "constant"))
on_images(
    "correlate_valid",
    lambda x: signal.correlate(x, np.ones((3, 3)), "valid", "direct"),
    T.linear(T.ONE, "constant").replace("FROM f", "FROM (SELECT image_id, (y - 1)::INT AS y, (x - 1)::INT AS x, v FROM f WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6)"),
)
per_image("perimeter", lambda x: vision.perimeter(x > 0))
per_image("perimeter_crofton", lambda x: vision.perimeter_crofton(x > 0))
per_image(
    "euler_number",
    lambda x: vision.euler_number(x > 0, 1),
    f"WITH {T.PX}, b AS (SELECT image_id, y, x FROM px WHERE v > 0), i AS (SELECT DISTINCT image_id FROM px), v AS (SELECT image_id, count(*) AS n FROM b GROUP BY 1), e AS (SELECT a.image_id, count(*) AS n FROM b a JOIN b c ON a.image_id = c.image_id AND (c.y = a.y AND c.x = a.x + 1 OR c.x = a.x AND c.y = a.y + 1) GROUP BY 1), f AS (SELECT a.image_id, count(*) AS n FROM b a JOIN b c ON c.image_id = a.image_id AND c.y = a.y + 1 AND c.x = a.x JOIN b d ON d.image_id = a.image_id AND d.y = a.y AND d.x = a.x + 1 JOIN b g ON g.image_id = a.image_id AND g.y = a.y + 1 AND g.x = a.x + 1 GROUP BY 1) SELECT i.image_id, 0 AS y, 0 AS x, (coalesce(v.n, 0) - coalesce(e.n, 0) + coalesce(f.n, 0))::DOUBLE AS v FROM i LEFT JOIN v USING (image_id) LEFT JOIN e USING (image_id) LEFT JOIN f USING (image_id)",
)


def _peaks(spark: SparkSession, sf: str) -> DataFrame:
    images = embedding_images(spark, sf).select("image_id", "shape", "img")

    def kernel(x):
        out = np.zeros_like(x)
        for k, at in enumerate(vision.peak_local_max(x, 1)):
            out[k][tuple(at.T)] = 1
        return out

    return pixels(map_images(images, kernel)).where("v > 0").select("image_id", "y", "x")


register(
    "peak_local_max",
    _peaks,
    f"WITH {T.PX}, n AS (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo FROM px) SELECT p.image_id, p.y, p.x FROM n p JOIN px q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 WHERE p.y BETWEEN 1 AND 6 AND p.x BETWEEN 1 AND 6 GROUP BY p.image_id, p.y, p.x, p.v, p.lo HAVING p.v = max(q.v) AND p.v > p.lo",
)


def _signal(name: str, kernel, sql: str | None = None) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = map_images(event_signals(spark, sf), kernel)
        return out.select("image_id", F.posexplode("img").alias("t", "_v")).select("image_id", "t", (F.round("_v", 6) + F.lit(0.0)).alias("v"))

    register(name, query, sql)


_S = "s AS (SELECT user_id AS image_id, floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600)::INT AS t, sum(value) AS v FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT image_id FROM s WHERE t BETWEEN 0 AND 719), d AS (SELECT u.image_id, g.t::INT AS t, coalesce(s.v, 0) AS v FROM u CROSS JOIN range(0, 720) AS g(t) LEFT JOIN s ON s.image_id = u.image_id AND s.t = g.t)"
_signal(
    "signal_convolve",
    lambda x: signal.convolve(x, [1.0, 2.0, 3.0], "full", "direct"),
    f"WITH {_S}, k(j, w) AS (VALUES (0, 1.0), (1, 2.0), (2, 3.0)) SELECT image_id, (t + j)::INT AS t, round(sum(v * w), 6) + 0.0 AS v FROM d CROSS JOIN k GROUP BY 1, 2",
)
_signal(
    "upfirdn",
    lambda x: signal.upfirdn([1.0, 1.0, 0.5], x, 2, 3),
    f"WITH {_S}, k(j, w) AS (VALUES (0, 1.0), (1, 1.0), (2, 0.5)), f AS (SELECT image_id, t * 2 + j AS n, sum(v * w) AS v FROM d CROSS JOIN k GROUP BY 1, 2), u2 AS (SELECT DISTINCT image_id FROM d) SELECT u2.image_id, g.t::INT AS t, round(coalesce(f.v, 0), 6) + 0.0 AS v FROM u2 CROSS JOIN range(0, 481) AS g(t) LEFT JOIN f ON f.image_id = u2.image_id AND f.n = g.t * 3 WHERE g.t * 3 <= 719 * 2 + 2",
)
_signal("hilbert_envelope", signal.envelope)
_signal("resample", lambda x: signal.resample(x, 360))
_signal("resample_poly", lambda x: signal.resample_poly(x, 2, 3))
_signal("oaconvolve", lambda x: signal.oaconvolve(x, np.array([0.25, 0.5, 0.25]), "same", 128))

# Elementwise ----------------------------------------------------------------------


def _channels(spark: SparkSession, sf: str) -> DataFrame:
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    rgb = color.triple(F.col("l_quantity") / 50, F.abs("l_discount") * 5, F.abs("l_tax") * 10)
    return line.select("l_suppkey", rgb.alias("rgb"))


_RGB = "c AS (SELECT l_suppkey, l_quantity / 50 AS r, abs(l_discount) * 5 AS g, abs(l_tax) * 10 AS b FROM lineitem)"
# Means of the channels and of their squares, so that errors in single rows don't cancel.
_MEAN = "SELECT l_suppkey, " + ", ".join(f"round(avg(c{k}), 6) + 0.0 AS c{k}, round(avg(c{k}::DOUBLE * c{k}), 6) + 0.0 AS q{k}" for k in range(3)) + " FROM o GROUP BY 1"


def _matrix_sql(mat, shift=(0, 0, 0)) -> str:
    cols = ", ".join(f"{row[0]!r}::DOUBLE * r + {row[1]!r}::DOUBLE * g + {row[2]!r}::DOUBLE * b + {float(s)!r}::DOUBLE AS c{k}" for k, (row, s) in enumerate(zip(mat, shift)))
    return f"WITH {_RGB}, o AS (SELECT l_suppkey, {cols} FROM c) {_MEAN}"


def on_colours(name: str, convert, sql: str | None = None) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = _channels(spark, sf).select("l_suppkey", convert(F.col("rgb")).alias("o"))
        mean = lambda c, name: (F.round(F.avg(c), 6) + F.lit(0.0)).alias(name)
        return out.groupBy("l_suppkey").agg(*[x for k, c in enumerate("abc") for x in (mean(F.col("o")[c], f"c{k}"), mean(F.col("o")[c] * F.col("o")[c], f"q{k}"))])

    register(name, query, sql)


_LIN = "l AS (SELECT l_suppkey, " + ", ".join(f"CASE WHEN {v} > 0.04045 THEN pow(({v} + 0.055) / 1.055, 2.4) ELSE {v} / 12.92 END AS {v}" for v in "rgb") + " FROM c)"
_XYZ = "z AS (SELECT l_suppkey, " + ", ".join(f"{a!r}::DOUBLE * r + {b!r}::DOUBLE * g + {c!r}::DOUBLE * b AS {n}" for n, (a, b, c) in zip("xyz", color.XYZ_FROM_RGB)) + " FROM l)"
_LAB = "k AS (SELECT l_suppkey, " + ", ".join(f"CASE WHEN {n} / {w}::DOUBLE > 0.008856 THEN cbrt({n} / {w}::DOUBLE) ELSE 7.787 * ({n} / {w}::DOUBLE) + 16.0 / 116.0 END AS {n}" for n, w in zip("xyz", color.WHITE["D65", "2"])) + " FROM z), o AS (SELECT l_suppkey, 116 * y - 16 AS c0, 500 * (x - y) AS c1, 200 * (y - z) AS c2 FROM k)"
_HSV = "h AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM c), o AS (SELECT l_suppkey, CASE WHEN d = 0 THEN 0 WHEN hi = b THEN (4 + (r - g) / d) / 6 WHEN hi = g THEN (2 + (b - r) / d) / 6 WHEN g < b THEN (g - b) / d / 6 + 1 ELSE (g - b) / d / 6 END AS c0, CASE WHEN hi = 0 THEN 0 ELSE d / hi END AS c1, hi AS c2 FROM h)"
on_colours("rgb2hsv", color.rgb2hsv, f"WITH {_RGB}, {_HSV} {_MEAN}")
on_colours("hsv_round_trip", lambda x: color.let(color.rgb2hsv(x), color.hsv2rgb), f"WITH {_RGB}, o AS (SELECT l_suppkey, r AS c0, g AS c1, b AS c2 FROM c) {_MEAN}")
on_colours("rgb2xyz", color.rgb2xyz, f"WITH {_RGB}, {_LIN}, {_XYZ}, o AS (SELECT l_suppkey, x AS c0, y AS c1, z AS c2 FROM z) {_MEAN}")
on_colours("rgb2lab", color.rgb2lab, f"WITH {_RGB}, {_LIN}, {_XYZ}, {_LAB} {_MEAN}")
for _name, _to, _mat, _add in (("rgb2yuv", color.rgb2yuv, color.YUV_FROM_RGB, (0, 0, 0)), ("rgb2yiq", color.rgb2yiq, color.YIQ_FROM_RGB, (0, 0, 0)), ("rgb2ypbpr", color.rgb2ypbpr, color.YPBPR_FROM_RGB, (0, 0, 0)), ("rgb2ycbcr", color.rgb2ycbcr, color.YCBCR_FROM_RGB, (16, 128, 128)), ("rgb2ydbdr", color.rgb2ydbdr, color.YDBDR_FROM_RGB, (0, 0, 0))):
    on_colours(_name, _to, _matrix_sql(_mat, _add))


def _scalars(name: str, columns, sql: dict[str, str] | None) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        line = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", (F.col("l_quantity") / 50).alias("a"), (F.abs("l_discount") * 10 + 0.01).alias("b"))
        return line.groupBy("l_suppkey").agg(*[(F.round(F.avg(c), 9) + F.lit(0.0)).alias(k) for k, c in columns(F.col("a"), F.col("b")).items()])

    text = None if sql is None else "WITH t AS (SELECT l_suppkey, l_quantity / 50 AS a, abs(l_discount) * 10 + 0.01 AS b FROM lineitem) SELECT l_suppkey, " + ", ".join(f"round(avg({v}), 9) + 0.0 AS {k}" for k, v in sql.items()) + " FROM t GROUP BY 1"
    register(name, query, text)


_scalars(
    "special_functions",
    lambda _a,
    _b: {"entr": scalar.entr(_a), "rel_entr": scalar.rel_entr(_a, _b), "kl_div": scalar.kl_div(_a, _b), "huber": scalar.huber(_b, _a), "pseudo_huber": scalar.pseudo_huber(_b, _a)},
    {"entr": "-a * ln(a)", "rel_entr": "a * ln(a / b)", "kl_div": "a * ln(a / b) - a + b", "huber": "CASE WHEN a <= b THEN 0.5 * a * a ELSE b * (a - 0.5 * b) END", "pseudo_huber": "b * b * (sqrt(1 + (a / b) * (a / b)) - 1)"},
)
_scalars(
    "intensity_adjust",
    lambda _a,
    _b: {"gamma": scalar.adjust_gamma(_a, 2.2), "log": scalar.adjust_log(_a), "sigmoid": scalar.adjust_sigmoid(_a), "rescale": scalar.rescale_intensity(_a, 0.2, 0.8, 0.0, 1.0), "invert": scalar.invert(_a)},
    {"gamma": "pow(a, 2.2)", "log": "log2(1 + a)", "sigmoid": "1 / (1 + exp(10 * (0.5 - a)))", "rescale": "(least(greatest(a, 0.2), 0.8) - 0.2) / (0.8::DOUBLE - 0.2::DOUBLE)", "invert": "1 - a"},
)
_scalars(
    "dtype_convert",
    lambda _a,
    _b: {"ubyte": scalar.img_as_ubyte(_a), "uint16": scalar.img_as_uint(_a), "int16": scalar.img_as_int(_a), "flag": scalar.img_as_bool(_a).cast("double")},
    {"ubyte": "round_even(a * 255, 0)", "uint16": "round_even(a * 65535, 0)", "int16": "round_even(a * 32767.5 - 0.5, 0)", "flag": "(a > 0.5)::INT::DOUBLE"},
)


def _lab_pairs(spark: SparkSession, sf: str) -> DataFrame:
    lab = lambda r, g, b: color.triple(r * 100, g * 200 - 100, b * 200 - 100)
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    q, d, t = F.col("l_quantity") / 50, F.abs("l_discount") * 10, F.abs("l_tax") * 10
    return line.select("l_suppkey", lab(q, d, t).alias("p"), lab(1 - q, t, d).alias("o"))


def _delta_e(spark: SparkSession, sf: str) -> DataFrame:
    p, o = F.col("p"), F.col("o")
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return _lab_pairs(spark, sf).groupBy("l_suppkey").agg(mean(color.deltaE_cie76(p, o), "cie76"), mean(color.deltaE_ciede94(p, o), "ciede94"), mean(color.deltaE_ciede2000(p, o), "ciede2000"), mean(color.deltaE_cmc(p, o), "cmc"))


def hue_differences(spark: SparkSession, sf: str) -> DataFrame:
    return _lab_pairs(spark, sf).groupBy("l_suppkey").agg((F.round(F.avg(color.get_dH2(F.col("p"), F.col("o"))), 6) + F.lit(0.0)).alias("dh2"))


register("delta_e", _delta_e)


def _line_pixels(spark: SparkSession, sf: str) -> DataFrame:
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    return line.select(F.lit(0).alias("image_id"), F.col("l_suppkey").alias("label"), F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("v"))


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    s = regions.label_stats(_line_pixels(spark, sf))
    return s.select("label", "n", "sum", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "standard_deviation", "median", "com_y", "com_x")], "minimum", "maximum", "min_y", "min_x", "max_y", "max_x")


register(
    "label_stats",
    _stats,
    "WITH t AS (SELECT l_suppkey AS label, l_orderkey AS y, l_linenumber AS x, l_quantity AS v FROM lineitem) SELECT label, count(*) AS n, sum(v) AS sum, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(stddev_pop(v), 6) AS standard_deviation, round(median(v), 6) AS median, round(sum(v * y) / sum(v), 6) AS com_y, round(sum(v * x) / sum(v), 6) AS com_x, min(v) AS minimum, max(v) AS maximum, (min({'v': v, 'y': y, 'x': x})).y AS min_y, (min({'v': v, 'y': y, 'x': x})).x AS min_x, (min({'v': -v, 'y': y, 'x': x})).y AS max_y, (min({'v': -v, 'y': y, 'x': x})).x AS max_x FROM t GROUP BY 1",
)
register(
    "labeled_comprehension",
    lambda spark,
    sf: regions.labeled_comprehension(_line_pixels(spark, sf), F.max("v") - F.min("v"), ["label"], "spread"),
    "SELECT l_suppkey AS label, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY 1",
)
register(
    "histogramdd",
    lambda spark,
    sf: histograms.histogramdd(spark.read.parquet(f"{sf}/lineitem.parquet"), {"l_quantity": (5, 0.0, 50.0), "l_extendedprice": (4, 0.0, 100000.0)}),
    "SELECT least(floor(l_quantity / 50.0 * 5), 4)::INT AS bin_l_quantity, least(floor(l_extendedprice / 100000.0 * 4), 3)::INT AS bin_l_extendedprice, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_extendedprice BETWEEN 0 AND 100000 GROUP BY 1, 2",
)
register(
    "labelled_histogram",
    lambda spark,
    sf: histograms.histogram(spark.read.parquet(f"{sf}/lineitem.parquet"), 10, 0.0, 50.0, "l_suppkey", "l_quantity"),
    "SELECT l_suppkey, least(floor(l_quantity / 50.0 * 10), 9)::INT AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1, 2",
)
register(
    "ravel_multi_index",
    lambda spark,
    sf: spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", scalar.ravel_multi_index([F.col("o_orderkey") - 100, F.col("o_custkey")], [7, 11]).alias("flat")),
    "SELECT o_orderkey, (((o_orderkey - 100) % 7 + 7) % 7) * 11 + o_custkey % 11 AS flat FROM orders",
)

# Tiles, overlays, descriptors ---------------------------------------------------------


def _tiled(spark: SparkSession, sf: str) -> DataFrame:
    parts = tiles.split(embedding_images(spark, sf).select("image_id", "shape", "img"), 3, 1)
    px = tiles.tile_pixels(tiles.map_tiles(parts, filters.uniform_filter, 1))
    return px.withColumn("v", F.round("v", 6) + F.lit(0.0))


register("tiled_uniform_filter", _tiled, ORACLE_SQL["uniform_filter"])


def _tiled_label(spark: SparkSession, sf: str) -> DataFrame:
    parts = tiles.split(embedding_images(spark, sf).select("image_id", "shape", "img"), 3, 0)
    return tiles.label_tiles(parts.withColumn("img", F.transform("img", lambda v: (v > 0).cast("double"))))


register("tiled_label", _tiled_label, _LABELS + " SELECT image_id, y, x, label FROM l")
on_images("mark_boundaries", lambda x: vision.mark_boundaries(x, morphology.label(x > 0)).reshape(len(x), x.shape[1], -1))
on_images("mark_boundaries_outline", lambda x: vision.mark_boundaries(x, morphology.label(x > 0), (1, 0, 0), (0, 0, 1), "inner").reshape(len(x), x.shape[1], -1))
on_images("find_boundaries_outer", lambda x: morphology.find_boundaries(morphology.label(x > 0), mode="outer"))
on_images("find_boundaries_subpixel", lambda x: morphology.find_boundaries(morphology.label(x > 0), mode="subpixel"))
on_images("daisy", lambda x: vision.daisy(x, 2, 2, 1, 4, 4).reshape(len(x), -1, 20))
per_image("moments_hu", lambda x: vision.image_moments_hu(x + 1))
per_image("convex_area", lambda x: [geometry.convex_area(i > 0) for i in x])
per_image("feret_diameter_max", lambda x: [geometry.feret_diameter_max(i > 0) for i in x])
on_pairs("masked_registration", lambda a, b: vision.masked_registration(a, b, a > -0.2, b > -0.2).reshape(len(a), 1, 2))
on_colours("adapt_rgb_each_channel", lambda x: color.adapt_rgb(x, lambda v: v * v), f"WITH {_RGB}, o AS (SELECT l_suppkey, r * r AS c0, g * g AS c1, b * b AS c2 FROM c) {_MEAN}")
register(
    "label2rgb",
    lambda spark,
    sf: _labelled(spark, sf).select("image_id", "y", "x", color.label2rgb(F.col("label"), (F.col("v") + 1) / 2).alias("c")).select("image_id", "y", "x", *[F.round(f"c.{k}", 6).alias(k) for k in "abc"]),
)

# Region shapes, views, slices ----------------------------------------------------------

_MOMENTS = ["centroid_0", "centroid_1", *[f"mu_{k}" for k in ("2_0", "1_1", "0_2", "3_0", "2_1", "1_2", "0_3")], *[f"nu_{k}" for k in ("2_0", "1_1", "0_2", "3_0", "0_3")], *[f"hu_{k}" for k in range(7)]]


def _region_moments(weight):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        found = shapes.region_moments(_labelled(spark, sf).where("label > 0"), weight and weight())
        return found.select("image_id", "label", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in _MOMENTS])

    return query


register("region_moments", _region_moments(None))
register("region_moments_weighted", _region_moments(lambda: F.col("v") + 1), _LABELS + """, t AS (SELECT px.image_id, l.label, px.y::DOUBLE AS y, px.x::DOUBLE AS x, px.v + 1 AS w FROM px JOIN l ON l.image_id = px.image_id AND l.y = px.y AND l.x = px.x),
c AS (SELECT image_id, label, sum(w) AS m, sum(w * y) / sum(w) AS cy, sum(w * x) / sum(w) AS cx FROM t GROUP BY 1, 2),
d AS (SELECT image_id, label, m, cy, cx, w, y - cy AS a, x - cx AS b FROM t JOIN c USING (image_id, label)),
g AS (SELECT image_id, label, m, cy AS centroid_0, cx AS centroid_1, sum(w * a * a) AS mu_2_0, sum(w * a * b) AS mu_1_1, sum(w * b * b) AS mu_0_2, sum(w * a * a * a) AS mu_3_0, sum(w * a * a * b) AS mu_2_1, sum(w * a * b * b) AS mu_1_2, sum(w * b * b * b) AS mu_0_3 FROM d GROUP BY 1, 2, 3, 4, 5),
n AS (SELECT *, mu_2_0 / pow(m, 2) AS nu_2_0, mu_1_1 / pow(m, 2) AS nu_1_1, mu_0_2 / pow(m, 2) AS nu_0_2, mu_3_0 / pow(m, 2.5) AS nu_3_0, mu_2_1 / pow(m, 2.5) AS nu_2_1, mu_1_2 / pow(m, 2.5) AS nu_1_2, mu_0_3 / pow(m, 2.5) AS nu_0_3 FROM g),
h AS (SELECT *, nu_3_0 + nu_1_2 AS p, nu_2_1 + nu_0_3 AS q, nu_3_0 - 3 * nu_1_2 AS r, 3 * nu_2_1 - nu_0_3 AS s, nu_2_0 - nu_0_2 AS e FROM n),
i AS (SELECT *, nu_2_0 + nu_0_2 AS hu_0, e * e + 4 * nu_1_1 * nu_1_1 AS hu_1, r * r + s * s AS hu_2, p * p + q * q AS hu_3, r * p * (p * p - 3 * q * q) + s * q * (3 * p * p - q * q) AS hu_4, e * (p * p - q * q) + 4 * nu_1_1 * p * q AS hu_5, s * p * (p * p - 3 * q * q) - r * q * (3 * p * p - q * q) AS hu_6 FROM h)
SELECT image_id, label, """ + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _MOMENTS) + " FROM i")  # fmt: skip


def _shapes(spark: SparkSession, sf: str) -> DataFrame:
    labels = map_images(embedding_images(spark, sf).select("image_id", "shape", "img"), lambda x: m.label(x > 0))
    found = shapes.region_shapes(labels)
    return found.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


register("region_shapes", _shapes)
register(
    "crop",
    lambda spark,
    sf: views.crop(image_pixels(spark, sf), ((1, 2), (2, 1)), (8, 8)),
    f"WITH {T.PX} SELECT image_id, y - 1 AS y, x - 2 AS x, v FROM px WHERE y BETWEEN 1 AND 5 AND x BETWEEN 2 AND 6",
)
register("view_as_blocks", lambda spark, sf: views.view_as_blocks(image_pixels(spark, sf), (2, 4)), f"WITH {T.PX} SELECT image_id, y // 2 AS by, x // 4 AS bx, y % 2 AS y, x % 4 AS x, v FROM px")
register(
    "view_as_windows",
    lambda spark,
    sf: views.view_as_windows(image_pixels(spark, sf), (3, 2), (8, 8), 2),
    f"WITH {T.PX} SELECT image_id, a.k AS wy, b.k AS wx, y - 2 * a.k AS y, x - 2 * b.k AS x, v FROM px, range(0, 3) AS a(k), range(0, 4) AS b(k) WHERE y BETWEEN 2 * a.k AND 2 * a.k + 2 AND x BETWEEN 2 * b.k AND 2 * b.k + 1",
)
register(
    "apply_along_axis",
    lambda spark,
    sf: pixels(views.apply_along_axis(embedding_images(spark, sf).select("image_id", "shape", "img"), np.sort, 1)),
    f"WITH {T.PX} SELECT image_id, y, (row_number() OVER (PARTITION BY image_id, y ORDER BY v) - 1)::INT AS x, round(v, 6) + 0.0 AS v FROM px",
)
register(
    "is_low_contrast",
    lambda spark,
    sf: views.is_low_contrast(image_pixels(spark, sf), 0.55),
    f"WITH {T.PX} SELECT image_id, quantile_cont(v, 0.99) - quantile_cont(v, 0.01) < 0.55 AS low_contrast FROM px GROUP BY image_id",
)
register("intensity_range", lambda spark, sf: views.intensity_range(image_pixels(spark, sf)), f"WITH {T.PX} SELECT image_id, min(v) AS low, max(v) AS high FROM px GROUP BY image_id")
register(
    "entropy",
    lambda spark,
    sf: views.entropy(levels(spark, sf), ["image_id"], F.col("q"), base=2).select("image_id", F.round("entropy", 9).alias("entropy")),
    f"WITH {T.PX}, {T.QX}, p AS (SELECT image_id, q / sum(q) OVER (PARTITION BY image_id) AS p FROM qx) SELECT image_id, round(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(2.0), 9) AS entropy FROM p GROUP BY image_id",
)
register(
    "relative_entropy",
    lambda spark,
    sf: views.entropy(levels(spark, sf), ["image_id"], F.col("q"), F.col("x") + 1).select("image_id", F.round("entropy", 9).alias("entropy")),
    f"WITH {T.PX}, {T.QX}, p AS (SELECT image_id, q / sum(q) OVER (PARTITION BY image_id) AS p, (x + 1) / sum(x + 1) OVER (PARTITION BY image_id) AS r FROM qx) SELECT image_id, round(sum(CASE WHEN p > 0 THEN p * ln(p / r) ELSE 0 END), 9) AS entropy FROM p GROUP BY image_id",
)
register(
    "histogram2d",
    lambda spark,
    sf: views.histogram2d(spark.read.parquet(f"{sf}/lineitem.parquet"), ("l_quantity", 7, 1.0, 50.0), ("l_extendedprice", 9, 0.0, 90000.0), ["l_returnflag"]),
    "SELECT l_returnflag, least(floor((l_quantity - 1.0::DOUBLE) / 49.0::DOUBLE * 7), 6)::INT AS bin_l_quantity, least(floor(l_extendedprice / 90000.0::DOUBLE * 9), 8)::INT AS bin_l_extendedprice, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_extendedprice BETWEEN 0 AND 90000 GROUP BY 1, 2, 3",
)
on_images("convolve_separable", lambda x: f.convolve_separable(x, (0.25, 0.5, 0.25)), T.linear(T.outer(_tap((0.25, 0.5, 0.25)), _tap((0.25, 0.5, 0.25)))))
on_images(
    "smooth_with_function_and_mask",
    lambda x: f.smooth_with_function_and_mask(x, lambda a: f.correlate(a, np.full((3, 3), 1 / 9)), x > 0),
    T.pixels(T.step("px", "f", T.BOX, "sum(CASE WHEN q.v > 0 THEN w * q.v ELSE 0 END) / (sum(CASE WHEN q.v > 0 THEN w ELSE 0 END) + 2.220446049250313e-16)")),
)
on_images("sobel_masked", lambda x: f.masked_edges(lambda a: f.edge_magnitude(a, f.SOBEL), x, x > -0.2))
on_images(
    "correlate2d",
    lambda x: signal.correlate2d(x, [[1.0, 2, 0], [0, -1, 3], [0.5, 0, 1]], "same"),
    T.linear([(-1, -1, 1), (-1, 0, 2), (0, 0, -1), (0, 1, 3), (1, -1, 0.5), (1, 1, 1)], "constant"),
)
_box = lambda r, c: ((abs(r) <= 1) & (abs(c) <= 1)) / 9
on_images("lpi_forward", lambda x: signal.LPIFilter2D(_box)(x), T.pixels(T.step("px", "f", T.BOX, "sum(w * q.v)", "constant"), value="abs(v)"))
on_images("lpi_inverse", lambda x: signal.LPIFilter2D(_box).inverse(x))
on_images("lpi_wiener", lambda x: signal.LPIFilter2D(_box).wiener(x))
on_images("hessian_ridges", lambda x: vision.hessian_ridges(x, (1,)))
on_images("hessian_eigenvalues", lambda x: vision.compute_hessian_eigenvalues(x, 1.0, "abs")[1])
on_images(
    "dilation_star",
    lambda x: m.grey_dilation(x, footprint=m.star(2)),
    T.chain("max", taps=[(a, b, 1) for a in range(-3, 4) for b in range(-3, 4) if max(abs(a), abs(b)) <= 2 or abs(a) + abs(b) <= 3]),
)
on_images("erosion_ellipse", lambda x: m.grey_erosion(x, footprint=m.ellipse(2, 1)), T.chain("min", taps=[(a, b, 1) for a in (-1, 0, 1) for b in range(-2, 3) if a * a / 4 + b * b / 9 < 1]))
