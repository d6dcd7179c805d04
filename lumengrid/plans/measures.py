"""Queries of labelled measurements, uneven histograms, users' aggregates and stateful streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, vision
from ..operators import histograms, labelled, regions
from ..operators.runtime import scratch
from ..streaming import images as stream
from ..streaming import stateful
from . import further
from . import weights as W
from .catalog import _LABELS, ORACLE_SQL, _labelled, on_pairs, register, rounded

# Uneven bins ---------------------------------------------------------------------------------

QUANTITY, DISCOUNT = [1.0, 2.0, 5.0, 10.0, 25.0, 26.0, 50.0], [0.0, 0.015, 0.05, 0.1]


def _case(column: str, edges: list[float]) -> str:
    """The bin by comparisons one after another, the last edge included."""
    steps = " ".join(f"WHEN {column} < {b!r}::DOUBLE THEN {k}" for k, b in enumerate(edges[1:]))
    return f"CASE WHEN {column} < {edges[0]!r}::DOUBLE OR {column} > {edges[-1]!r}::DOUBLE THEN NULL {steps} ELSE {len(edges) - 2} END"


def _widths(edges: list[float]) -> str:
    return "[" + ", ".join(f"{b - a!r}::DOUBLE" for a, b in zip(edges, edges[1:])) + "]"


register(
    "histogramdd_edges",
    lambda spark, sf: rounded(histograms.histogramdd(spark.read.parquet(f"{sf}/lineitem.parquet"), {"l_quantity": QUANTITY, "l_discount": DISCOUNT}, weight=F.col("l_tax"), density=True)),
    f"""WITH b AS (SELECT {_case('l_quantity', QUANTITY)} AS p, {_case('l_discount', DISCOUNT)} AS q, l_tax FROM lineitem), c AS (SELECT p, q, sum(l_tax) AS n FROM b WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY 1, 2)
SELECT p AS bin_l_quantity, q AS bin_l_discount, round(n, 6) + 0.0 AS n, round(n / sum(n) OVER () / {_widths(QUANTITY)}[p + 1] / {_widths(DISCOUNT)}[q + 1], 6) + 0.0 AS density FROM c""",
)

# Labels and index ----------------------------------------------------------------------------

_ALL = list(labelled.COLUMNS)
_PIXELS = _LABELS + ", p AS MATERIALIZED (SELECT px.image_id, px.y, px.x, px.v, coalesce(l.label, 0)::BIGINT AS label FROM px LEFT JOIN l ON l.image_id = px.image_id AND l.y = px.y AND l.x = px.x)"


def _shown(df: DataFrame) -> DataFrame:
    """Rounded; what no pixels leave undefined is -1, so that engines agree on it."""
    keys, values = ["image_id", "pos", "label"], [c for c in df.columns if c not in ("image_id", "pos", "label")]
    return rounded(df.select(*keys, *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(-1.0)), F.lit(-1.0)).alias(c) for c in values])).fillna(-1, ["label"])


def _values(source: str) -> str:
    """Every measurement of groups of ``source`` (image_id, pos, label)."""
    nothing = lambda text, other: f"CASE WHEN count(v) = 0 THEN {other} ELSE {text} END"
    row = {
        "sum": nothing("sum(v)", "0.0::DOUBLE"), "mean": nothing("avg(v)", "-1"), "variance": nothing("var_pop(v)", "-1"), "standard_deviation": nothing("stddev_pop(v)", "-1"),
        "minimum": "min(v)", "maximum": "max(v)", "median": "median(v)",
        "com_y": "sum(v * y) / nullif(sum(v), 0)", "com_x": "sum(v * x) / nullif(sum(v), 0)",
    }
    places = {"min_y": "arg_min(y, (v, y, x))", "min_x": "arg_min(x, (v, y, x))", "max_y": "arg_max(y, (v, -y, -x))", "max_x": "arg_max(x, (v, -y, -x))"}
    return f"SELECT image_id, pos, coalesce(label, -1) AS label, {', '.join(f'round(coalesce({t}, -1)::DOUBLE, 6) + 0.0 AS {n}' for n, t in (row | places).items())} FROM {source} GROUP BY image_id, pos, label"


register("measure_whole", lambda spark, sf: _shown(labelled.measure(_labelled(spark, sf), _ALL)), f"{_PIXELS}, g AS (SELECT image_id, 0 AS pos, NULL::BIGINT AS label, v, y, x FROM p) {_values('g')}")
register("measure_pooled", lambda spark, sf: _shown(labelled.measure(_labelled(spark, sf), _ALL, "label")), f"{_PIXELS}, g AS (SELECT DISTINCT i.image_id, 0 AS pos, NULL::BIGINT AS label, p.v, p.y, p.x FROM p i LEFT JOIN p ON p.image_id = i.image_id AND p.label > 0) {_values('g')}")
register("measure_scalar", lambda spark, sf: _shown(labelled.measure(_labelled(spark, sf), _ALL, "label", 2)), f"{_PIXELS}, g AS (SELECT DISTINCT i.image_id, 0 AS pos, 2::BIGINT AS label, p.v, p.y, p.x FROM p i LEFT JOIN p ON p.image_id = i.image_id AND p.label = 2) {_values('g')}")
_INDEX = [3, 1, 1, 99, 0]
register(
    "measure_index",
    lambda spark, sf: _shown(labelled.measure(_labelled(spark, sf), _ALL, "label", _INDEX)),
    f"{_PIXELS}, e(pos, label) AS (VALUES {', '.join(f'({k}, {v}::BIGINT)' for k, v in enumerate(_INDEX))}), g AS (SELECT i.image_id, e.pos, e.label, p.v, p.y, p.x FROM (SELECT DISTINCT image_id FROM p) i CROSS JOIN e LEFT JOIN p ON p.image_id = i.image_id AND p.label = e.label) {_values('g')}",
)


def _geometric_mean(spark: SparkSession, sf: str) -> DataFrame:
    """A user's own aggregate of one label after another: the geometric mean of 2 + v."""
    import numpy as np

    out = labelled.aggregate(_labelled(spark, sf), lambda v: [len(v), np.log(2 + v).sum()], lambda a, b: a + b, lambda s: math.exp(s[1] / s[0]), out="mean double")
    return rounded(out.withColumn("label", F.col("label").cast("long")))


register("labeled_comprehension_user", _geometric_mean, f"{_PIXELS} SELECT image_id, label, round(exp(avg(ln(2 + v))), 6) + 0.0 AS mean FROM p GROUP BY 1, 2")
register(
    "labeled_comprehension_positions",
    lambda spark, sf: labelled.aggregate(_labelled(spark, sf), lambda v, y, x: [y.min(), x.min(), y.max(), x.max()], lambda a, b: [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])], lambda s: (s[2] - s[0] + 1) * (s[3] - s[1] + 1), out="box long", positions=True).withColumn("label", F.col("label").cast("long")),
    f"{_PIXELS} SELECT image_id, label, ((max(y) - min(y) + 1) * (max(x) - min(x) + 1))::BIGINT AS box FROM p GROUP BY 1, 2",
)

# Similarity, borders, transforms ----------------------------------------------------------------

on_pairs("structural_similarity_gaussian", lambda a, b: vision.structural_similarity(a, b, gaussian_weights=True, sigma=0.5, sample_covariance=False).reshape(-1, 1, 1))
_G = [math.exp(-(k * k) / 0.5) for k in range(-2, 3)]
ORACLE_SQL["structural_similarity_gaussian"] = f"""WITH {W.PX}, j AS (SELECT p.image_id // 2 AS image_id, p.y, p.x, p.v AS a, q.v AS b FROM px p JOIN px q ON q.image_id = p.image_id + 1 AND q.y = p.y AND q.x = p.x WHERE p.image_id % 2 = 0),
g(d, w) AS (VALUES {', '.join(f'({k}, {v / sum(_G)!r}::DOUBLE)' for k, v in zip(range(-2, 3), _G))}),
m AS (SELECT c.image_id, c.y, c.x, sum(g.w * h.w * w.a) AS ua, sum(g.w * h.w * w.b) AS ub, sum(g.w * h.w * w.a * w.a) AS aa, sum(g.w * h.w * w.b * w.b) AS bb, sum(g.w * h.w * w.a * w.b) AS ab FROM j c CROSS JOIN g CROSS JOIN g h JOIN j w ON w.image_id = c.image_id AND w.y = c.y + g.d AND w.x = c.x + h.d WHERE c.y BETWEEN 2 AND 5 AND c.x BETWEEN 2 AND 5 GROUP BY ALL)
SELECT image_id, 0 AS y, 0 AS x, round(avg((2 * ua * ub + 0.0004::DOUBLE) * (2 * (ab - ua * ub) + 0.0036::DOUBLE) / ((ua * ua + ub * ub + 0.0004::DOUBLE) * (aa - ua * ua + bb - ub * ub + 0.0036::DOUBLE))), 6) + 0.0 AS v FROM m GROUP BY image_id"""

register(
    "clear_border",
    lambda spark, sf: regions.clear_border(_labelled(spark, sf)).select("image_id", "y", "x", F.col("label").cast("long").alias("label")),
    f"{_PIXELS}, e AS (SELECT DISTINCT image_id, label FROM p WHERE y IN (0, 7) OR x IN (0, 7)) SELECT p.image_id, p.y, p.x, CASE WHEN e.label IS NULL THEN p.label ELSE 0 END AS label FROM p LEFT JOIN e ON e.image_id = p.image_id AND e.label = p.label",
)

_SIMILAR, _RIGID = ([[k * math.cos(0.4), -k * math.sin(0.4), 3.0], [k * math.sin(0.4), k * math.cos(0.4), -2.0], [0.0, 0.0, 1.0]] for k in (1.5, 1.0))
register("SimilarityTransform", further._apply(geometry.SimilarityTransform(scale=1.5, rotation=0.4, translation=(3, -2)).params.tolist()), further._apply_sql(_SIMILAR))
register("EuclideanTransform", further._apply(geometry.EuclideanTransform(rotation=0.4, translation=(3, -2)).params.tolist()), further._apply_sql(_RIGID))

# State and late rows -------------------------------------------------------------------------

GAP, LATE = 6 * 3_600_000, "2 hours"


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Events arrive in order of time in four files; every 97th comes after all others, most of them too late."""
    folder = scratch(spark)
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", (F.col("event_id") % 97 == 0).alias("late"))
    cuts = events.where("not late").select(F.unix_micros("ts").cast("double").alias("t")).approxQuantile("t", [0.25, 0.5, 0.75], 0.01)
    ends = [-math.inf, *cuts, math.inf]
    t = F.unix_micros("ts").cast("double")
    for a, b in zip(ends, ends[1:]):
        events.where((~F.col("late")) & (t > F.lit(a)) & (t <= F.lit(b))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    events.where("late").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    name, provider = stateful.PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        arriving = stream.stream_images(spark, f"{folder}/in", events.schema, 1)
        stream.write(stateful.closed_sessions(arriving, GAP, LATE), f"{folder}/out", f"{folder}/state").awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    text = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd HH:mm:ss").alias(c)
    return rounded(spark.read.parquet(f"{folder}/out").select("user_id", text("start"), text("end"), "n", "v"))


register(
    "stream_closed_sessions",
    _sessions,
    f"""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, value, event_id % 97 = 0 AS late FROM events), w AS (SELECT max(t) FILTER (WHERE NOT late) - 7200000 AS before, max(t) - 7200000 AS final FROM e),
a AS (SELECT user_id, t, value, CASE WHEN t - lag(t) OVER u < {GAP} THEN 0 ELSE 1 END AS begins FROM e, w WHERE NOT late OR t >= before WINDOW u AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT user_id, strftime(make_timestamp(min(t) * 1000), '%Y-%m-%d %H:%M:%S') AS start, strftime(make_timestamp(max(t) * 1000), '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n, round(sum(value), 6) + 0.0 AS v FROM s, w GROUP BY user_id, k, final HAVING max(t) + {GAP} <= final""",
)
