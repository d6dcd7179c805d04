"""Histograms, thresholds and intensity maps from grouped counts.

All work on a pixel table (image_id, ..., v): one partial aggregation to
(image, bin) counts, then windows over at most ``bins`` rows an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantised(v: Column, lo: float = -1.0, hi: float = 1.0, levels: int = 256) -> Column:
    """The level 0 .. levels - 1 of a value in lo .. hi."""
    return F.least(F.greatest(F.floor((v - lo) / (hi - lo) * (levels - 0.5)), F.lit(0)), F.lit(levels - 1)).cast("int")


def histogram(px: DataFrame, bins: int, lo: float, hi: float, key: str = "image_id", value: str = "v", weight: Column | None = None) -> DataFrame:
    """(key, bin, n): equal bins, the last one closed; values outside are left out."""
    v = F.col(value)
    b = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return px.where(v.between(lo, hi)).groupBy(key, b.alias("bin")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))


#: Edges of one step of a lookup.
FAN = 32


def bin_of(v: Column, edges: list[float]) -> Column:
    """The bin of a value between ascending edges, each closed below and the last one above too; null outside (nan as well).

    A search tree of comparisons over every ``FAN``-th edge, then a count
    within those: no join, and it stays in generated code.
    """
    e = [float(x) for x in edges]
    if len(e) < 2 or any(a > b for a, b in zip(e, e[1:])):
        raise ValueError("edges must ascend, and be two at least")

    def reached(edges: list[float], lo: int, hi: int) -> Column:
        """Number of edges at or below v, known to be in lo .. hi."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v < edges[mid], reached(edges, lo, mid)).otherwise(reached(edges, mid + 1, hi))

    if len(e) <= FAN * FAN:
        at = reached(e, 0, len(e))
    else:
        parts = [e[k : k + FAN] for k in range(0, len(e), FAN)]
        part = reached([p[0] for p in parts], 0, len(parts)) - 1
        inner = F.get(F.array(*[F.array(*[F.lit(x) for x in p]) for p in parts]), part)
        at = F.when(part < 0, 0).otherwise(part * FAN + F.size(F.filter(inner, lambda x: x <= v)))
    last = len(e) - 2
    return F.when((v >= e[0]) & (v < e[-1]), at - 1).when(v == e[-1], last).cast("int")


def histogramdd(px: DataFrame, columns: dict[str, tuple[int, float, float] | list[float]], keys: list[str] = [], weight: Column | None = None, density: bool = False) -> DataFrame:
    """Counts over a grid: a bin column for each of the named columns.

    A column has equal bins, as a tuple (bins, lo, hi), or a list of ascending
    edges.  ``weight`` is summed instead of counted; ``density`` divides by the
    sum (of each key) and the size of the cell (a column ``density``).
    """
    cells, sizes = [], F.lit(1.0)
    for name, bins in columns.items():
        v = F.col(name)
        if isinstance(bins, tuple):
            n, lo, hi = bins
            cell = F.when(v.between(lo, hi), F.least(F.floor((v - lo) / (hi - lo) * n), F.lit(n - 1))).cast("int")
            size = F.lit((hi - lo) / n)
        else:
            cell = bin_of(v, bins)
            size = F.get(F.array(*[F.lit(float(b) - float(a)) for a, b in zip(bins, bins[1:])]), F.col(f"bin_{name}"))
        cells.append(cell.alias(f"bin_{name}"))
        sizes = sizes * size
    counted = px.select(*keys, *cells, (F.lit(1) if weight is None else weight).alias("_w"))
    counted = counted.where(" and ".join(f"bin_{c} is not null" for c in columns)) if columns else counted
    out = counted.groupBy(*keys, *[f"bin_{c}" for c in columns]).agg((F.count("*") if weight is None else F.sum("_w")).alias("n"))
    if not density:
        return out
    # Cells are few: their sum by key is a second aggregation of the result.
    whole = out.groupBy(*keys).agg(F.sum("n").alias("_all"))
    out = out.join(whole, keys) if keys else out.withColumn("_all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    return out.withColumn("density", F.col("n") / F.col("_all") / sizes).drop("_all")


def cumulative_distribution(hist: DataFrame, key: str = "image_id") -> DataFrame:
    """Adds cdf (0 to 1) to (key, bin, n)."""
    w = Window.partitionBy(key)
    return hist.withColumn("cdf", F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w))


def _running(hist: DataFrame, key: str) -> DataFrame:
    """Below and above each bin: counts (w0, w1) and value sums (s0, s1), the bin itself below."""
    w = Window.partitionBy(key)
    up = w.orderBy("bin")
    v = F.col("bin") * F.col("n")
    out = hist.withColumn("w0", F.sum("n").over(up)).withColumn("s0", F.sum(v).over(up)).withColumn("_w", F.sum("n").over(w)).withColumn("_s", F.sum(v).over(w))
    return out.withColumn("w1", F.col("_w") - F.col("w0")).withColumn("s1", F.col("_s") - F.col("s0"))


def _first_best(scored: DataFrame, key: str, score: str) -> DataFrame:
    """The least bin of the highest score; a single occupied bin is its own threshold."""
    best = F.max_by("bin", F.struct(F.col(score), -F.col("bin")))
    return scored.groupBy(key).agg(F.coalesce(best, F.max("bin")).alias("threshold"))


def threshold_otsu(hist: DataFrame, key: str = "image_id") -> DataFrame:
    r = _running(hist, key).where("w1 > 0 or _w = n")
    d = F.col("s0") / F.col("w0") - F.col("s1") / F.when(F.col("w1") > 0, F.col("w1"))
    return _first_best(r.withColumn("score", F.round(F.col("w0") * F.col("w1") * d * d, 6)), key, "score")


def threshold_isodata(hist: DataFrame, key: str = "image_id") -> DataFrame:
    """The least level t with t <= (mean below + mean above) / 2 < t + 1, over every level up to the next occupied one."""
    w = Window.partitionBy(key).orderBy("bin")
    r = _running(hist, key).withColumn("next", F.coalesce(F.lead("bin").over(w), F.col("bin") + 1))
    middle = F.floor((F.col("s0") / F.col("w0") + F.col("s1") / F.when(F.col("w1") > 0, F.col("w1"))) / 2)
    r = r.withColumn("t", middle)
    fits = F.when((F.col("t") >= F.col("bin")) & (F.col("t") < F.col("next")), F.col("t"))
    return r.groupBy(key).agg(F.coalesce(F.min(fits), F.max("bin")).cast("int").alias("threshold"))


def threshold_yen(hist: DataFrame, key: str = "image_id") -> DataFrame:
    w = Window.partitionBy(key)
    up = w.orderBy("bin")
    p = hist.withColumn("p", F.col("n") / F.sum("n").over(w))
    # Names differ by more than case: Spark would take "P" for "p".
    p = p.withColumn("below", F.sum("p").over(up)).withColumn("q0", F.sum(F.col("p") * F.col("p")).over(up)).withColumn("q1", F.sum(F.col("p") * F.col("p")).over(w) - F.col("q0")).withColumn("_last", F.max("bin").over(w))
    good = (F.col("bin") < F.col("_last")) & (F.col("q1") > 1e-12)
    score = F.when(good, F.round(-F.log(F.col("q0") * F.col("q1")) + 2 * F.log(F.col("below") * (1 - F.col("below"))), 9))
    return _first_best(p.withColumn("score", score).where("score is not null or bin = _last"), key, "score")


def threshold_mean(px: DataFrame, key: str = "image_id", value: str = "v") -> DataFrame:
    return px.groupBy(key).agg(F.avg(value).alias("threshold"))


def shannon_entropy(px: DataFrame, key: str = "image_id", value: str = "q", base: float = 2.0) -> DataFrame:
    counts = px.groupBy(key, value).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    return counts.withColumn("p", p).groupBy(key).agg((-F.sum(F.col("p") * F.log("p")) / F.log(F.lit(base))).alias("entropy"))


def equalize_hist(px: DataFrame, bins: int, lo: float, hi: float, key: str = "image_id", value: str = "v") -> DataFrame:
    """Each value by the cdf interpolated between bin centres."""
    cdf = cumulative_distribution(histogram(px, bins, lo, hi, key, value), key)
    width = (hi - lo) / bins
    # An occupied bin holds up to the next one: at most ``bins`` rows an image.
    until = F.coalesce(F.lead("bin").over(Window.partitionBy(key).orderBy("bin")) - 1, F.lit(bins - 1))
    dense = cdf.withColumn("_until", until).select(key, "cdf", F.explode(F.sequence("bin", "_until")).alias("b"))
    curve = dense.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "cdf"))).alias("curve"))
    at = (F.col(value) - lo) / width - 0.5
    left = F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(bins - 1)).cast("int")
    right = F.least(left + 1, F.lit(bins - 1))
    part = F.least(F.greatest(at - left, F.lit(0.0)), F.lit(1.0))
    get = lambda k: F.coalesce(F.try_element_at("curve", k), F.lit(0.0))
    return px.join(curve, key).withColumn("eq", get(left) + (get(right) - get(left)) * part).drop("curve")


#: Parts of a value range, and of quantiles, that prefix sums and lookups are dealt over.
PARTS = 256


def quantiles(values: DataFrame, value: str = "v") -> DataFrame:
    """(value, q): every distinct value with the share of rows up to it.

    Counts are grouped first; values are cut at PARTS approximate quantiles, so
    that the running sum goes part by part with PARTS known offsets.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    cuts = counts.select(F.percentile_approx(value, [k / PARTS for k in range(1, PARTS)])).first()[0] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    counts = counts.withColumn("_part", F.size(F.filter(bounds, lambda b: b < F.col(value))))
    sizes, total = {r[0]: r[1] for r in counts.groupBy("_part").agg(F.sum("n")).collect()}, 0  # PARTS rows
    base = {}
    for k in sorted(sizes):
        base[k], total = total, total + sizes[k]
    offsets = F.create_map(*[F.lit(x) for k in base for x in (k, base[k])]) if base else F.lit(None).cast("map<int,bigint>")
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy(value)) + F.element_at(offsets, F.col("_part"))
    return counts.select(value, (upto / max(total, 1)).alias("q"))


def match_histograms(px: DataFrame, reference: DataFrame, key: str = "image_id", value: str = "v") -> DataFrame:
    """Maps each image's values to those of equal quantile in the reference (one set of values).

    Between two quantiles of the reference values are interpolated.  Each step
    of the reference is listed under the PARTS of the quantile range that it
    touches, so the lookup is an equi-join.  An empty reference gives no rows.
    """
    w = Window.partitionBy(key)
    own = px.groupBy(key, value).agg(F.count("*").alias("n")).withColumn("q", F.sum("n").over(w.orderBy(value)) / F.sum("n").over(w))
    part = lambda q: F.least(F.floor(q * PARTS), F.lit(PARTS - 1)).cast("int")
    one = quantiles(reference, value).withColumn("_part", part(F.col("q")))
    # The step before: the last of this part's, or of the nearest part before it, of which one row each is needed.
    ends = one.groupBy("_part").agg(F.max(F.struct("q", F.col(value).alias("v"))).alias("e")).collect()  # PARTS rows
    before = {k: max((tuple(r[1]) for r in ends if r[0] < k), default=None) for k in {r[0] for r in ends}}
    known = {k: v for k, v in before.items() if v}
    last = F.create_map(*[x for k, (q, v) in known.items() for x in (F.lit(k), F.struct(F.lit(q).alias("q"), F.lit(float(v)).alias("v")))]) if known else F.lit(None).cast("map<int,struct<q:double,v:double>>")
    inside = Window.partitionBy("_part").orderBy("q")
    prior = F.coalesce(F.lag(F.struct("q", F.col(value).cast("double").alias("v"))).over(inside), F.try_element_at(last, F.col("_part")))
    steps = one.select(F.col("q").alias("q1"), F.col(value).alias("v1"), prior.alias("p"))
    steps = steps.select("q1", "v1", F.coalesce(F.col("p.q"), F.lit(0.0)).alias("q0"), F.coalesce(F.col("p.v"), F.col("v1")).alias("v0"))
    steps = steps.withColumn("_part", F.explode(F.sequence(part(F.col("q0")), part(F.col("q1")))))
    hit = own.withColumn("_part", part(F.col("q"))).join(steps, "_part").where((F.col("q") > F.col("q0")) & (F.col("q") <= F.col("q1")))
    new = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("q") - F.col("q0")) / (F.col("q1") - F.col("q0"))
    return px.join(hit.select(key, value, new.alias("matched")), [key, value])
