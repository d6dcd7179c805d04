"""Labelled aggregation and region tables: groupBy over (image, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["image_id", "label"]


def label_stats(px: DataFrame, keys: list[str] = KEYS, value: str = "v") -> DataFrame:
    """Sum, mean, variance, extrema with positions (first in raster order), median, centre of mass.

    One partial aggregation of the pixels; the median comes from counts of
    distinct values, so no task receives the pixels of a label.
    """
    v = F.col(value)
    g = px.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("standard_deviation"),
        F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), F.col("y").alias("y"), F.col("x").alias("x")))).alias("_lo"), F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x")))).alias("_hi"),
        F.sum(v * F.col("y")).alias("_vy"), F.sum(v * F.col("x")).alias("_vx"),
    )
    counts = px.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*keys)
    upto, whole = F.sum("_n").over(own.orderBy("_v")), F.sum("_n").over(own)
    ranked = counts.withColumn("_to", upto).withColumn("_all", whole)
    # The one or two values in the middle: ranks (n + 1) / 2 rounded down and up.
    middle = [F.min(F.when(F.col("_to") >= F.floor((F.col("_all") + k) / 2), F.col("_v"))) for k in (1, 2)]
    medians = ranked.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(((middle[0] + middle[1]) / 2).alias("median"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    g = g.join(medians, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    mass = F.when(F.col("sum") != 0, F.col("sum"))
    return g.select(
        *keys, "n", "sum", "mean", "variance", "standard_deviation", F.col("_lo.v").alias("minimum"), F.col("_hi.v").alias("maximum"), "median", F.col("_lo.y").alias("min_y"), F.col("_lo.x").alias("min_x"), (-F.col("_hi.y")).alias("max_y"), (-F.col("_hi.x")).alias("max_x"),
        (F.col("_vy") / mass).alias("com_y"), (F.col("_vx") / mass).alias("com_x"),
    )


def labeled_comprehension(px: DataFrame, agg: Column, keys: list[str] = KEYS, name: str = "out") -> DataFrame:
    """Any aggregate expression by label."""
    return px.groupBy(*keys).agg(agg.alias(name))


def moments(px: DataFrame, order: int = 3, keys: list[str] = KEYS, weight: Column | None = None) -> DataFrame:
    """Raw moments m_ij up to the order, about the image origin."""
    w = F.lit(1.0) if weight is None else weight
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    power = lambda b, e: F.lit(1.0) if e == 0 else b if e == 1 else power(b, e - 1) * b
    return px.groupBy(*keys).agg(*[F.sum(w * power(y, i) * power(x, j)).alias(f"m_{i}_{j}") for i in range(order + 1) for j in range(order + 1) if i + j <= order])


def region_table(px: DataFrame, keys: list[str] = KEYS, value: str = "v") -> DataFrame:
    """Area, box, centroid, intensities, inertia, axes, eccentricity, orientation; label 0 is background."""
    y, x, v = F.col("y").cast("double"), F.col("x").cast("double"), F.col(value)
    g = px.where("label != 0").groupBy(*keys).agg(
        F.count("*").alias("area"), F.min("y").alias("bbox_0"), F.min("x").alias("bbox_1"), (F.max("y") + 1).alias("bbox_2"), (F.max("x") + 1).alias("bbox_3"), F.avg(y).alias("centroid_0"), F.avg(x).alias("centroid_1"),
        F.min(v).alias("min_intensity"), F.max(v).alias("max_intensity"), F.avg(v).alias("mean_intensity"), F.sum(y * y).alias("_yy"), F.sum(x * x).alias("_xx"), F.sum(x * y).alias("_xy"),
    )
    n, cy, cx = F.col("area"), F.col("centroid_0"), F.col("centroid_1")
    g = g.withColumn("_a", F.col("_xx") / n - cx * cx).withColumn("_c", F.col("_yy") / n - cy * cy).withColumn("_b", cx * cy - F.col("_xy") / n)
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    root = F.sqrt((a - c) * (a - c) / 4 + b * b)
    g = g.withColumn("inertia_eigval_0", (a + c) / 2 + root).withColumn("inertia_eigval_1", F.greatest((a + c) / 2 - root, F.lit(0.0)))
    e0, e1 = F.col("inertia_eigval_0"), F.col("inertia_eigval_1")
    box = (F.col("bbox_2") - F.col("bbox_0")) * (F.col("bbox_3") - F.col("bbox_1"))
    # Inertia tensor rows (a, b), (b, c) with a about the row axis.
    turn = F.when(F.abs(a - c) < 1e-12, F.when(b < -1e-12, -3.141592653589793 / 4).otherwise(3.141592653589793 / 4)).when(F.abs(b) < 1e-12, F.when(c < a, -3.141592653589793 / 2).otherwise(0.0)).otherwise(0.5 * F.atan2(-2 * b, c - a))
    return g.select(
        *keys, "area", "bbox_0", "bbox_1", "bbox_2", "bbox_3", box.alias("bbox_area"), (n / box).alias("extent"), "centroid_0", "centroid_1", F.sqrt(4 * n / 3.141592653589793).alias("equivalent_diameter"),
        "min_intensity", "max_intensity", "mean_intensity", a.alias("inertia_0_0"), b.alias("inertia_0_1"), c.alias("inertia_1_1"), e0.alias("inertia_eigval_0"), e1.alias("inertia_eigval_1"),
        (4 * F.sqrt(e0)).alias("major_axis_length"), (4 * F.sqrt(e1)).alias("minor_axis_length"), F.when(e0 > 0, F.sqrt(F.greatest(1 - e1 / F.when(e0 > 0, e0), F.lit(0.0)))).otherwise(0.0).alias("eccentricity"), turn.alias("orientation"),
    )


def map_array(px: DataFrame, mapping: DataFrame, value: str = "v") -> DataFrame:
    """Replaces values by ``mapping`` (in_val, out_val); others become 0."""
    m = mapping.select(F.col("in_val").alias(value), "out_val")
    return px.join(m, value, "left").withColumn(value, F.coalesce("out_val", F.lit(0))).drop("out_val")


def relabel_sequential(px: DataFrame, key: str = "image_id", label: str = "label", offset: int = 1) -> DataFrame:
    """Labels by rank within each image from ``offset``; the ranks come from distinct labels only."""
    known = px.where(F.col(label) != 0).select(key, label).distinct()
    known = known.withColumn("new_label", F.row_number().over(Window.partitionBy(key).orderBy(label)) + offset - 1)
    return px.join(known, [key, label], "left").withColumn("new_label", F.coalesce("new_label", F.lit(0)))


def join_segmentations(px: DataFrame, a: str, b: str, key: str = "image_id") -> DataFrame:
    """The joint label of two segmentations, numbered from 1 in order of (a, b); where both are 0 it is 0."""
    pairs = px.select(key, a, b).distinct()
    both = (F.col(a) == 0) & (F.col(b) == 0)
    pairs = pairs.withColumn("joint", F.when(both, 0).otherwise(F.row_number().over(Window.partitionBy(key, both).orderBy(a, b))))
    return px.join(pairs, [key, a, b])


def clear_border(px: DataFrame, buffer: int = 0, label: str = "label", background: int = 0, size: DataFrame | None = None) -> DataFrame:
    """Labels that come within ``buffer`` pixels of the image's edge become background, wherever they reach.

    Images are as large as their pixels say, or as ``size`` (image_id, rows,
    cols) does.  Only the labels found at the edge are joined back.
    """
    size = px.groupBy("image_id").agg((F.max("y") + 1).alias("rows"), (F.max("x") + 1).alias("cols")) if size is None else size.select("image_id", "rows", "cols")
    near = (F.col("y") <= buffer) | (F.col("x") <= buffer) | (F.col("y") >= F.col("rows") - 1 - buffer) | (F.col("x") >= F.col("cols") - 1 - buffer)
    gone = px.where(F.col(label) != background).join(size, "image_id").where(near).select("image_id", label).distinct().withColumn("_gone", F.lit(True))
    return px.join(gone, ["image_id", label], "left").withColumn(label, F.when(F.col("_gone"), F.lit(background)).otherwise(F.col(label))).drop("_gone")


def remove_small_objects(px: DataFrame, min_size: int, key: str = "image_id", label: str = "label") -> DataFrame:
    small = px.where(F.col(label) != 0).groupBy(key, label).agg(F.count("*").alias("_n")).where(F.col("_n") < min_size).drop("_n")
    return px.join(small.withColumn("_small", F.lit(True)), [key, label], "left").withColumn(label, F.when(F.col("_small"), 0).otherwise(F.col(label))).drop("_small")


def block_reduce(px: DataFrame, block: tuple[int, int], agg=F.avg, value: str = "v", cval: float = 0.0) -> DataFrame:
    """One value per block of pixels; blocks that the image's edge cuts are filled up with ``cval``.

    Only the pixels that are missing are added, so the work stays with the image.
    """
    size = px.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    last = [F.ceil(F.col(n) / b) * b - 1 for n, b in zip("hw", block)]
    run = lambda a, b: F.explode(F.when(a <= b, F.sequence(a.cast("int"), b.cast("int"))).otherwise(F.array().cast("array<int>")))
    below = size.withColumn("y", run(F.col("h"), last[0])).withColumn("x", run(F.lit(0), last[1]))
    beside = size.withColumn("x", run(F.col("w"), last[1])).withColumn("y", run(F.lit(0), F.col("h") - 1))
    fill = below.select("image_id", "y", "x").unionByName(beside.select("image_id", "y", "x")).withColumn(value, F.lit(cval))
    own = px.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).cast("double").alias(value)).unionByName(fill)
    return own.groupBy("image_id", F.floor(F.col("y") / block[0]).cast("int").alias("y"), F.floor(F.col("x") / block[1]).cast("int").alias("x")).agg(agg(value).alias(value))


def integral_image(px: DataFrame, value: str = "v") -> DataFrame:
    """Sums over all pixels above and to the left, itself included."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    column = Window.partitionBy("image_id", "x").orderBy("y")
    return px.withColumn("_r", F.sum(value).over(row)).withColumn("integral", F.sum("_r").over(column)).drop("_r")


def rank_order(px: DataFrame, key: str = "image_id", value: str = "v") -> DataFrame:
    return px.withColumn("rank", F.dense_rank().over(Window.partitionBy(key).orderBy(value)) - 1)


def pair_metrics(a: DataFrame, b: DataFrame, data_range: float) -> DataFrame:
    """mse, nrmse (euclidean), psnr of images joined on (image_id, y, x)."""
    j = a.select("image_id", "y", "x", F.col("v").alias("p")).join(b.select("image_id", "y", "x", F.col("v").alias("q")), ["image_id", "y", "x"])
    d = F.col("p") - F.col("q")
    g = j.groupBy("image_id").agg(F.avg(d * d).alias("mse"), F.avg(F.col("p") * F.col("p")).alias("_pp"))
    return g.select("image_id", "mse", (F.sqrt("mse") / F.sqrt(F.when(F.col("_pp") > 0, F.col("_pp")))).alias("nrmse"), (10 * F.log10(data_range * data_range / F.when(F.col("mse") > 0, F.col("mse")))).alias("psnr"))


def _boxes(px: DataFrame, keys: list[str]) -> DataFrame:
    return px.where("label != 0").groupBy(*keys).agg(F.min("y").alias("_y0"), F.min("x").alias("_x0"), F.max("y").alias("_y1"), F.max("x").alias("_x1"))


def region_images(px: DataFrame, keys: list[str] = KEYS, value: str = "v") -> DataFrame:
    """One row per pixel of every region's box: y and x in the box, ``image`` (inside the region), ``intensity_image`` (0 outside).

    Work follows the boxes; no region is gathered in one row.
    """
    rows = F.explode(F.sequence("_y0", "_y1")).alias("_y")
    cells = _boxes(px, keys).select(*keys, "_y0", "_x0", "_x1", rows).select(*keys, "_y0", "_x0", "_y", F.explode(F.sequence("_x0", "_x1")).alias("_x"))
    own = px.where("label != 0").select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col(value).alias("_v"))
    hit = cells.join(own, [*keys, "_y", "_x"], "left")
    return hit.select(*keys, (F.col("_y") - F.col("_y0")).alias("y"), (F.col("_x") - F.col("_x0")).alias("x"), F.col("_v").isNotNull().alias("image"), F.coalesce("_v", F.lit(0.0)).alias("intensity_image"))


def region_coords(px: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Each region's pixels as a sorted array of (y, x); for regions that fit one row."""
    return px.where("label != 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("coords"))


def local_centroids(px: DataFrame, keys: list[str] = KEYS, value: str = "v") -> DataFrame:
    """Centroids within the region's box, plain and weighted by value (null where the values sum to 0)."""
    v = F.col(value)
    mass = F.when(F.sum(v) != 0, F.sum(v))
    part = lambda c: [F.avg(c) - F.min(c), F.sum(v * F.col(c)) / mass - F.min(c)]
    (a, p), (b, q) = part("y"), part("x")
    return px.where("label != 0").groupBy(*keys).agg(a.alias("local_centroid_0"), b.alias("local_centroid_1"), p.alias("weighted_local_centroid_0"), q.alias("weighted_local_centroid_1"))


def label_rollup(px: DataFrame, keys: list[str] = KEYS, value: str = "v") -> DataFrame:
    """Counts, sums and extrema per region, per image (null label) and over all (null image), in one pass."""
    v = F.col(value)
    return px.where("label != 0").rollup(*keys).agg(F.count("*").alias("n"), F.sum(v).alias("sum"), F.min(v).alias("minimum"), F.max(v).alias("maximum"))
