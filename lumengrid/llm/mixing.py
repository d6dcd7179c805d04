"""Mixing sources to target weights: a time-varying curriculum, in column expressions.

Each source has a weight schedule over training time 0 to 1, piecewise linear
between knots.  Its integral is the source's weight; weights share out the
token budget, and no source may give more than ``repeats`` times its size
(the excess goes to the others by weight: water-filling, solved in closed form
over the sorted ratios cap / weight).  A source's documents stand in a seeded
order; the words before a document are its cumulative demand, and the inverse
of the source's cumulative schedule turns demand into a training position.

Prefix sums never need a source in one task: documents fall into buckets by
the first digits of their order key, buckets are summed first, and a window
runs only inside (source, bucket).  The number of digits follows the row count.
Rows of one source, doc_id and size are interchangeable: they are counted
before they move and one row stands for them, so ids that repeat, or are null,
fill no bucket.  The table of sources itself is sorted in one task: it has one
row per source, thousands at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, word_count

#: Rows a (source, bucket) window holds on average, at most.
BUCKET_ROWS = 65_536
#: Equal rows beyond this number are unfolded by several tasks.
UNFOLD_ROWS = 100_000
#: Weights by rank of the source, and the shape of each weight's schedule as
#: (time, multiple of the weight); every shape integrates to 1.
CYCLE = (3.0, 1.0, 2.0)
SHAPES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def _source_key(source: Column) -> Column:
    """Orders by code point with null last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def cyclic_schedules(sources: DataFrame, cycle=CYCLE, shapes=SHAPES) -> DataFrame:
    """Sources by code point, null last, take the weights of ``cycle`` in turn.

    Adds ``knots``: array of (t, w).  One row per source.
    """
    rank = (F.row_number().over(Window.orderBy("sk")) - 1) % len(cycle)
    knots = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w * m).alias("w")) for t, m in shape]) for w, shape in zip(cycle, shapes)])
    return sources.withColumn("knots", F.get(knots, rank.cast("int")))


def _segments(knots: Column) -> Column:
    """Knots as segments (t, w, slope, length, cum): cum is the integral before the segment."""
    seg = F.transform(
        F.sequence(F.lit(0), F.size(knots) - 2),
        lambda i: F.struct(knots[i]["t"].alias("t"), knots[i]["w"].alias("w"), ((knots[i + 1]["w"] - knots[i]["w"]) / (knots[i + 1]["t"] - knots[i]["t"])).alias("slope"), (knots[i + 1]["t"] - knots[i]["t"]).alias("d")),
    )
    area = lambda s: s["d"] * (s["w"] + s["slope"] * s["d"] / 2)
    return F.transform(seg, lambda s, i: F.struct(s["t"].alias("t"), s["w"].alias("w"), s["slope"].alias("slope"), F.aggregate(F.slice(seg, F.lit(1), i), F.lit(0.0), lambda a, x: a + area(x)).alias("cum"), area(s).alias("area")))


def water_fill(sources: DataFrame, share: float, repeats: int) -> DataFrame:
    """Adds ``target``: min(repeats * size, level * weight), summing to share * all sizes.

    Needs ``source_size`` and ``weight`` > 0; one row per source.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    out = sources.withColumn("cap", (F.lit(repeats) * F.col("source_size")).cast("double"))
    out = out.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything).cast("double"))
    out = out.withColumn("_level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    free = F.when(F.col("cap") > F.col("_level") * F.col("weight"), F.struct(F.row_number().over(order).alias("k"), F.col("_level").alias("level")))
    out = out.withColumn("_level", F.min(free).over(everything)["level"])
    level = F.coalesce(F.col("_level") * F.col("weight"), F.col("cap"))
    return out.withColumn("target", F.least("cap", level)).drop("cap", "budget", "_level")


def invert_schedule(segments: Column, total: Column, part: Column) -> Column:
    """Training time at which ``part`` (0 to 1) of a source's demand is met."""
    x = part * total
    seg = F.coalesce(F.try_element_at(F.filter(segments, lambda s: s["cum"] <= x), F.lit(-1)), F.get(segments, F.lit(0)))
    rest = F.greatest(x - seg["cum"], F.lit(0.0))
    root = F.sqrt(F.greatest(seg["w"] * seg["w"] + 2 * seg["slope"] * rest, F.lit(0.0)))
    t = seg["t"] + F.when(seg["w"] + root > 0, 2 * rest / (seg["w"] + root)).otherwise(0.0)
    return F.when(part.isNotNull(), F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)))


def unfold(rows: DataFrame, count: str, name: str, run: int = UNFOLD_ROWS) -> DataFrame:
    """``count`` rows for each row, numbered from 0 in ``name``.

    Counts above ``run`` are cut into runs first, which are dealt over tasks, so
    no array and no task follows a count.
    """
    n = F.col(count)
    few = rows.where(n <= run).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    many = rows.where(n > run).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / run))))
    many = many.repartition("_run").withColumn(name, F.explode(F.sequence(F.col("_run") * run, F.least((F.col("_run") + 1) * run, n) - 1)))
    return few.unionByName(many.drop("_run"))


def mix(docs: DataFrame, share: float = 1.5, repeats: int = 2, seed: str = "mix", schedules=cyclic_schedules, run: int = UNFOLD_ROWS) -> DataFrame:
    """One row per document: what the mix takes of it, and when.

    Columns: doc_id, source, size (words), source_size, target, taken (words,
    repeats counted), passes (whole copies, rounded), position (training time
    of its first word; null if nothing is taken), positions (the same for each
    pass that takes words).  ``schedules`` adds ``knots``
    to the table of sources.  The document at a source's limit gives only the
    words still due, so each source's taken words are its target, rounded down.

    Null text has no words; a null source is a source; null and repeated
    doc_ids are ordinary rows (equal rows are interchangeable).  Empty tables
    give no rows; other columns of ``docs`` are ignored.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    sized = stage(docs.select("doc_id", "source", _source_key(F.col("source")).alias("sk"), word_count(F.col("text")).alias("size"), key.alias("key")), "mix_sizes")
    per_source = sized.groupBy("sk").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    plan = schedules(per_source).withColumn("segments", _segments(F.col("knots")))
    plan = plan.withColumn("weight", F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["area"]))
    plan = stage(water_fill(plan, share, repeats).select("sk", "source_size", "target", "weight", "segments", "_rows"), "mix_plan")
    rows = plan.agg(F.sum("_rows")).first()[0] or 0
    digits = max(2, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS + 1, 16)))
    sized = sized.groupBy("sk", "source", "doc_id", "key", "size").agg(F.count("*").alias("_same"))
    sized = sized.withColumn("bucket", F.substring("key", 1, digits)).withColumn("_all", F.col("_same") * F.col("size"))
    base = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sized.groupBy("sk", "bucket").agg(F.sum("_all").alias("_size"))
    buckets = buckets.join(plan.drop("_rows"), "sk").withColumn("base", F.coalesce(F.sum("_size").over(base), F.lit(0)))
    inner = Window.partitionBy("sk", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = sized.withColumn("_in", F.coalesce(F.sum("_all").over(inner), F.lit(0))).join(buckets.drop("_size"), ["sk", "bucket"])
    out = unfold(out, "_same", "_nth", run)
    due = F.floor("target").cast("long")
    at = F.col("base") + F.col("_in") + F.col("_nth") * F.col("size")
    taken = lambda p: F.least(F.greatest(due - F.col("source_size") * p - at, F.lit(0)), F.col("size"))
    place = lambda p: F.when(taken(p) > 0, F.round(invert_schedule(F.col("segments"), F.col("weight"), (at + F.col("source_size") * p) / F.col("target")), 9))
    out = out.withColumn("taken", sum((taken(F.lit(p)) for p in range(1, repeats)), taken(F.lit(0))).cast("long"))
    out = out.withColumn("positions", F.array_compact(F.array(*[place(F.lit(p)) for p in range(repeats)])))
    passes = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", passes.alias("passes"), F.get("positions", F.lit(0)).alias("position"), "positions")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorts the documents by training position; untaken ones come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def passes_in_order(mixed: DataFrame) -> DataFrame:
    """One row per document and pass (0, 1, ...), range-sorted by the pass's training position."""
    out = mixed.select("doc_id", "source", "size", F.posexplode("positions").alias("pass", "position"))
    return out.orderBy("position", "doc_id", "pass")
