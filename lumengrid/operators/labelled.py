"""Measurements by label in all forms of an index, and users' own aggregates.

``measure`` answers for whole images, for the pooled foreground, for one label
or for a list of labels in its own order, duplicates and absent labels
included.  ``aggregate`` runs a user's function in three steps (partial, merge,
finish), so that a label of any size is summed up where its pixels lie.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import regions
from .runtime import ship

#: What a measurement of no pixels is: sums are 0, ratios undefined, the rest null.
ABSENT = {"sum": 0.0, "mean": float("nan"), "variance": float("nan"), "standard_deviation": float("nan")}
#: Entries of a large index that go along in one row.
PART = 1000
COLUMNS = {
    "sum": ["sum"], "mean": ["mean"], "variance": ["variance"], "standard_deviation": ["standard_deviation"], "minimum": ["minimum"], "maximum": ["maximum"], "median": ["median"],
    "minimum_position": ["min_y", "min_x"], "maximum_position": ["max_y", "max_x"], "extrema": ["minimum", "maximum", "min_y", "min_x", "max_y", "max_x"], "center_of_mass": ["com_y", "com_x"],
}


def measure(px: DataFrame, names: list[str], labels: str | None = None, index: int | list[int] | DataFrame | None = None, value: str = "v") -> DataFrame:
    """The measurements named (keys of ``COLUMNS``) per image and entry of the index: image_id, pos, label and their columns.

    Without ``labels`` all pixels count; with labels and no index the pixels
    of labels above 0 (for sums: other than 0).  Both give one row an image,
    pos 0 and a null label.  A scalar index gives one row, a list one for each
    entry at its place, a table (pos, label) is joined and may be large.  An
    entry without pixels has a row with ``ABSENT`` values.
    """
    wanted = list(dict.fromkeys(c for n in names for c in COLUMNS[n]))
    if labels is None or index is None:
        chosen = px if labels is None else px.where(F.col(labels) > 0)
        images = px.select("image_id").distinct()
        found = regions.label_stats(chosen, ["image_id"], value)
        if labels is not None and "sum" in wanted:
            found = found.drop("sum").join(px.where(F.col(labels) != 0).groupBy("image_id").agg(F.sum(value).alias("sum")), "image_id", "full")
        out = images.join(found, "image_id", "left").withColumn("pos", F.lit(0)).withColumn("label", F.lit(None).cast("long"))
    else:
        if isinstance(index, DataFrame):
            entries = index.select(F.col("pos").cast("int").alias("pos"), F.col("label").cast("long").alias("label"))
            known = entries.select("label").distinct()
            some = px.join(known, px[labels].cast("long") == known["label"], "left_semi")
        else:
            each = [index] if isinstance(index, int) else list(index)
            if not each:
                return measure(px, names, labels, 0, value).limit(0)
            some = px.where(F.col(labels).isin(each))
        stats = regions.label_stats(some.withColumn("_label", F.col(labels).cast("long")), ["image_id", "_label"], value).withColumnRenamed("_label", "label")
        images = px.select("image_id").distinct()
        if isinstance(index, DataFrame):
            # Entries times images is the size of the result; parts of the index go to every image, so that no row holds it all.
            parts = entries.groupBy(F.floor(F.col("pos") / PART).alias("_part")).agg(F.collect_list(F.struct("pos", "label")).alias("_all"))
            count = (entries.agg(F.max("pos")).first()[0] or 0) // PART + 1
            rows = images.select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("_part")).join(parts, "_part")
        else:
            rows = images.withColumn("_all", F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(l).cast("long").alias("label")) for k, l in enumerate(each)]))
        rows = rows.select("image_id", F.explode("_all").alias("_e")).select("image_id", "_e.pos", "_e.label")
        out = rows.join(stats, ["image_id", "label"], "left")
    defaults = {c: v for c, v in ABSENT.items() if c in wanted}
    shown = [F.coalesce(F.col(c).cast("double"), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in wanted]
    return out.select("image_id", "pos", "label", *shown)


def aggregate(px: DataFrame, partial: Callable, merge: Callable, finish: Callable, keys: list[str] = regions.KEYS, value: str = "v", out: str = "out double", default: float | None = None, index: DataFrame | None = None, positions: bool = False) -> DataFrame:
    """A user's aggregate by key: ``finish(merge(...merge(partial, partial)...))``.

    ``partial(values)`` (or ``partial(values, y, x)``) turns some pixels of a
    key into a state (an array of doubles), ``merge`` joins two states,
    ``finish`` gives the result.  A task makes one state per key of its own
    pixels; only states are shuffled.  ``index`` (a table of keys) names the
    rows wanted; those without pixels get ``default``.  Null values are left
    out.
    """
    ship(px.sparkSession)
    picked = px.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), *([F.col("y").cast("double").alias("_y"), F.col("x").cast("double").alias("_x")] if positions else []))
    schema = picked.select(*keys).schema
    name, kind = out.split()

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch]).append_column("_row", pa.array(np.arange(len(batch))))
            for row in table.group_by(keys, use_threads=False).aggregate([("_row", "list")]).to_pylist():
                at = pa.array(row["_row_list"], pa.int64())
                state = np.asarray(partial(*[batch.column(k).take(at).to_numpy() for k in range(len(keys), batch.num_columns)]), float)
                key = tuple(row[k] for k in keys)
                held[key] = state if key not in held else np.asarray(merge(held[key], state), float)
        if held:
            yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in held], batch.column(i).type) for i in range(len(keys))], pa.array([s.tolist() for s in held.values()], pa.list_(pa.float64()))], names=[*keys, "_state"])

    states = picked.mapInArrow(run, schema.add("_state", T.ArrayType(T.DoubleType())))

    def together(key, batches):
        state = None
        for batch in batches:
            for s in batch.column("_state").to_pylist():
                state = np.array(s) if state is None else np.asarray(merge(state, np.array(s)), float)
        yield pa.RecordBatch.from_arrays([*[pa.array([k.as_py()], k.type) for k in key], pa.array([float(finish(state))])], names=[*keys, name])

    def one(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(together(key, table.to_batches())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*keys).schema)
    found = states.groupBy(*keys).applyInArrow(one, f"{fields}, {name} double").withColumn(name, F.col(name).cast(kind))
    if index is None:
        return found
    return index.join(found, keys, "left").withColumn(name, F.coalesce(name, F.lit(default).cast(kind)))
