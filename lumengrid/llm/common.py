"""Scratch tables in the shared folder, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the text contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
#: A key is hot when it holds more than this share of all rows, so at most
#: HOT_SHARE keys are hot whatever the input: the proven bound of a broadcast.
HOT_SHARE = 1000
#: Below this no key is worth treating apart.
SMALL_ROWS = 10_000
#: Rows of a key that one task may receive in a spread join.
PART_ROWS = 10_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a temporary folder; a
    cluster, whose machines share none, has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="lumengrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/lumengrid/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this folder; results that read them must be written first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/lumengrid")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, rows: int | None = None) -> DataFrame:
    """Left join to a table with one row per key, hot keys apart.

    ``right[weight]`` counts the left rows of a key, ``rows`` all left rows (or
    those of right's keys, if not given).  Keys above 1/HOT_SHARE of them
    (fewer than HOT_SHARE) are broadcast.  Their rows, and rows with a null
    key, which stay unmatched, are dealt by a hash of the whole row, so no task
    receives the rows of a hot key.  The left side is computed once.
    """
    if rows is None:
        rows = right.agg(F.sum(weight)).first()[0] or 0
    if rows < SMALL_ROWS:
        return left.join(right, key, "left")
    limit = max(1, rows // HOT_SHARE)
    names = [c for c in right.columns if c != key]
    hot = right.where(F.col(weight) > limit)
    cold = right.where(F.col(weight) <= limit)
    pack = lambda df: df.select(key, F.struct(*[quoted(c) for c in names]).alias("_found"))
    one = left.join(F.broadcast(pack(hot)), key, "left")
    apart = F.col("_found").isNotNull() | quoted(key).isNull()
    spread = F.xxhash64(*[quoted(c) for c in left.columns if not isinstance(left.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType))], F.lit("spread"))
    kind = right.schema[key].dataType
    one = one.withColumn("_key", F.when(apart, spread.cast(kind)).otherwise(quoted(key))).withColumn("_apart", apart)
    out = one.join(pack(cold).select(F.col(key).alias("_key"), F.lit(False).alias("_apart"), F.col("_found").alias("_cold")), ["_key", "_apart"], "left")
    found = F.coalesce("_found", "_cold")
    return out.select(*[quoted(c) for c in left.columns], *[found[c].alias(c) for c in names])


def spread_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], counted: DataFrame | None = None, per_part: int = PART_ROWS, how: str = "inner") -> DataFrame:
    """Inner or left join in which no task receives more than a part of a key's left rows.

    A key with more than ``per_part`` left rows (and more than 1/HOT_SHARE of
    all rows of such keys, so fewer than HOT_SHARE keys) is dealt over parts by
    a hash of the columns ``spread``, and its right rows are copied to every
    part.  ``counted`` holds the left rows' keys where it is cheaper to read.
    """
    sizes = (left if counted is None else counted).groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > per_part)
    sizes = stage(sizes, "join_sizes")
    total = sizes.agg(F.sum("_n")).first()[0]
    if total is None:
        return left.join(right, on, how)
    limit = max(per_part, total // HOT_SHARE)
    hot = F.broadcast(sizes.where(F.col("_n") > limit).select(*on, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    x = left.join(hot, on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    y = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return x.join(y, [*on, "_part"], how).drop("_part")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did.

    Whole texts are long rows: where the session has Spark's own batch size,
    batches are made smaller, so that a worker's buffers stay small.
    """
    import pathlib

    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "1000")

    root = str(pathlib.Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def forget(shared) -> None:
    """Drops a worker's copy of a broadcast value; the next use reads it from disk again."""
    shared.__dict__.pop("_value", None)


def map_text(docs: DataFrame, keep: list[str], results: str, make, most: int | None = None) -> DataFrame:
    """Adds columns computed from slices of whole texts, without a shuffle.

    ``make()`` runs once per task and returns f(data, offsets, nulls) giving a
    list of result columns (numpy or Arrow arrays), one value per row.  Slices
    hold about ``most`` bytes of text, so memory doesn't follow the batch.
    """
    import pyarrow as pa

    from . import textkernel as K

    ship(docs.sparkSession)
    size = most or K.SLICE
    picked = docs.select(*[quoted(c).alias(f"_{k}") for k, c in enumerate(keep)], F.col("text").alias("_text"))
    extra = docs.sparkSession.createDataFrame([], results).schema
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(keep, picked.schema.fields)] + extra.fields)

    @K.tidy
    def run(batches):
        work = make()
        n = len(keep)
        for batch in batches:
            kept, text = batch.columns[:n], batch.column(n)
            nulls = text.is_null().to_numpy(zero_copy_only=False)
            data, offs = K.string_buffer(text)
            for i, j in K.slices(offs, size):
                found = work(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], nulls[i:j])
                columns = [x if isinstance(x, pa.Array) else pa.array(x) for x in found]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in kept], *columns], names=[*keep, *extra.names])

    return picked.mapInArrow(run, schema)
