"""Connected components by alternating large-star and small-star rounds.

Edges stay distributed throughout; each round is two grouped minima and a
join, written to the shared folder.  Hot nodes are joined apart (``attach``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, stage


def _star(edges: DataFrame, small: bool, rows: int) -> DataFrame:
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # u is the larger end of an edge in a small star, and every end in a large one
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    out = attach(both, least, "u", "n", rows)
    if small:
        linked = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(out.select("u", F.col("m").alias("v")))
    else:
        linked = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node each node of an edge is linked with.

    Loops, repeated and reversed edges are harmless; edges with a null end are
    dropped; no edges give no rows.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        edges = stage(_star(_star(edges, False, 2 * state[0]), True, state[0]), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
