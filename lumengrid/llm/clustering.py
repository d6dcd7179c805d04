"""Exact centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors become integers, are range-sorted by their place on a Hilbert curve
and packed into blocks of neighbours, each with the least and greatest value
of every dimension.  A round bounds the distance from a block's box to every
centroid from both sides: a centroid whose least possible distance exceeds
another's greatest one is nearest to no vector of the block.  The candidates
left are compared with every vector in exact integer arithmetic, so the bounds
save work and never change a result.

Blocks are written once to the shared folder; a round reads them, sums by
cluster within each task, and brings k x dims sums to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import ship, stage
from .vectors import as_binary, floored, from_binary, sound_lists

#: Components are held between -LIMIT and LIMIT, so that 64-bit distances can't overflow.
LIMIT = 1 << 24
#: Bits of a dimension that place a vector on the curve.
BITS = 4
#: Vectors of a block, and rows of a sorted partition.
BLOCK, PART_ROWS = 128, 250_000
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of cells (rows of small unsigned numbers) on the Hilbert curve, as rows of bytes, most significant first."""
    x = cells.T.astype(np.uint32)
    d = len(x)
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for i in range(d):
            set_ = (x[i] >> np.uint32(level)) & np.uint32(1) == 1
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint32(level)) & np.uint32(1) == 1, (1 << level) - 1, 0).astype(np.uint32)
    x ^= turn
    planes = [(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).astype(np.uint8), axis=0).T


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids that may be nearest to some vector of the box, ascending."""
    gap = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    reach = np.maximum(np.abs(centroids - low), np.abs(high - centroids))
    least, most = (gap * gap).sum(1), (reach * reach).sum(1)
    return np.flatnonzero(least <= most.min())


def nearest(x: np.ndarray, centroids: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, squared distance) of each vector's nearest centroid; the first of equals."""
    bound = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * bound * bound < 1 << 53:  # every sum below is a whole double
        a, c = x.astype(float), centroids.astype(float)
        far = ((a * a).sum(1)[:, None] + (c * c).sum(1) - 2 * (a @ c.T)).astype(np.int64)
    else:
        far = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = far.argmin(1)
    return names[best], far[np.arange(len(x)), best]


def _kept(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    rows, size, flat = sound_lists(column)
    whole = size == dims
    return rows[whole], floored(flat[np.repeat(whole, size)].reshape(-1, dims), scale, LIMIT)


def _survey(vectors: DataFrame, dims: int, scale: int, k: int, seed: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(first centroids, least and greatest value by dimension, number of vectors)."""
    @K.tidy
    def run(batches):
        low, high, n = np.full(dims, LIMIT), np.full(dims, -LIMIT), 0
        best: list[tuple[str, list[int]]] = []
        for batch in batches:
            rows, x = _kept(batch.column(1), dims, scale)
            if not len(rows):
                continue
            ids = batch.column(0).take(pa.array(rows)).to_pylist()
            low, high, n = np.minimum(low, x.min(0)), np.maximum(high, x.max(0)), n + len(x)
            names = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in ids]
            best = sorted(best + [(names[j], x[j].tolist()) for j in np.argsort(names)[: k + len(names) - len(set(names))]])[:k]
        if n:
            yield pa.RecordBatch.from_pylist([{"name": h, "v": v, "n": 0} for h, v in best] + [{"name": None, "v": low.tolist(), "n": n}, {"name": None, "v": high.tolist(), "n": 0}], pa.schema([("name", pa.string()), ("v", pa.list_(pa.int64())), ("n", pa.int64())]))

    found = stage(vectors.mapInArrow(run, "name string, v array<long>, n long"), "cluster_survey")
    first = found.where("name is not null").orderBy("name", "v").limit(k).collect()
    ends = found.where("name is null").select("n", F.posexplode("v").alias("at", "x"))
    low, high = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
    for row in ends.groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect():
        low[row["at"]], high[row["at"]] = row["low"], row["high"]
    n = found.agg(F.sum("n")).first()[0] or 0
    return np.array([row["v"] for row in first], np.int64).reshape(-1, dims), low, high, n


def hilbert_blocks(vectors: DataFrame, dims: int, scale: int, low: np.ndarray, high: np.ndarray, rows: int) -> DataFrame:
    """Blocks of neighbours on the curve, written to the shared folder: n, ids, vectors, least and greatest values.

    Equal vectors share a key; a number dealt to each row breaks the tie, so
    any number of them spreads over partitions.
    """
    spark = vectors.sparkSession

    @K.tidy
    def place(batches):
        seen = TaskContext.get().partitionId() << 32
        for batch in batches:
            at, x = _kept(batch.column(1), dims, scale)
            cells = (x - low) * (1 << BITS) // (high - low + 1)
            salt = (np.arange(seen, seen + len(at), dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)
            seen += len(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), as_binary(hilbert_keys(cells), "u1"), pa.array(salt), as_binary(x, "<i4")], names=["vec_id", "key", "salt", "v"])

    @K.tidy
    def pack(batches):
        ids, xs, held = [], [], 0

        def blocks(own, x):
            for a in range(0, len(x), BLOCK):
                part = x[a : a + BLOCK]
                yield {"n": len(part), "ids": own[a : a + BLOCK], "v": part.astype("<i4").tobytes(), "low": part.min(0).astype("<i4").tobytes(), "high": part.max(0).astype("<i4").tobytes()}

        form = pa.schema([("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("v", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
        for batch in batches:
            ids += batch.column(0).to_pylist()
            xs.append(from_binary(batch.column(1), "<i4", dims))
            held += len(batch)
            if held >= BLOCK:
                x, whole = np.concatenate(xs), held - held % BLOCK
                yield pa.RecordBatch.from_pylist(list(blocks(ids[:whole], x[:whole])), form)
                ids, xs, held = ids[whole:], [x[whole:]], held - whole
        if held:
            yield pa.RecordBatch.from_pylist(list(blocks(ids, np.concatenate(xs))), form)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))
    placed = vectors.mapInArrow(place, "vec_id long, key binary, salt long, v binary")
    ordered = placed.repartitionByRange(parts, "key", "salt").sortWithinPartitions("key", "salt").select("vec_id", "v")
    return stage(ordered.mapInArrow(pack, "n int, ids array<long>, v binary, low binary, high binary"), "cluster_blocks")


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray):
    """(block row, vectors, cluster, distance) of every block of a batch."""
    dims = centroids.shape[1]
    v = batch.column(batch.schema.get_field_index("v"))
    low, high = (from_binary(batch.column(batch.schema.get_field_index(c)), "<i4", dims).astype(np.int64) for c in ("low", "high"))
    for k in range(len(batch)):
        x = np.frombuffer(v[k].as_py(), "<i4").reshape(-1, dims).astype(np.int64)
        near = candidates(low[k], high[k], centroids)
        yield k, x, *nearest(x, centroids[near], near)


def _by_cluster(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """cluster: (vectors, summed distance, summed components), exact."""
    k, dims = centroids.shape

    @K.tidy
    def run(batches):
        n, sums, far = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), [0] * k
        for batch in batches:
            for _, x, cluster, distance in _assigned(batch, centroids):
                for c in np.unique(cluster):
                    own = cluster == c
                    n[c] += own.sum()
                    sums[c] += x[own].sum(0)
                    far[c] += sum(distance[own].tolist())
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pylist([{"cluster": int(c), "sums": [str(int(n[c])), str(far[c]), *map(str, sums[c].tolist())]} for c in used], pa.schema([("cluster", pa.int32()), ("sums", pa.list_(pa.string()))]))

    parts = blocks.select("v", "low", "high").mapInArrow(run, "cluster int, sums array<string>").select("cluster", F.posexplode("sums").alias("at", "x"))
    out = {c: [0] * (dims + 2) for c in range(k)}
    for row in parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        out[row["cluster"]][row["at"]] = int(row["x"])
    return {c: (x[0], x[1], x[2:]) for c, x in out.items()}


def _long(x: int) -> int | None:
    return x if x < 1 << 63 else None


def cluster(embeddings: DataFrame, dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1") -> DataFrame:
    """Every kept vector with its cluster after ``rounds`` of exact k-means.

    Kept are vectors of exactly ``dims`` components, none null or non-finite;
    floor(scale * x) is held between -2**24 and 2**24.  The first centroids are
    the k vectors with the least sha256 of ``seed:vec_id`` (a null id counts as
    empty text; rows of one id by their components).  Fewer vectors than k give
    fewer centroids; repeated rows all count and all return; no vector gives no
    row.  A centroid without vectors stays.  Inertias beyond 64 bits are null.
    Other columns are ignored.
    """
    spark = embeddings.sparkSession
    ship(spark)
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    centroids, low, high, n = _survey(vectors, dims, scale, k, seed)
    if not n:
        return spark.createDataFrame([], OUT)
    blocks = hilbert_blocks(vectors, dims, scale, low, high, n)
    for _ in range(rounds):
        found = _by_cluster(blocks, centroids)
        centroids = np.array([[s // count for s in sums] if count else centroids[c].tolist() for c, (count, _, sums) in found.items()], np.int64)
    found = _by_cluster(blocks, centroids)
    own = [_long(found[c][1]) for c in range(len(centroids))]
    whole = _long(sum(x[1] for x in found.values()))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    @K.tidy
    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for j, _, c, distance in _assigned(batch, centroids):
                at = pa.array(c)
                yield pa.RecordBatch.from_arrays([ids[j].values, at.cast(pa.int32()), pa.array(distance), pa.array(own, pa.int64()).take(at), pa.array([whole] * len(c), pa.int64()), pa.array(names).take(at)], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(run, OUT)
