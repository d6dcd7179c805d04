"""Exact deduplication against immutable snapshots, screened by binary fuse filters.

A snapshot is a table of distinct texts (digest, smallest doc_id, count) that
never changes, split into shards by digest; each shard has a static binary
fuse filter (three probes, 16-bit fingerprints).  A new batch is first grouped
by digest, so copies inside it meet before any probe.  Its distinct digests
then probe the filter of their shard.  Positives join the snapshot's exact
buckets, where the texts themselves are compared byte for byte; what is found
there joins the group of the snapshot.  Negatives never touch the snapshot:
they become the batch's own groups, and the next snapshot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, attach, ship, stage

#: Digests of one filter shard, on average; its memory follows this figure.
SHARD_KEYS = 400_000
#: Pairs (two ids and a digest each) that may be broadcast for the byte check.
BROADCAST_PAIRS = 200_000
_U = np.uint64


def normalised(text: Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + _U((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in three neighbouring segments, and the 16-bit fingerprint."""
    h = _mix(keys, seed)
    first = ((h >> _U(32)) * _U(segments)) >> _U(32)
    g = _mix(h, 7)
    m = _U(segment - 1)
    parts = [(first + _U(i)) * _U(segment) + ((g >> _U(20 * i)) & m) for i in range(3)]
    return np.stack(parts).astype(np.int64), (h ^ (h >> _U(32))).astype(np.uint16)


def build_fuse(keys: np.ndarray) -> dict:
    """A binary fuse filter over distinct uint64 keys, peeled in whole rounds."""
    keys = np.unique(keys.astype(_U))
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.log2(n + 1) / np.log2(3.33) + 2.25))) if n > 1 else 4
    ratio = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    for seed in range(1, 200):
        segments = max(1, int(np.ceil(n * ratio * (1 + 0.02 * (seed // 8)) / segment)) - 2)
        size = (segments + 2) * segment
        at, mark = _slots(keys, seed, segment, segments)
        degree = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        ids = np.arange(n)
        for row in at:
            np.bitwise_xor.at(owner, row, ids)
        left, order = np.ones(n, bool), []
        while True:
            lone = np.flatnonzero(degree == 1)
            if not len(lone):
                break
            who, pick = np.unique(owner[lone], return_index=True)
            order.append((who, lone[pick]))
            left[who] = False
            for row in at:
                np.subtract.at(degree, row[who], 1)
                np.bitwise_xor.at(owner, row[who], who)
        if left.any():
            continue
        table = np.zeros(size, np.uint16)
        for who, slot in reversed(order):
            table[slot] = 0
            a, b, c = at[:, who]
            table[slot] = mark[who] ^ table[a] ^ table[b] ^ table[c]
        return {"seed": seed, "segment": segment, "segments": segments, "table": table}
    raise ValueError("no seed peels these keys")


def probe_fuse(fuse: dict, keys: np.ndarray) -> np.ndarray:
    (a, b, c), mark = _slots(keys.astype(_U), fuse["seed"], fuse["segment"], fuse["segments"])
    t = fuse["table"]
    return (t[a] ^ t[b] ^ t[c]) == mark


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""
    return docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("digest"))


def _key64(digest: Column) -> Column:
    return F.xxhash64(digest)


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: smallest doc_id, how many rows."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def _filters(snapshot: DataFrame) -> DataFrame:
    def build(key, table):
        fuse = build_fuse(table["key"].to_numpy().view(_U))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "seed": pa.array([fuse["seed"]], pa.int32()), "segment": pa.array([fuse["segment"]], pa.int32()), "segments": pa.array([fuse["segments"]], pa.int32()), "cells": pa.array([fuse["table"].tobytes()], pa.binary())})

    return snapshot.select("shard", "key").groupBy("shard").applyInArrow(build, "shard int, seed int, segment int, segments int, cells binary")


def _screen(key, left, right):
    if not len(left) or not len(right):
        return left.slice(0, 0)
    f = right.to_pylist()[0]
    fuse = {"seed": f["seed"], "segment": f["segment"], "segments": f["segments"], "table": np.frombuffer(f["cells"], np.uint16)}
    return left.filter(pa.array(probe_fuse(fuse, left["key"].to_numpy().view(_U))))


class Snapshot:
    """Distinct texts of an immutable batch with their filter shards, in scratch tables.

    ``table`` has one row per digest: digest, first_id, n; ``docs`` holds the texts.
    """

    def __init__(self, docs: DataFrame, table: DataFrame):
        self.docs = docs
        self.shards = max(1, -(-table.count() // SHARD_KEYS))
        self.table = stage(self.sharded(table), "dedup_snapshot")
        self.filters = stage(_filters(self.table), "dedup_filters")

    def sharded(self, table: DataFrame) -> DataFrame:
        key = _key64(F.col("digest"))
        return table.withColumn("key", key).withColumn("shard", F.pmod(F.shiftrightunsigned(key, 40), F.lit(self.shards)).cast("int"))

    def screen(self, batch: DataFrame, size: int) -> DataFrame:
        """The digests of a grouped batch of ``size`` rows that the filters can't rule out.

        A shard's part of a large batch is dealt over several tasks, each with the filter.
        """
        ship(batch.sparkSession)
        parts = max(1, -(-size // (self.shards * SHARD_KEYS)))
        batch = self.sharded(batch).withColumn("part", F.pmod(F.col("key"), F.lit(parts)).cast("int"))
        filters = self.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return batch.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInArrow(_screen, batch.schema)


def exact_dedup(batches: list[DataFrame]) -> DataFrame:
    """Deduplicates batches in turn, each against the snapshots before it.

    Returns one row per row of any batch: doc_id, keep_id (smallest doc_id of
    the equal texts), group_size, kept, text_sha256.  Equal means identical
    after ``normalised``; null is empty.  Rows that repeat a doc_id and its text are
    all kept rows of one group; a null doc_id is kept only in a group with no
    other id.  Empty batches give no rows; other columns are ignored.
    """
    snapshots: list[Snapshot] = []
    rows, own, found = [], [], []  # by batch: digests of rows, groups begun here, matches by snapshot
    for k, docs in enumerate(batches):
        rows.append(stage(digests(docs), "dedup_digests"))
        fresh = stage(grouped(rows[-1]), "dedup_fresh") if snapshots else grouped(rows[-1])
        size = fresh.count() if snapshots else 0
        found.append([matches(s, docs, stage(s.screen(fresh, size), "dedup_screened")) for s in snapshots])
        for some in found[-1]:
            fresh = fresh.join(some.select("digest"), "digest", "left_anti")
        if k + 1 < len(batches):
            snapshots.append(Snapshot(docs, fresh))
            fresh = snapshots[-1].table.select("digest", "first_id", "n")
        own.append(fresh)
    # A snapshot's groups take in what later batches were matched to them.
    groups = []
    for k, table in enumerate(own):
        for later in found[k + 1 :]:
            table = table.unionByName(later[k])
        groups.append(stage(table.groupBy("digest").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("group_size")), "dedup_groups"))
    out = None
    for k, every in enumerate(rows):
        table = groups[k]
        for j, some in enumerate(found[k]):
            table = table.unionByName(groups[j].join(some.select("digest"), "digest", "left_semi"))
        some = attach(every, table, "digest", "group_size", every.count())
        out = some if out is None else out.unionByName(some)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def matches(snapshot: Snapshot, docs: DataFrame, screened: DataFrame) -> DataFrame:
    """(digest, first_id, n) of the positives that a snapshot's exact buckets hold.

    The batch's text and the snapshot's are compared byte for byte.  Equal
    digests of unequal texts would raise: such a pair has never been found for
    SHA-256, and merging the two would lose a text.
    """
    pairs = screened.select("digest", F.col("first_id").alias("new_id"), "n").join(snapshot.table.select("digest", F.col("first_id").alias("old_id")), "digest")
    pairs = stage(pairs, "dedup_pairs")
    few = pairs.count() <= BROADCAST_PAIRS
    new, old = _texts(pairs, docs, "new_id", few), _texts(pairs, snapshot.docs, "old_id", few)
    both = new.join(old, "digest")
    same = F.when(F.col("new_id_text") == F.col("old_id_text"), True).otherwise(F.raise_error(F.lit("one digest, two texts")).cast("boolean"))
    return stage(pairs.join(both.where(same).select("digest"), "digest").select("digest", F.col("new_id").alias("first_id"), "n"), "dedup_matches")


def _texts(pairs: DataFrame, docs: DataFrame, name: str, few: bool) -> DataFrame:
    """(digest, normalised text) of the rows with the pairs' ids, null ids too, one a digest.

    Few pairs are broadcast, so that only texts in pairs are ever shuffled.
    """
    text = normalised(F.col("text"))
    side = docs.select(F.col("doc_id").alias("_id"), text.alias("_text"), F.sha2(text, 256).alias("_digest"))
    wanted = pairs.select("digest", name)
    if not few:  # repeated rows meet in their own tasks before they move
        side = side.groupBy("_id", "_digest").agg(F.first("_text").alias("_text"))
    found = side.join(F.broadcast(wanted) if few else wanted, (F.col("_digest") == F.col("digest")) & F.col("_id").eqNullSafe(F.col(name)))
    return found.groupBy("digest").agg(F.first("_text").alias(f"{name}_text"))


def halves(docs: DataFrame) -> list[DataFrame]:
    """An older snapshot and a newer batch: doc_ids up to the median, and the rest."""
    middle = docs.select(F.percentile_approx("doc_id", F.lit(0.5))).first()[0]
    if middle is None:
        return [docs.where("doc_id is not null"), docs]
    return [docs.where(F.col("doc_id") <= middle), docs.where((F.col("doc_id") > middle) | F.col("doc_id").isNull())]
