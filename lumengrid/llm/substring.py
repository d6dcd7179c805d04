"""Substring deduplication: words of windows that begin in an earlier document go.

Every WINDOW-word window has its least GRAM-gram (by hash) as anchor, so equal
windows have equal anchors.  Counting anchors (about a quarter as many as
windows) finds those that more than one document holds; only windows on such
anchors are hashed in full and meet in a grouped minimum of doc_id.  Windows
whose minimum is a smaller doc_id are removed, all judged on the input.

A document whose whole word sequence equals that of a smaller doc_id loses
every word of a window without any of this, so copies cost one row each.
Windows and whole sequences are equal when two independent 64-bit hashes are.

The repeated anchors (and the copies) lie in files of the shared folder.  While
they number at most BROADCAST_KEYS each worker reads them as one sorted array,
past the driver; beyond that bound the anchors are joined by shuffle and copies
are treated as other documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import PART_ROWS, attach, ship, spread_join, stage

WINDOW, GRAM = 13, 7
BROADCAST_KEYS = 8_000_000
_U = np.uint64


def _row_key(doc_id: np.ndarray, seq: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.mix(K.mix(doc_id.astype(np.int64).view(_U)) + seq)


def _isin(x: np.ndarray, table: np.ndarray | None) -> np.ndarray:
    if table is None or not len(table):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x


def anchors(words: K.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, window hashes, anchor hashes)."""
    full = K.ngram_hashes(words, window)
    at = np.flatnonzero(full)
    g = K.ngram_hashes(words, gram)
    least = g[at].copy()
    for j in range(1, window - gram + 1):
        np.minimum(least, g[at + j], out=least)
    return at, full[at], least


class KeyFile:
    """Hashes in a table of the shared folder, read by the workers themselves.

    ``load`` gives a sorted array, kept for the worker's next task; None stands
    for more than ``most`` hashes.
    """

    _kept: dict[str, np.ndarray] = {}  # two tables at most are in use at a time

    def __init__(self, table: DataFrame, column: str, most: int):
        self.fits = table.count() <= most
        self.path, self.column = table.inputFiles()[:1], column
        self.folder = self.path[0].rsplit("/", 1)[0] if self.path else None

    def load(self) -> np.ndarray | None:
        if not self.fits:
            return None
        if self.folder is None:
            return np.zeros(0, _U)
        if self.folder not in KeyFile._kept:
            files, path = pa.fs.FileSystem.from_uri(self.folder)
            if len(KeyFile._kept) > 1:
                KeyFile._kept.clear()
            found = pyarrow.dataset.dataset(path, filesystem=files, format="parquet").to_table([self.column])
            KeyFile._kept[self.folder] = np.sort(found[self.column].to_numpy().view(_U))
        return KeyFile._kept[self.folder]


def _second(words: K.Words) -> np.ndarray:
    """A second hash of whole sequences, from windows of two words and their places."""
    pair = K.window_checks(words, np.arange(max(len(words.start) - 1, 0)), 2)
    a, b = words.first[:-1], words.first[1:]
    place = np.arange(len(pair)) - np.repeat(a, b - a)[: len(pair)]
    with np.errstate(over="ignore"):
        total = np.r_[_U(0), np.cumsum(K.mix(pair + K.mix(place.astype(_U))))]
        a, b = np.minimum(a, len(pair)), np.minimum(np.maximum(b - 1, a), len(pair))  # a last document may have no words
        return total[b] - total[a]


def _slices(batch, at: int):
    """(row range, words, doc_ids, whole-sequence hashes) of a batch with doc_id first."""
    ids = batch.column(0).cast(pa.int64())
    null = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy()
    data, offs = K.string_buffer(batch.column(at))
    for i, j in K.slices(offs):
        words = K.split_words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        yield i, j, words, ids[i:j], null[i:j], K.sequence_hash(words)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = BROADCAST_KEYS, per_part: int = PART_ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, text (kept words).

    Kept words are joined by one space.  Null and empty texts have no words.
    A null doc_id is neither smaller nor larger than another: such rows lose
    and cost nothing.  Rows with equal doc_ids, repeated ones too, don't remove
    each other's words.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    @K.tidy
    def sequence(batches):
        for batch in batches:
            for i, j, words, ids, null, seq in _slices(batch, 1):
                ok = ~null & (np.diff(words.first) >= window)
                yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(seq[ok].view(np.int64)), pa.array(_second(words)[ok].view(np.int64)), pa.array(_row_key(ids, seq)[ok].view(np.int64))], names=["doc_id", "seq", "check", "key"])

    rows = stage(docs.mapInArrow(sequence, "doc_id long, seq long, check long, key long"), "substring_rows")
    # A hash shared by different sequences makes no copies; their windows are compared.
    first = rows.groupBy("seq").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    first = stage(first.where("first < last and lo = hi").select("seq", "first", "n"), "substring_sequences")
    copies = stage(attach(rows.select("doc_id", "seq", "key"), first, "seq", "n").where("doc_id > first").select("doc_id", "key").distinct(), "substring_copies")
    skip = KeyFile(copies, "key", most)

    def each(batches, start):
        """Window starts, hashes, anchors of documents that are no copies, a batch's slice at a time."""
        copied = skip.load()
        for batch in batches:
            for i, j, words, ids, null, seq in _slices(batch, start):
                at, full, least = anchors(words, window, gram)
                doc = words.doc[at]
                bad = null | _isin(_row_key(ids, seq), copied)
                ok = ~bad[doc]
                yield words, ids, at[ok], doc[ok], full[ok], least[ok]

    @K.tidy
    def count(batches):
        for batch in batches:
            many: list[np.ndarray] = []
            for _, ids, _, doc, _, least in each([batch], 1):
                order = np.lexsort((doc, least))
                a, d = least[order], ids[doc[order]]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
                many.append(a[new])
            if many:
                h, n = np.unique(np.concatenate(many), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], names=["anchor", "n"])

    shared = docs.mapInArrow(count, "anchor long, n byte").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    shared = stage(shared, "substring_anchors")
    keys = KeyFile(shared, "anchor", most)

    @K.tidy
    def windows(batches):
        table = keys.load()
        for batch in batches:
            for words, ids, at, doc, full, least in each([batch], 1):
                ok = _isin(least, table) if table is not None else np.ones(len(least), bool)
                d, h, a, at = ids[doc[ok]], full[ok], least[ok], at[ok]
                order = np.lexsort((h, d))
                d, h, a, at = d[order], h[order], a[order], at[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                check = K.window_checks(words, at[new], window)
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(check.view(np.int64)), pa.array(d[new]), pa.array(a[new].view(np.int64))], names=["hash", "check", "doc_id", "anchor"])

    found = docs.mapInArrow(windows, "hash long, check long, doc_id long, anchor long")
    if not keys.fits:
        found = found.join(shared, "anchor", "left_semi")
    found = found.drop("anchor")
    # Copies stand for their first document, which is smaller and not skipped.
    least = found.groupBy("hash", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    least = stage(least.where("first < last").select("hash", F.col("check").alias("same"), "first", "n"), "substring_windows")
    gone = attach(found, least, "hash", "n").where("doc_id > first and check = same").select("doc_id", "hash")
    marks = gone.groupBy("doc_id").agg(F.collect_list("hash").alias("hashes")).join(copies.groupBy("doc_id").agg(F.collect_set("key").alias("copies")), "doc_id", "full")
    # Rows without a doc_id match nothing; they and rows of a frequent doc_id are dealt by text and input partition.
    keyed = docs.withColumn("_from", F.spark_partition_id()).withColumn("_null", F.col("doc_id").isNull())
    keyed = keyed.withColumn("_key", F.coalesce("doc_id", F.xxhash64("text", "_from")))
    marks = marks.select(F.col("doc_id").alias("_key"), F.lit(False).alias("_null"), "hashes", "copies")
    ids = docs.where("doc_id is not null").select(F.col("doc_id").alias("_key"), F.lit(False).alias("_null"))
    joined = spread_join(keyed, marks, ["_key", "_null"], ["text", "_from"], ids, per_part, "left").select("doc_id", "text", "hashes", "copies")

    @K.tidy
    def result(batches):
        for batch in batches:
            lists = [batch.column(k) for k in (2, 3)]
            for i, j, words, ids, null, seq in _slices(batch, 1):
                n, total = j - i, len(words.start)
                at, full, _ = anchors(words, window, gram)
                doc = words.doc
                flat = []
                for column in lists:
                    part = column.slice(i, n)
                    size = pa.compute.fill_null(pa.compute.list_value_length(part), 0).to_numpy()
                    flat.append((np.repeat(np.arange(n), size), part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(_U)))
                with np.errstate(over="ignore"):
                    tag = lambda d, h: K.mix(h + _U(0x632BE59BD9B4E019) * d.astype(_U))
                    hit = _isin(tag(doc[at], full), np.sort(tag(*flat[0])))
                    copy = _isin(tag(np.arange(n), _row_key(ids, seq)), np.sort(tag(*flat[1])))
                hit |= copy[doc[at]]
                cover = np.zeros(total + 1, np.int64)
                np.add.at(cover, at[hit], 1)
                np.add.at(cover, at[hit] + window, -1)
                keep = np.cumsum(cover)[:total] == 0
                n_words = np.diff(words.first)
                kept = np.diff(np.r_[0, np.cumsum(keep)][words.first])
                raw = words.data.tobytes()
                texts = []
                for k in range(n):
                    a, b = words.first[k], words.first[k + 1]
                    some = np.flatnonzero(keep[a:b]) + a
                    texts.append(b" ".join([raw[s:e] for s, e in zip(words.start[some].tolist(), words.end[some].tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(n_words.astype(np.int64)), pa.array((n_words - kept).astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"],
                )

    return joined.mapInArrow(result, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")
