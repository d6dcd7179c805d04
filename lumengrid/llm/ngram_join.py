"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters.

1.  One pass counts shingles into a table of fixed size (COUNTERS cells) and
    gives every document its set's size, a hash of the whole set (equal sets
    are one class from here on) and a 16-cell histogram of the set.
2.  A class's shingles are ordered by (cell count, hash); the first
    n - ceil(t n) + 1 are its prefix.  Two sets at or above the threshold share
    a prefix shingle, whatever the order; rare shingles first keeps the
    buckets small, and counts only steer it.
3.  Each bucket links its classes to one leader (the class in which the
    shingle stands earliest).  A group of thousands of near copies costs one
    candidate per member and bucket, not all pairs.  Verified links give first
    components.
4.  Buckets that still hold several components are joined in full: every pair
    of different components, minus pairs inside the bucket's largest one, under
    the length and positional filters, then once per pair the suffix bound from
    the histograms, then exact sets.  So no link between components is lost.

Buckets that the counts expect to be large are dealt into parts by class for
the leader step, so no bucket needs to fit one task.  A text in many pairs, and
a shingle with many classes in step 4, is dealt over parts too.  Classes are
sets with two equal 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import attach, map_text, ship, spread_join, stage
from .components import components

COUNTERS = 1 << 22
#: Cells per row of the partial count tables.
SEGMENT = 1 << 18
CELLS = 16
#: Classes of a bucket part, about, in the leader step.
PART_ROWS = 20_000
#: Ids that a broadcast filter may hold.
BROADCAST_IDS = 2_000_000
_U = np.uint64


def shingle_sets(words: K.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash), distinct, sorted by both.

    A document of fewer words, but not none, has its whole sequence as one.
    """
    g = K.ngram_hashes(words, n)
    doc = words.doc
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < n))
    ok = g != 0
    h, d = g[ok], doc[ok]
    if len(short):
        with np.errstate(over="ignore"):
            whole = K.sequence_hash(words)[short] * _U(3) + _U(1)
        h, d = np.r_[h, whole], np.r_[d, short]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def _class_hash(d: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, size, second hash) of each document's set."""
    size = np.bincount(d, minlength=n)
    first = np.searchsorted(d, np.arange(n + 1))

    def total(salt: int) -> np.ndarray:
        run = np.r_[_U(0), np.cumsum(K.mix(h ^ _U(salt)))]
        return K.mix((run[first[1:]] - run[first[:-1]]) + size.astype(_U))

    with np.errstate(over="ignore"):
        return total(0x5851F42D4C957F2D), size, total(0x2545F4914F6CDD1D)


def split_clashes(cls: np.ndarray, check: np.ndarray, clashes: dict[int, int]) -> np.ndarray:
    """Gives sets that share a class, but not the second hash kept for it, another class, and so on until each fits its own."""
    while clashes:
        keep = np.array([clashes.get(c, k) for c, k in zip(cls.view(np.int64).tolist(), check.view(np.int64).tolist())], np.int64)
        away = check.view(np.int64) != keep
        if not away.any():
            break
        cls = np.where(away, K.mix(cls ^ check), cls)
    return cls


def describe(docs: DataFrame, n: int, clashes: dict[int, int] = {}) -> DataFrame:
    """(doc_id, n_shingles, cls, check, cells) of every row; cls is null for an empty set."""
    def make():
        def work(data, offs, nulls):
            words = K.split_words(data, offs, lower=True)
            d, h = shingle_sets(words, n)
            cls, size, check = _class_hash(d, h, len(nulls))
            cls = split_clashes(cls, check, clashes)
            cell = np.bincount(d * CELLS + (h & _U(CELLS - 1)).astype(np.int64), minlength=CELLS * len(nulls)).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, len(cell) + 1, CELLS, dtype=np.int32)), pa.array(cell))
            return [size.astype(np.int64), pa.array(cls.view(np.int64), mask=size == 0), check.view(np.int64), cells]

        return work

    return map_text(docs, ["doc_id"], "n_shingles long, cls long, check long, cells array<int>", make)


def count_table(docs: DataFrame, n: int, counters: int = COUNTERS) -> np.ndarray:
    """How often shingles fall in each cell, over all documents; a table of fixed size."""
    ship(docs.sparkSession)

    @K.tidy
    def count(batches):
        table, seen = np.zeros(counters, np.uint32), False
        for batch in batches:
            data, offs = K.string_buffer(batch.column(0))
            for i, j in K.slices(offs):
                seen = True
                words = K.split_words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower=True)
                _, h = shingle_sets(words, n)
                cell, c = np.unique((h >> _U(20)) & _U(counters - 1), return_counts=True)
                table[cell.astype(np.int64)] += c.astype(np.uint32)
        if seen:
            step = min(SEGMENT, counters)
            low = np.minimum(table, 65535).astype(np.uint16)
            for k in range(0, counters, step):
                yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), pa.array([zlib.compress(low[k : k + step].tobytes(), 1)])], names=["segment", "cells"])

    def add(key, batches):
        total = 0
        for batch in batches:
            for x in batch.column("cells"):
                total = total + np.frombuffer(zlib.decompress(x.as_py()), np.uint16).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 1 << 31).astype(np.uint32).tobytes()])], names=["segment", "cells"])

    def total(key, table):
        return pa.Table.from_batches(list(add(key, table.to_batches())))

    schema = "segment int, cells binary"
    rows = docs.select("text").mapInArrow(count, schema).groupBy("segment").applyInArrow(total, schema)
    out = np.zeros(counters, np.uint32)
    for k, cells in rows.toLocalIterator():  # COUNTERS cells in all
        part = np.frombuffer(cells, np.uint32)
        out[k * len(part) : (k + 1) * len(part)] = part
    return out


def postings(docs: DataFrame, n: int, percent: int, table: np.ndarray, part_rows: int = PART_ROWS, clashes: dict[int, int] = {}) -> DataFrame:
    """(shingle, part, cls, pos, size): the prefix of every class, once per slice.

    Part 0 is a whole bucket; the parts of a dealt one are numbered from 1.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(table)

    @K.tidy
    def run(batches):
        counts = shared.value
        for batch in batches:
            data, offs = K.string_buffer(batch.column(0))
            for i, j in K.slices(offs):
                words = K.split_words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower=True)
                d, h = shingle_sets(words, n)
                cls, size, check = _class_hash(d, h, j - i)
                cls = split_clashes(cls, check, clashes)
                once = np.zeros(j - i, bool)
                once[np.unique(cls, return_index=True)[1]] = True
                keep = once[d]
                d, h = d[keep], h[keep]
                if not len(d):
                    continue
                c = counts[((h >> _U(20)) & _U(len(counts) - 1)).astype(np.int64)]
                order = np.lexsort((h, c, d))
                d, h, c = d[order], h[order], c[order]
                pos = np.arange(len(d)) - np.searchsorted(d, d)
                prefix = size - (size * percent + 99) // 100 + 1
                ok = pos < prefix[d]
                d, h, c, pos = d[ok], h[ok], c[ok], pos[ok]
                own = cls[d]
                parts = c.astype(_U) // _U(part_rows) + _U(1)
                part = (own >> _U(33)) % parts + (parts > 1)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(own.view(np.int64)), pa.array(pos.astype(np.int32)), pa.array(size[d].astype(np.int32))], names=["shingle", "part", "cls", "pos", "size"])

    return docs.select("text").mapInArrow(run, "shingle long, part int, cls long, pos int, size int")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length and positional filters for two postings of one shingle."""
    sa, sb, pa_, pb = (F.col(f"{x}.{y}").cast("long") for y in ("size", "pos") for x in (a, b))
    fits = F.least(sa, sb) * 100 >= F.greatest(sa, sb) * percent
    left = F.least(sa - pa_, sb - pb)
    return fits & (left * (100 + percent) >= (sa + sb) * percent)


def _pair(a: str, b: str) -> list[Column]:
    x, y = F.col(f"{a}.cls"), F.col(f"{b}.cls")
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs of classes whose sets reach the threshold: suffix bound, then exact."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("cells").alias(f"cells_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    bound = F.aggregate(F.zip_with("cells_a", "cells_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    pairs = pairs.where(bound * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b", "rep_a", "rep_b")
    pairs = stage(pairs, "join_pairs")
    wanted = stage(pairs.select(F.col("rep_a").alias("doc_id")).unionByName(pairs.select(F.col("rep_b").alias("doc_id"))).distinct(), "join_ids")
    some = wanted.count()
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if some <= BROADCAST_IDS else wanted, "doc_id", "left_semi")
    texts = stage(texts, "join_texts")
    narrow = pairs
    for x in ("a", "b"):
        pairs = spread_join(pairs, texts.select(F.col("doc_id").alias(f"rep_{x}"), F.col("text").alias(f"text_{x}")), [f"rep_{x}"], ["a", "b"], narrow)

    @K.tidy
    def check(batches):
        for batch in batches:
            both = []
            for k in (2, 3):
                both.append(K.string_buffer(batch.column(k)))
            (da, oa), (db, ob) = both
            for i, j in K.slices(oa + ob):
                sets = []
                for data, offs in both:
                    words = K.split_words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower=True)
                    sets.append(shingle_sets(words, n))
                d = np.concatenate([s[0] for s in sets])
                h = np.concatenate([s[1] for s in sets])
                order = np.lexsort((h, d))
                d, h = d[order], h[order]
                twice = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
                shared = np.bincount(d[1:][twice], minlength=j - i)
                union = sum(np.bincount(s[0], minlength=j - i) for s in sets) - shared
                ok = (100 * shared >= percent * union) & (union > 0)
                part = batch.slice(i, j - i).select(["a", "b"])
                yield part.filter(pa.array(ok))

    return stage(pairs.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long").distinct(), "join_links")


def _classes(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Every row's description, one row per class, and the classes that two sets shared at first.

    Sets that share a class are told apart by their second hash, round by round
    until none share one; all rounds' classes stay known.  Of m sets
    m**2 / 2**65 pairs clash: none, or a few hundred among 10**11.
    """
    clashes: dict[int, int] = {}
    while True:
        info = stage(describe(docs, n, clashes), "join_info")
        classes = info.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("cells").alias("cells"), F.count("*").alias("n_copies"), F.min("check").alias("lo"), F.max("check").alias("hi"))
        classes = stage(classes, "join_classes")
        found = {r[0]: r[1] for r in classes.where("lo != hi").select("cls", "lo").collect()}
        if not found:
            return info.drop("check"), classes.drop("lo", "hi"), clashes
        clashes |= found


def join(docs: DataFrame, n: int = 5, percent: int = 80, counters: int = COUNTERS, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, cls, component_id, n_copies, n_links.

    Two documents link when 100 * intersection >= percent * union of their
    distinct n-word shingles; component_id is the least doc_id reachable.
    Classes are equal sets; n_copies counts rows of the class, n_links the
    classes that the class was verified to link with (a spanning part of the
    links inside a component).  A document without words links with nothing
    and is its own component.  A class whose doc_ids are all null keeps to
    itself; null and repeated doc_ids are ordinary rows otherwise.
    """
    info, classes, clashes = _classes(docs, n)
    table = count_table(docs, n, counters)
    rows = postings(docs, n, percent, table, part_rows, clashes).distinct()
    bucket = Window.partitionBy("shingle", "part")
    lead = F.min(F.struct("pos", "cls", "size")).over(bucket)
    wide = rows.withColumn("lead", lead).withColumn("last", F.max("cls").over(bucket)).withColumn("first", F.min("cls").over(bucket))
    # A class may be alone in a part of a dealt shingle, and still share the shingle with other parts.
    wide = stage(wide.where("first != last or part > 0").select("shingle", "part", "cls", "pos", "size", "lead"), "join_postings")
    first = wide.select(F.struct("cls", "pos", "size").alias("x"), F.col("lead").alias("y")).where("x.cls != y.cls").where(_may_link("x", "y", percent)).select(*_pair("x", "y")).distinct()
    links = verify(first, classes, docs, n, percent)
    found = components(links, "a", "b")
    label = lambda df: df.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    rest = label(wide.select("shingle", "cls", "pos", "size"))
    groups = rest.groupBy("shingle", "component").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("k"))
    rest = attach(rest, stage(groups.where("parts > 1").drop("parts"), "join_groups"), "shingle", "k").where("main is not null").drop("k")
    # A partner's size lies within the length filter, so each class looks in the size bins that this allows.
    bin_of = lambda x: F.floor(F.log(x.cast("double")) / abs(np.log(percent / 100)))
    rest = stage(rest.withColumn("bin", bin_of(F.col("size"))), "join_rest")
    one = F.struct("cls", "pos", "size", "component")
    few = rest.where("component != main").select("shingle", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), one.alias("x"))
    every = rest.select("shingle", "bin", "main", one.alias("y"), "cls")
    twice = (F.col("y.component") == F.col("main")) | (F.col("x.cls") < F.col("y.cls"))
    more = spread_join(every, few, ["shingle", "bin"], ["cls"], rest).where((F.col("x.component") != F.col("y.component")) & twice & _may_link("x", "y", percent))
    more = more.select(*_pair("x", "y")).distinct()
    links = stage(links.unionByName(verify(more, classes, docs, n, percent)).distinct(), "join_links")
    found = components(links, "a", "b")
    degree = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n_links"))
    classes = label(classes).join(degree, "cls", "left")
    # The least doc_id of a component: one row per component, then back to its classes.
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("weight"))
    total = classes.count()
    classes = stage(attach(classes, least, "component", "weight", total).select("cls", "component_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "join_result")
    out = attach(info.select("doc_id", "n_shingles", "cls"), classes, "cls", "n_copies", info.count())
    return out.select("doc_id", "n_shingles", "cls", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
