"""Benchmark decontamination by winnowing.

A shared span of WINDOW words holds WINDOW - GRAM + 1 consecutive GRAM-grams;
keeping the least GRAM-gram hash of every such run (all of them on a tie) on
both sides makes every shared span share a kept fingerprint.  A document's
fingerprints look up the benchmark's, each hit is extended to the windows
around it, and windows that agree in full mark the document's words.

A benchmark of at most BLOCK_WORDS words, counted first, is indexed and
broadcast, and the documents are one pass, without a shuffle.  A larger one is
joined with the documents by fingerprint: distinct texts and items that share a
fingerprint meet, frequent fingerprints dealt over parts, and each pair is
extended on its own.  Items shorter than a window are matched as one n-gram of
their own length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import attach, map_text, quoted, ship, spread_join, stage

WINDOW, GRAM = 10, 5
#: Words of a benchmark that is broadcast, at most.
BLOCK_WORDS = 4_000_000
#: Words of the contract, before letters are lowered.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPANS = "array<struct<start:int,end:int>>"


def fingerprints(h: np.ndarray, whole: np.ndarray, run: int) -> np.ndarray:
    """Positions kept by winnowing; ``whole`` marks where a full window begins."""
    n = len(h)
    keep = np.zeros(n, bool)
    at = np.flatnonzero(whole)
    if not len(at):
        return at
    least = h[at].copy()
    for j in range(1, run):
        np.minimum(least, h[at + j], out=least)
    for j in range(run):
        keep[at[h[at + j] == least] + j] = True
    return np.flatnonzero(keep)


class Index:
    """Fingerprints, distinct windows and short items of some benchmark items, and which items each window is of.

    However many items share a window, it is one entry; its items are a list
    kept once for all windows with the same items.
    """

    def __init__(self, ids: list[str], texts: list[str], window: int, gram: int):
        data, offs = K.string_buffer(pa.array(texts, pa.large_string()))
        words = K.split_words(data, offs, K.ALNUM, lower=True)
        self.ids = ids
        full, g = K.ngram_hashes(words, window), K.ngram_hashes(words, gram)
        self.prints = np.unique(g[fingerprints(g, full != 0, window - gram + 1)])
        self._lists: list[np.ndarray] = []
        self._known: dict[bytes, int] = {}
        item = words.doc.astype(np.int32)
        self.windows, self.window_list = self._grouped(full[full != 0], item[full != 0])
        count = np.diff(words.first)
        self.short = {}
        for n in range(1, window):
            own = np.flatnonzero(count == n)
            if len(own):
                self.short[n] = self._grouped(K.ngram_hashes(words, n)[words.first[own]], own.astype(np.int32))
        self._known = {}

    def _grouped(self, h: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes, ascending, and the list of items of each: an item's number, or one behind all items."""
        order = np.lexsort((item, h))
        h, item = h[order], item[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (item[1:] != item[:-1])][: len(h)]
        h, item = h[new], item[new]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        size = np.diff(np.r_[start, len(h)])
        lists = item[start].astype(np.int64)
        for k in np.flatnonzero(size > 1).tolist():
            own = item[start[k] : start[k] + size[k]]
            at = self._known.setdefault(own.tobytes(), len(self._lists))
            if at == len(self._lists):
                self._lists.append(own)
            lists[k] = len(self.ids) + at
        return h[start], lists

    def items(self, lists: np.ndarray) -> np.ndarray:
        """The distinct items of some lists."""
        many = lists[lists >= len(self.ids)] - len(self.ids)
        return np.unique(np.concatenate([lists[lists < len(self.ids)], *[self._lists[k] for k in many.tolist()]])).astype(np.int64)


def _found(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys an ascending table of distinct hashes has, and where."""
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    who = np.flatnonzero(table[at] == keys)
    return who, at[who]


def hits(words: K.Words, index: Index, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, list of items) of every matched window, each once."""
    full, g = K.ngram_hashes(words, window), K.ngram_hashes(words, gram)
    at = fingerprints(g, full != 0, window - gram + 1)
    at = at[_found(g[at], index.prints)[0]]
    # The windows around a shared fingerprint, then those that agree in full.
    x = np.unique((at[:, None] - np.arange(window - gram + 1)).ravel())
    x = x[x >= 0]
    x = x[full[x] != 0]
    who, row = _found(full[x], index.windows)
    out = [(x[who], np.full(len(who), window), index.window_list[row])]
    for n, (table, lists) in index.short.items():
        h = K.ngram_hashes(words, n)
        some = np.flatnonzero(h)
        who, row = _found(h[some], table)
        out.append((some[who], np.full(len(who), n), lists[row]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _ranges(hit: np.ndarray, words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hit words as (document, first word, end) within the document."""
    doc = words.doc
    begin, finish = hit.copy(), hit.copy()
    begin[1:] &= ~(hit[:-1] & (doc[1:] == doc[:-1]))
    finish[:-1] &= ~(hit[1:] & (doc[1:] == doc[:-1]))
    s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return doc[s], s - words.first[doc[s]], e - words.first[doc[s]]


def _covered(start: np.ndarray, length: np.ndarray, total: int) -> np.ndarray:
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + length, -1)
    return np.cumsum(cover)[:total] > 0


def _lists(doc: np.ndarray, n: int, arrays: list[np.ndarray], names: list[str]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum(np.bincount(doc, minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in arrays], names=names))


def decontaminate(docs: DataFrame, bench: DataFrame, keep: list[str] = ["doc_id"], into: str = "hits", window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds the column ``into``: struct of n_words, n_hit, items (distinct ids, as strings) and
    spans (hit word ranges, end exclusive), beside the columns of ``keep``.

    Null and empty texts have no words and no hits.  A null item id reads as
    the empty string; equal ids count once; null and repeated doc_ids are
    ordinary rows.  An empty benchmark hits nothing, an empty table gives no
    rows.  Other columns are ignored, whatever their names.
    """
    bench = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.greatest(F.regexp_count("text", F.lit(WORDS)) + 1, F.octet_length("text") / 16)  # long runs of other characters count too
    if (bench.select(F.sum(size)).first()[0] or 0) > block_words:
        return _joined(docs, bench, keep, into, window, gram)
    rows = bench.collect()  # at most block_words words
    shared = docs.sparkSession.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], window, gram))

    def make():
        index = shared.value

        def work(data, offs, nulls):
            words = K.split_words(data, offs, K.ALNUM, lower=True)
            start, length, lists = hits(words, index, window, gram)
            pair = np.unique(np.stack([words.doc[start].astype(np.int64), lists]), axis=1)
            ends = np.searchsorted(pair[0], np.arange(len(nulls) + 1))
            found = [{index.ids[k] for k in index.items(pair[1, a:b]).tolist()} if b > a else () for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            hit = _covered(start, length, len(words.start))
            n_hit = np.diff(np.r_[0, np.cumsum(hit)][words.first])
            doc, s, e = _ranges(hit, words)
            items = pa.array([sorted(x) for x in found], pa.list_(pa.string()))
            return [pa.StructArray.from_arrays([pa.array(np.diff(words.first).astype(np.int64)), pa.array(n_hit.astype(np.int64)), items, _lists(doc, len(nulls), [s, e], ["start", "end"])], names=["n_words", "n_hit", "items", "spans"])]

        return work

    return map_text(docs, keep, f"`{into}` struct<n_words:long,n_hit:long,items:array<string>,spans:{SPANS}>", make)


def _joined(docs: DataFrame, bench: DataFrame, keep: list[str], into: str, window: int, gram: int) -> DataFrame:
    """The same through a join of fingerprints, for a benchmark of any size.

    Equal texts are one (by SHA-256), so copies are matched once.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    picked = docs.select(*[quoted(c).alias(f"_{k}") for k, c in enumerate(keep)], text.alias("text"), F.sha2(text, 256).alias("doc"))
    owners = stage(bench.select("item_id", F.sha2("text", 256).alias("item")).distinct(), "bench_items")
    items = stage(bench.select(F.sha2("text", 256).alias("item"), "text").distinct(), "bench_texts")
    sizes = items.select(F.regexp_count("text", F.lit(WORDS)).alias("n")).where(f"n between 1 and {window - 1}")
    short = sorted(r[0] for r in sizes.distinct().collect())  # fewer than window values

    def prints(side: str):
        """(print, key): fingerprints of full windows, and whole n-grams of the lengths of short items."""
        @K.tidy
        def run(batches):
            for batch in batches:
                data, offs = K.string_buffer(batch.column(1))
                for i, j in K.slices(offs):
                    words = K.split_words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], K.ALNUM, lower=True)
                    g = K.ngram_hashes(words, gram)
                    at = fingerprints(g, K.ngram_hashes(words, window) != 0, window - gram + 1)
                    values, doc = [g[at]], [words.doc[at]]
                    count = np.diff(words.first)
                    for n in short:
                        h = K.ngram_hashes(words, n)
                        at = words.first[:-1][count == n] if side == "item" else np.flatnonzero(h)
                        values.append(K.mix(h[at] + np.uint64(n)))
                        doc.append(words.doc[at])
                    both = np.unique(np.stack([np.concatenate(doc).astype(np.uint64), np.concatenate(values)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[1].view(np.int64)), batch.column(0).slice(i, j - i).take(pa.array(both[0].astype(np.int64)))], names=["print", side])

        return run

    theirs = items.select("item", "text").mapInArrow(prints("item"), "print long, item string").distinct()
    ours = stage(picked.select("doc", "text").mapInArrow(prints("doc"), "print long, doc string").distinct(), "bench_prints")
    pairs = stage(spread_join(ours, theirs, ["print"], ["doc"]).select("doc", "item").distinct(), "bench_pairs")
    # One text per key: copies meet in their own tasks before they move.
    texts = picked.join(pairs.select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.first("text").alias("text"))
    wide = spread_join(pairs, texts, ["doc"], ["item"])
    wide = spread_join(wide, items.withColumnRenamed("text", "item_text"), ["item"], ["doc"], pairs).select("doc", "item", "text", "item_text").sortWithinPartitions("item")

    @K.tidy
    def extend(batches):
        index, known = None, None
        for batch in batches:
            out = []
            for doc, item, text, own in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if item != known:  # rows come by item: its index is built once
                    index, known = Index([item], [own], window, gram), item
                words = K.split_words(*K.string_buffer(pa.array([text], pa.large_string())), K.ALNUM, lower=True)
                start, length, _ = hits(words, index, window, gram)
                if len(start):
                    _, s, e = _ranges(_covered(start, length, len(words.start)), words)
                    out.append((doc, item, [{"start": int(x), "end": int(y)} for x, y in zip(s, e)]))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc", "item", "spans"])

    found = stage(wide.mapInArrow(extend, f"doc string, item string, spans {SPANS}"), "bench_found")

    def merge(acc, s):
        """Adds a span in order of start: overlapping and touching ones become one."""
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(last.isNotNull() & (s["start"] <= last["end"]), grown).otherwise(F.concat(acc, F.array(s)))

    spans = found.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")).select("doc", F.aggregate("spans", F.array().cast(SPANS), merge).alias("spans"))
    ids = found.join(owners, "item").groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = picked.groupBy("doc").agg(F.count("*").alias("copies"))
    hit = stage(spans.join(ids, "doc").join(rows, "doc"), "bench_hits")
    kept = [f"_{k}" for k in range(len(keep))]
    counted = picked.select(*kept, "doc", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("n_words"))
    out = attach(counted, hit, "doc", "copies")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]), F.lit(0).cast("long"))
    result = F.struct("n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    return out.select(*[F.col(x).alias(c) for x, c in zip(kept, keep)], result.alias(into))
