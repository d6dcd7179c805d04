"""Suffix automata of bounded reference shards, and matching statistics of documents.

An automaton over word hashes is built online, one state or two a word; each
state keeps the least document of its end positions.  Streaming a document
through it gives, for every word, the longest reference span that ends there.
Shards hold at most SHARD_WORDS words and are broadcast one by one; documents
pass all shards in one scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import forget, map_text, word_count

#: Words of one shard: bounds the automaton that a task holds.
SHARD_WORDS = 200_000
#: Shards of a reference, at most: each is broadcast and streamed past every document.
MOST_SHARDS = 50


class SuffixAutomaton:
    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words) -> None:
        """One text; texts are separated, so no span crosses a border."""
        last = 0
        nxt, link, length = self.next, self.link, self.length
        for w in words:
            got = nxt[last].get(w)
            if got is not None and length[got] == length[last] + 1:
                last = got
                continue
            if got is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                p = last
                while p != -1 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][w]
                    link[cur] = q if length[p] + 1 == length[q] else self._clone(p, q, w)
                last = cur
            else:
                last = self._clone(last, got, w)

    def _clone(self, p: int, q: int, w) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        link[q] = new
        return new

    def statistics(self, words) -> list[int]:
        """Length of the longest span of any text that ends at each word."""
        nxt, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def _shards(reference: DataFrame, most: int):
    now, n = SuffixAutomaton(), 0
    for (text,) in reference.select(F.coalesce("text", F.lit(""))).toLocalIterator():
        data, offs = K.string_buffer(pa.array([text], pa.large_string()))
        words = K.split_words(data, offs).hash.tolist()
        if n and n + len(words) > most:
            yield now
            now, n = SuffixAutomaton(), 0
        now.add(words)
        n += len(words)
    if n:
        yield now


def remove_reference_spans(docs: DataFrame, reference: DataFrame, keep: list[str] = ["doc_id"], threshold: int = 13, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Adds ``kept`` (struct of text and n_removed): documents without their maximal
    spans of ``threshold`` or more words that the reference holds.

    For a reference of bounded size, such as an evaluation set or a licence
    collection: the driver holds one shard at a time.  A text longer than a
    shard is a shard of its own.  Null and empty texts keep nothing and lose
    nothing; an empty reference removes nothing.
    """
    words = reference.select(F.sum(word_count(F.col("text")))).first()[0] or 0
    if words > MOST_SHARDS * max(shard_words, SHARD_WORDS):
        raise ValueError(f"a reference of {words} words is more than {MOST_SHARDS} shards; use substring.remove_repeats")
    shared = [docs.sparkSession.sparkContext.broadcast((a.next, a.link, a.length)) for a in _shards(reference, shard_words)]

    def make():
        def work(data, offs, nulls):
            words = K.split_words(data, offs)
            cover = np.zeros(len(words.hash) + 1, np.int64)
            for b in shared:
                a = SuffixAutomaton()
                a.next, a.link, a.length = b.value
                for k in range(len(nulls)):
                    s, e = words.first[k], words.first[k + 1]
                    stat = np.asarray(a.statistics(words.hash[s:e].tolist()), np.int64)
                    end = np.flatnonzero(stat >= threshold)
                    np.add.at(cover, s + end - stat[end] + 1, 1)
                    np.add.at(cover, s + end + 1, -1)
                if len(shared) > 1:
                    forget(b)
            stay = np.cumsum(cover)[:-1] == 0
            raw, texts, gone = words.data.tobytes(), [], []
            for k in range(len(nulls)):
                s, e = words.first[k], words.first[k + 1]
                some = np.flatnonzero(stay[s:e]) + s
                texts.append(b" ".join(raw[p:q] for p, q in zip(words.start[some].tolist(), words.end[some].tolist())).decode("utf-8", "replace"))
                gone.append(int(e - s - len(some)))
            return [pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(gone, pa.int64())], names=["text", "n_removed"])]

        return work

    return map_text(docs, keep, "kept struct<text:string,n_removed:long>", make)
