"""Language identification: script ranges, per-word scores, and Viterbi spans.

The model is multinomial over hashed byte trigrams of words (with the spaces
around them), one row per language, fitted on a bounded sample of labelled
rows.  For each word the scripts of its bytes rule out languages that were
hardly ever seen with them; the others score the word.  Viterbi with a fixed
penalty for a change of language then labels every word.

Almost every document stays in one language, and that can be proven without
the sequential pass: if no other language ever gains half of SWITCH over any
run of words, a path with r runs in other languages gains less than r halves
and pays for at least r changes (or r - 1, if r is 2 or more), so it can't win.
Only documents that fail this test are decoded word by word.  Both give the
same labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import map_text, stage

BUCKETS = 1 << 15
#: Labelled rows per language that the model is fitted on, about; the bound of the sample.
TRAIN_ROWS = 20_000
SWITCH = 20.0
FOLDS = 5
#: A language admits a script that at least this share of its words use.
SCRIPT_SHARE = 0.002
BARRED = -60.0
UNKNOWN = "und"

# Code-point ranges of scripts (Unicode blocks), one number a script.  Plain ASCII is common to all.
SCRIPT_RANGES = [
    [(0xC0, 0x24F), (0x1E00, 0x1EFF)],  # Latin beyond ASCII
    [(0x370, 0x3FF), (0x1F00, 0x1FFF)],  # Greek
    [(0x400, 0x52F)],  # Cyrillic
    [(0x530, 0x58F)],  # Armenian
    [(0x590, 0x5FF)],  # Hebrew
    [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],  # Arabic
    [(0x700, 0x74F)],  # Syriac
    [(0x900, 0x97F)],  # Devanagari
    [(0x980, 0x9FF)],  # Bengali
    [(0xA00, 0xA7F)],  # Gurmukhi
    [(0xA80, 0xAFF)],  # Gujarati
    [(0xB00, 0xB7F)],  # Oriya
    [(0xB80, 0xBFF)],  # Tamil
    [(0xC00, 0xC7F)],  # Telugu
    [(0xC80, 0xCFF)],  # Kannada
    [(0xD00, 0xD7F)],  # Malayalam
    [(0xD80, 0xDFF)],  # Sinhala
    [(0xE00, 0xE7F)],  # Thai
    [(0xE80, 0xEFF)],  # Lao
    [(0xF00, 0xFFF)],  # Tibetan
    [(0x1000, 0x109F)],  # Myanmar
    [(0x10A0, 0x10FF)],  # Georgian
    [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],  # Hangul
    [(0x1200, 0x139F)],  # Ethiopic
    [(0x1780, 0x17FF)],  # Khmer
    [(0x1800, 0x18AF)],  # Mongolian
    [(0x3040, 0x30FF), (0x31F0, 0x31FF)],  # Kana
    [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],  # Han
]
N_SCRIPTS = len(SCRIPT_RANGES)
#: Labels that the training rows may have; more are refused, since each costs a pass over the text.
MOST_LANGS = 1000


def _script_table() -> np.ndarray:
    """Script bit by the first two bytes of a UTF-8 character: exact for two-byte characters, by 64 code points for three."""
    table = np.zeros(1 << 16, np.uint64)
    for bit, ranges in enumerate(SCRIPT_RANGES):
        for lo, hi in ranges:
            for cp in range(lo, hi + 1, 1 if hi < 0x800 else 64):
                b = chr(cp).encode("utf-8")
                table[b[0] << 8 | b[1]] |= np.uint64(1 << bit)
    return table


SCRIPT_OF = _script_table()


def held_out(docs: DataFrame):
    """Remainder 0 of crc32(doc_id as text) by FOLDS; null ids are held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(True))


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that begins at each byte, white space as one sort, letters folded."""
    b = K.LOWER[data].astype(np.uint32)
    b[K.SPACE[data]] = 0x20
    b = np.concatenate([b, np.full(2, 0x20, np.uint32)])
    t = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    return ((t * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32)


def padded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before and after each document, so that words have their edges and no trigram of a word reaches the next document."""
    n = len(offs) - 1
    out = np.full(len(data) + 2 * n, 0x20, np.uint8)
    shift = np.repeat(2 * np.arange(n) + 1, np.diff(offs))
    out[np.arange(len(data)) + shift] = data
    return out, offs + 2 * np.arange(n + 1)


def word_scripts(words: K.Words, data: np.ndarray) -> np.ndarray:
    """The scripts of each word's characters, one bit each."""
    out = np.zeros(len(words.start), np.uint64)
    lead = np.flatnonzero(data[:-1] >= 0xC0)
    word = np.searchsorted(words.start, lead, "right") - 1
    bits = SCRIPT_OF[data[lead].astype(np.int64) << 8 | data[lead + 1]]
    some = (word >= 0) & (bits != 0)
    word, bits = word[some], bits[some]
    if len(word):
        edge = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[edge]] = np.bitwise_or.reduceat(bits, edge)
    return out


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.logp = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).astype(np.float32)
        #: Mean log-probability of a byte of each language's training texts.
        self.usual = (counts * self.logp).sum(1) / np.maximum(total[:, 0], 1)
        #: From there down to a trigram never seen; it grows with the training texts.
        self.depth = self.usual - np.log(0.5 / (total[:, 0] + 0.5 * BUCKETS))
        share = scripts / np.maximum(scripts[:, -1:], 1)
        bits = (share[:, :N_SCRIPTS] >= SCRIPT_SHARE).astype(np.uint64)
        self.scripts = (bits << np.arange(N_SCRIPTS, dtype=np.uint64)).sum(1).astype(np.uint64)

    def barred(self, words: K.Words, data: np.ndarray) -> np.ndarray:
        """Languages by words: which ones the word's scripts rule out."""
        s = word_scripts(words, data)
        return np.stack([(s & ~m) != 0 for m in self.scripts])

    def word_scores(self, data: np.ndarray, words: K.Words, barred: np.ndarray) -> np.ndarray:
        """Languages by words; the ones that a word's scripts rule out lose BARRED, unless all are."""
        t = trigrams(data)
        out = np.empty((len(self.langs), len(words.start)), np.float64)
        for k, row in enumerate(self.logp):
            c = np.zeros(len(data) + 1)
            np.cumsum(row[t], out=c[1:], dtype=np.float64)
            out[k] = c[words.end] - c[words.start - 1] if len(words.start) else 0
        out[barred & ~barred.all(0)] += BARRED
        return out

    def fit_of(self, scores: np.ndarray, path: np.ndarray, data: np.ndarray, words: K.Words, barred: np.ndarray, n_docs: int) -> np.ndarray:
        """Mean log-probability per byte of each document along its path: 0 as in the languages' training texts, -1 as trigrams never seen.

        A word in a script that no language admits loses BARRED.  Words with digits
        (numbers, keys, addresses) may belong to no language: the better of
        the means with and without them counts.
        """
        if not len(path):
            return np.zeros(n_docs)
        size = (words.end - words.start + 1).astype(np.float64)
        own = scores[path, np.arange(len(path))] - self.usual[path] * size
        own[barred.all(0)] += BARRED
        own /= self.depth[path]
        plain = ~np.logical_or.reduceat((data >= 0x30) & (data <= 0x39), words.start)
        mean = lambda w: np.bincount(words.doc, weights=own * w, minlength=n_docs) / np.maximum(np.bincount(words.doc, weights=size * w, minlength=n_docs), 1)
        some = np.bincount(words.doc, weights=plain, minlength=n_docs) > 0
        return np.where(some, np.maximum(mean(plain), mean(1.0 + 0 * plain)), mean(1.0 + 0 * plain))


def viterbi(scores: np.ndarray, penalty: float, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best language per word of some documents, a word of each at a time; ties go to the earlier language.

    ``first`` and ``size`` give the documents' words among the columns of
    ``scores``.  Returns the languages of all of them, one document after the other.
    """
    order = np.argsort(-size, kind="stable")
    at, n = first[order], size[order]
    n_lang, own = len(scores), np.arange(len(scores))[:, None]
    begin = np.cumsum(n) - n  # place of each document's words in the tables below
    back = np.empty((int(n.sum()), n_lang), np.int32)
    v = scores[:, at].copy()
    active = [int(x) for x in np.searchsorted(-n, -np.arange(1, n[0]), "left")]  # documents with more than t words
    for t, k in enumerate(active, 1):
        now = v[:, :k]
        best = now.argmax(0)
        jump = now[best, np.arange(k)] - penalty
        stay = now >= jump
        back[begin[:k] + t] = np.where(stay, own, best).T
        v[:, :k] = np.where(stay, now, jump) + scores[:, at[:k] + t]
    path = np.empty(len(back), np.int32)
    path[begin + n - 1] = v.argmax(0)
    for t in range(len(active), 0, -1):
        p = begin[: active[t - 1]] + t
        path[p - 1] = back[p, path[p]]
    out = np.empty(len(first), object)
    for i, k in enumerate(order.tolist()):
        out[k] = path[begin[i] : begin[i] + n[i]]
    return np.concatenate(out)


def steady(scores: np.ndarray, best: np.ndarray, doc: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Documents in which no language gains half of ``penalty`` over the best one in any run of words."""
    n_docs = len(first) - 1
    out = np.ones(n_docs, bool)
    if not len(doc):
        return out
    own = scores[best[doc], np.arange(len(doc))]
    for row in scores:
        gain = np.cumsum(row - own)
        before = np.r_[0.0, gain[:-1]]
        # The running least of each document alone: documents are lifted apart, each below the one before.
        reach = np.abs(gain).max() + 1
        lift = -2.0 * reach * doc
        low = np.minimum.accumulate(before + lift) - lift
        most = np.maximum.reduceat(gain - low, np.minimum(first[:-1], len(doc) - 1))
        out &= (most < penalty / 2 - 1e-6) | (np.diff(first) == 0)
    return out


def _train_counts(data, offs, langs, order):
    text, at = padded(data, offs)
    t = trigrams(text)
    owner = np.repeat(langs, np.diff(at))
    owner[at[1:] - 1] = -1  # these begin behind the last word
    words = K.split_words(text, at)
    s = word_scripts(words, text)
    counts = np.zeros((len(order), BUCKETS), np.int64)
    scripts = np.zeros((len(order), N_SCRIPTS + 1), np.int64)
    lang_of_word = langs[words.doc]
    for k in range(len(order)):
        counts[k] = np.bincount(t[owner == k], minlength=BUCKETS)
        mine = s[lang_of_word == k]
        scripts[k, -1] = len(mine)
        for bit in range(N_SCRIPTS):
            scripts[k, bit] = int(((mine >> bit) & 1).sum())
    return counts, scripts


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model from labelled rows outside the held-out fold; None without any.

    Every row is counted by language; about ``train_rows`` of each language,
    chosen by a hash of doc_id, give the trigram counts.
    """
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(docs) & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    order = sorted(sizes)
    if not order:
        return None
    rate = F.create_map(*[F.lit(x) for k in order for x in (k, min(1.0, train_rows / sizes[k]))])
    chance = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(chance < F.element_at(rate, F.col("lang")))
    number = {k: i for i, k in enumerate(order)}

    @K.tidy
    def count(batches):
        counts = scripts = 0
        for batch in batches:
            data, offs = K.string_buffer(batch.column(1))
            langs = np.array([number[x] for x in batch.column(0).to_pylist()])
            for i, j in K.slices(offs):
                c, s = _train_counts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], langs[i:j], order)
                counts, scripts = counts + c, scripts + s
        if not isinstance(counts, int):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(order)), pa.int32()), pa.array([x.tobytes() for x in counts]), pa.array([x.tobytes() for x in scripts])], names=["k", "counts", "scripts"])

    def add(key, table):
        total = lambda name: sum(np.frombuffer(x.as_py(), np.int64) for x in table[name]).tobytes()
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total("counts")], pa.binary()), "scripts": pa.array([total("scripts")], pa.binary())})

    from .common import ship

    ship(docs.sparkSession)
    schema = "k int, counts binary, scripts binary"
    rows = sample.select("lang", "text").mapInArrow(count, schema).groupBy("k").applyInArrow(add, schema).collect()  # one row per language
    counts, scripts = np.zeros((len(order), BUCKETS), np.int64), np.zeros((len(order), N_SCRIPTS + 1), np.int64)
    for k, c, s in rows:
        counts[k], scripts[k] = np.frombuffer(c, np.int64), np.frombuffer(s, np.int64)
    return Model(order, counts, scripts)


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    low = K.LOWER[data]
    ascii_letter = np.r_[0, np.cumsum((low >= 0x61) & (low <= 0x7A))]
    out = (ascii_letter[offs[1:]] - ascii_letter[offs[:-1]]) > 0
    for i in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[i] = any(map(str.isalpha, data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def label_words(model: Model, data: np.ndarray, offs: np.ndarray, penalty: float = SWITCH) -> tuple[K.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the language of each, every language's total by document, and each document's fit."""
    text, at = padded(data, offs)
    words = K.split_words(text, at)
    words.data = text
    barred = model.barred(words, text)
    scores = model.word_scores(text, words, barred)
    doc = words.doc
    total = np.stack([np.bincount(doc, weights=row, minlength=len(at) - 1) for row in scores])
    best = total.argmax(0)
    path = best[doc]
    hard = np.flatnonzero(~steady(scores, best, doc, words.first, penalty))
    if len(hard):
        first, size = words.first[hard], np.diff(words.first)[hard]
        path[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())] = viterbi(scores, penalty, first, size)
    return words, path, total, model.fit_of(scores, path, text, words, barred, len(at) - 1)


def identify(docs: DataFrame, model: Model | None, keep: list[str] = ["doc_id"], into: str = "language", penalty: float = SWITCH) -> DataFrame:
    """Adds the column ``into``: struct of label, score (0 to 1), spans (lang, first and end
    word) and fit (log-probability per byte: 0 as the training texts, -1 as unseen), beside the
    columns of ``keep``.

    The label is the language of most bytes; ``und`` with score 0 for null
    texts, texts without a letter, and without a model.  Empty tables give no
    rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(data, offs, nulls):
            n = len(nulls)
            letters = has_letter(data, offs)
            if model is None:
                names, score, fits, spans = [UNKNOWN] * n, np.zeros(n), np.zeros(n), [[] for _ in range(n)]
            else:
                words, path, total, fits = label_words(model, data, offs, penalty)
                doc, length = words.doc, (words.end - words.start).astype(np.float64)
                weight = np.stack([np.bincount(doc[path == k], weights=length[path == k], minlength=n) for k in range(len(model.langs))])
                label = weight.argmax(0)
                share = weight.max(0) / np.maximum(weight.sum(0), 1)
                ranked = np.sort(total, 0)
                gap = ranked[-1] - ranked[-2] if len(ranked) > 1 else np.full(n, 50.0)
                score = share / (1 + np.exp(-np.minimum(gap / np.sqrt(np.maximum(np.diff(words.first), 1)), 50)))
                names = np.array(model.langs, object)[label]
                names[~letters] = UNKNOWN
                score[~letters] = 0
                edge = np.ones(len(path), bool)
                edge[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
                s = np.flatnonzero(edge)
                e = np.r_[s[1:], len(path)].astype(np.int64)
                base = words.first[doc[s]] if len(s) else s
                per = np.bincount(doc[s], minlength=n) if len(s) else np.zeros(n, int)
                one = pa.StructArray.from_arrays([pa.array(np.array(model.langs, object)[path[s]] if len(s) else [], pa.string()), pa.array((s - base).astype(np.int32)), pa.array((e - base).astype(np.int32))], names=["lang", "start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), one)
            if isinstance(spans, list):
                spans = pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            return [pa.StructArray.from_arrays([pa.array(list(names), pa.string()), pa.array(np.asarray(score, np.float64)), spans, pa.array(fits)], names=["label", "score", "spans", "fit"])]

        return work

    return map_text(docs, keep, f"`{into}` struct<label:string,score:double,spans:array<struct<lang:string,start:int,end:int>>,fit:double>", make, 1 << 20)
