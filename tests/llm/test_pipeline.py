import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from lumengrid.llm import langid, queries
from tests.llm.test_operators import ROWS, SCHEMA, brute_components, words


@pytest.fixture(scope="module")
def docs(spark):
    """Edge rows beside real documents, with clashing and dotted column names."""
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "source", "n_chars", F.lit("h").alias("hits"), F.lit("l").alias("language"), F.lit(1).alias("a.b"), F.lit(2).alias("_passes"))
    return spark.createDataFrame(ROWS, SCHEMA).unionByName(real).cache()


SF = "/root/testdata/sf0.001"


def trigram(b):
    """Bucket of three bytes: letters lowered, white space as one sort."""
    n = 0
    for k, c in enumerate(b):
        n |= (32 if c in b"\t\n\v\f\r " else c + 32 if 65 <= c <= 90 else c) << 8 * k
    return (n * 0x9E3779B1 & 0xFFFFFFFF) >> 17


def scripts(text):
    return {k for k, ranges in enumerate(langid.SCRIPT_RANGES) for c in text for lo, hi in ranges if lo <= ord(c) <= hi}


_models = {}


def plain_model(rows):
    """Counts of the training rows by language, in plain Python: (log-probabilities, usual, depth, scripts)."""
    if id(rows) not in _models:
        train = [r for r in rows if r.lang and r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
        model = {}
        for lang in sorted({r.lang for r in train}):
            counts, seen, words = {}, {}, 0
            for text in (r.text for r in train if r.lang == lang):
                b = b" " + text.encode() + b"  "
                for k in range(len(text.encode()) + 1):
                    g = trigram(b[k : k + 3])
                    counts[g] = counts.get(g, 0) + 1
                for w in re.findall(r"[^\x20\x09-\x0D]+", text):
                    words += 1
                    for x in scripts(w):
                        seen[x] = seen.get(x, 0) + 1
            total = sum(counts.values())
            logp = lambda g, c=counts, t=total: np.log((c.get(g, 0) + 0.5) / (t + 0.5 * langid.BUCKETS))
            usual = sum(c * logp(g) for g, c in counts.items()) / total
            model[lang] = logp, usual, usual - np.log(0.5 / (total + 0.5 * langid.BUCKETS)), {x for x, c in seen.items() if c / words >= langid.SCRIPT_SHARE}
        _models[id(rows)] = rows, model
    return _models[id(rows)][1]


def fits(model, text):
    """The stage's decision for one text, by a plain Viterbi; close calls are left to the stage's own rounding."""
    if not text or not any(map(str.isalpha, text)):
        return False
    langs, words = sorted(model), re.findall(r"[^\x20\x09-\x0D]+", text)
    scores, outside, b = [], [], b" " + text.encode() + b"  "
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", b):
        s, own = [], scripts(m[0].decode())
        barred = [bool(own - model[g][3]) for g in langs]
        for g, out in zip(langs, barred):
            s.append(sum(model[g][0](trigram(b[k : k + 3])) for k in range(m.start() - 1, m.end())) + (langid.BARRED if out and not all(barred) else 0))
        scores.append(s)
        outside.append(all(barred))
    v, back = list(scores[0]), []
    for s in scores[1:]:
        best = max(range(len(v)), key=lambda k: v[k])
        back.append([k if v[k] >= v[best] - langid.SWITCH else best for k in range(len(v))])
        v = [max(v[k], v[best] - langid.SWITCH) + s[k] for k in range(len(v))]
    path = [max(range(len(v)), key=lambda k: v[k])]
    for b in reversed(back):
        path.append(b[path[-1]])
    parts = []
    for w, s, out, k in zip(words, scores, outside, path[::-1]):
        _, usual, depth, _ = model[langs[k]]
        n = len(w.encode()) + 1
        parts.append(((s[k] - usual * n + (langid.BARRED if out else 0)) / depth, n, not re.search("[0-9]", w)))
    mean = lambda ps: sum(x for x, _, _ in ps) / sum(n for _, n, _ in ps)
    plain = [p for p in parts if p[2]]
    return max([mean(parts)] + ([mean(plain)] if plain else [])) >= P.LEAST_FIT


def own_key(r):
    return r.doc_id if r.doc_id is not None else ("source", r.source)


def plain_passes(rows):
    """Passes by doc_id, or by source without one, from the targets and the seeded order."""
    size = lambda r: len(words(r.text))
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sources)}
    whole = {s: sum(size(r) for r in rows if r.source == s) for s in sources}
    target, free, left = {}, set(sources), 1.5 * sum(whole.values())
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if 2 * whole[s] <= level * weight[s]}
        if not full:
            break
        for s in full:
            target[s], left = 2.0 * whole[s], left - 2 * whole[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    group = {}
    for s in sources:
        order = lambda r: (hashlib.md5(":".join(["mix"] + ([str(r.doc_id)] if r.doc_id is not None else [])).encode()).hexdigest(), r.doc_id is not None, r.doc_id or 0, size(r))
        at, due = 0, int(target[s])
        for r in sorted((r for r in rows if r.source == s), key=order):
            n = size(r)
            taken = sum(min(max(due - p * whole[s] - at, 0), n) for p in (0, 1))
            a, b = group.get(own_key(r), (0, 0))
            group[own_key(r)] = a + taken, b + n
            at += n
    return {k: int(a / b + 0.5) if b else 1 for k, (a, b) in group.items()}


def test_stages_keep_columns_and_take_effect(spark, docs):
    now = docs
    for name, stage in P.STAGES[:-1]:
        out = P.stage(stage(spark, now, SF), "t")
        assert out.columns == docs.columns
        before, after = now.collect(), out.collect()
        if name == "language_id":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert {0, 1, 2} <= gone and all(i is None or i < 1000 for i in gone)
            assert sorted(map(str, after)) == sorted(str(r) for r in before if fits(plain_model(before), r.text))
        elif name == "ngram_jaccard_join":
            rows = [(r.doc_id, r.text) for r in before]
            want = {i for i, _, c in brute_components(rows, 5, 80) if i is not None and i == c}
            got = [r.doc_id for r in after if r.doc_id is not None]
            assert sorted(got) == sorted(want)
        elif name == "benchmark_decontamination":
            pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
            grams = set()
            for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
                w = words(r.text, True, pattern)
                grams |= {tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1) if w}
            bad = {r.doc_id for r in before if any(tuple(words(r.text, True, pattern)[k : k + 10]) in grams for k in range(len(words(r.text, True, pattern))))}
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == bad
        else:
            want = plain_passes(before)
            assert max(want.values()) == 2 and len(after) > len(before)
            assert sorted(map(str, after)) == sorted(str(r) for r in before for _ in range(want[own_key(r)]))
        now = out
    last = P.STAGES[-1][1](spark, now, SF)
    rows = sorted(last.collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
    t = Tokenizer.from_file(queries.tokenizer_path())
    ids = lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]
    want = [(r.doc_id, len(i), zlib.crc32(np.asarray(i, "<u4").tobytes())) for r in now.collect() for i in [ids(r.text)]]
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in rows) == sorted(map(str, want))
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))


def test_language_stage_rejects_by_fit(spark):
    """Languages never learned go; a mixture of three learned ones stays."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    texts = {g: next(t for t, h in real.select("text", "lang").collect() if h == g and len(t.split()) > 80 and not re.search(r"\d|!!", t)) for g in ("de", "en", "es")}
    rows = [
        (-1, "Вчера вечером мы гуляли по старому городу и смотрели на реку", None),
        (-2, "昨天 晚上 我们 在 老城 散步 看 河水", None),
        (-3, "Wczoraj wieczorem spacerowaliśmy po starym mieście i patrzyliśmy na rzekę, która płynęła spokojnie", None),
        (-4, "Eilen illalla kävelimme vanhassa kaupungissa ja katselimme jokea joka virtasi rauhallisesti", None),
        (-6, "Ieri sera abbiamo passeggiato nella città vecchia e guardato il fiume che scorreva", None),
        (-7, "Tegnap este sétáltunk az óvárosban, és néztük a csendesen folyó vizet", None),
        (-5, " ".join(w for g, n in (("de", 40), ("en", 33), ("es", 33)) for w in texts[g].split()[:n]), None),
    ]
    got = {r.doc_id for r in P.language(spark, real.unionByName(spark.createDataFrame(rows, real.schema)), SF).select("doc_id").collect()}
    assert {i for i in got if i < 0} == {-5}
    assert len(got) - 1 > 0.99 * real.count()


def test_stages_of_nothing(spark, docs):
    now = docs.limit(0)
    for _, stage in P.STAGES:
        now = P.stage(stage(spark, now, SF), "t")
        assert now.count() == 0


def test_queries_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert set(e.oracle_sql()) <= names
