"""Cases that a weak hash, a filter without effect, or one big task would get wrong."""

import hashlib
import math
import random
import html
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumengrid.llm import common, decontamination, dedup, htmltext, langid, mixing, ngram_join, pseudonyms, queries, secrets, spans, substring, tokens
from lumengrid.llm import textkernel as K
from tests.llm.test_operators import brute_components, brute_repeats, words


def parity(n, swap, a="a", b="b", sep=""):
    """Letters by the parity of ones in their place: two of these agree in every linear hash modulo 2**64."""
    return sep.join((a, b)[(bin(i).count("1") + swap) % 2] for i in range(n))


LENGTHS = (64, 1024, 2048, 4096)


def test_parity_strings_have_hashes_of_their_own():
    for n in LENGTHS:
        w = K.split_words(*K.string_buffer(pa.array([parity(n, 0), parity(n, 1)])))
        assert w.hash[0] != w.hash[1]
        w = K.split_words(*K.string_buffer(pa.array([parity(n, 0, sep=" "), parity(n, 1, sep=" ")])))
        assert K.sequence_hash(w)[0] != K.sequence_hash(w)[1] and substring._second(w)[0] != substring._second(w)[1]


def parity_rows():
    rows, k = [], 0
    for n in (64, 1024):
        for swap in (0, 1):
            rows.append((k, parity(n, swap) + " tail"))
            rows.append((k + 1, "head " + parity(n, swap, "aa", "bb", " ")))
            rows.append((k + 2, " ".join(["same"] * 6 + [parity(n, swap)] + ["end"] * 7)))
            k += 10
    return rows


def test_parity_texts_in_joins(spark):
    rows = parity_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join(docs, 4, 85, counters=1 << 12).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(str, brute_components(rows, 4, 85)))
    got = substring.remove_repeats(docs, 13).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == brute_repeats(rows, 13)
    bench = spark.createDataFrame([(1, rows[2][1]), (2, parity(64, 1))], "item_id long, text string")
    for block in (1_000_000, 1):
        hit = {r.doc_id: r.hits["items"] for r in decontamination.decontaminate(docs, bench, block_words=block).collect()}
        assert {i: x for i, x in hit.items() if x} == {2: ["1"], 10: ["2"], 12: ["2"]}


@pytest.mark.parametrize("clash", [False, True])
def test_tokens_equal_the_library(monkeypatch, clash):
    """Also where every piece has the same hash."""
    from tokenizers import Tokenizer

    if clash:
        monkeypatch.setattr(K, "byte_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    texts = [x for n in LENGTHS for x in (parity(n, 0), parity(n, 1), "<|endoftext|> a " + parity(n, 1))] + ["<|endoftext|> a", "a<|endoftext|>", "", " plain text", "<|endoftext|>", "a  b  c d e"]
    t = Tokenizer.from_file(queries.tokenizer_path())
    encoder = tokens.PieceEncoder(queries.tokenizer_path())
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for _ in range(2):
        ids, sizes = encoder.encode(*K.string_buffer(pa.array(texts)))
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_token_files_of_one_doc_id(spark):
    """Rows of one doc_id are dealt over partitions, and the file order is still one sequence."""
    rows = [(7, f"text number {k % 9}") for k in range(500)] + [(1, "first"), (9, "last"), (None, "none")]
    folder = tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path())
    assert spark.read.parquet(f"{folder}/manifest").where("docs > 0").count() > 1
    got = sorted(tokens.read_tokens(spark, folder, block=3).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, *[7] * 500, 9] and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_filters_decide_the_duplicates(spark, monkeypatch):
    rows = [(k, f"text {k % 10}") for k in range(40)] + [(None, "null only"), (None, "null only")]
    batches = lambda: [spark.createDataFrame(rows[:20] + rows[40:41], "doc_id long, text string"), spark.createDataFrame(rows[20:40] + rows[41:], "doc_id long, text string")]
    run = lambda: sorted((str((r.doc_id, r.keep_id, r.group_size)) for r in dedup.exact_dedup(batches()).collect()))
    want = sorted(str((i, None if i is None else i % 10, 2 if i is None else 4)) for i, _ in rows)
    assert run() == want
    monkeypatch.setattr(dedup, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(dedup, "SHARD_KEYS", 3)
    assert run() == want
    monkeypatch.setattr(dedup.Snapshot, "screen", lambda self, batch, size: self.sharded(batch).limit(0))
    assert run() != want


def test_joins_deal_hot_keys_out(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    rows = [(1 if k % 3 else k, k) for k in range(3000)] + [(None, k) for k in range(900)]
    left = spark.createDataFrame(rows, "key long, x long")
    right = spark.createDataFrame([(k, "v%d" % k, 2001 if k == 1 else 1) for k in range(0, 3000, 2)] + [(1, "v1", 2001)], "key long, v string, n long")
    got = common.attach(left, right, "key", "n").collect()
    have = {r.key: r.v for r in right.collect()}
    assert sorted(str((r.key, r.x, r.v)) for r in got) == sorted(str((k, x, have.get(k))) for k, x in rows)
    right = right.select("key", "v")
    for how in ("inner", "left"):
        got = common.spread_join(left, right, ["key"], ["x"], per_part=50, how=how)
        plain = left.join(right, "key", how).select(*got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert sum("_part" in str(f) for f in [got._jdf.queryExecution().toString()]) == 1


def test_clashing_classes_split():
    cls, check = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 7], np.uint64)
    out = ngram_join.split_clashes(cls, check, {5: 1})
    assert out[0] == out[2] == 5 and out[3] == 9 and out[1] != 5


def test_mixing_of_repeated_rows(spark):
    """Null and repeated doc_ids in one bucket, each pass with a position of its own."""
    rows = [(None if k % 3 else k, "w " * (k % 7), "a" if k % 2 else "b") for k in range(400)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    order = mixing.passes_in_order(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and len(order) == sum(map(len, out.positions))
    assert len(out) == 400 and (out.groupby("source").taken.sum() == np.floor(out.groupby("source").target.first())).all()
    assert all(len(p) == (t > 0) + (t > s) for p, t, s in zip(out.positions, out.taken, out["size"]))
    for _, g in out.groupby("source"):
        full = g[g.taken > 0]
        spread = np.concatenate(full.positions.tolist())
        assert spread.min() == 0 and spread.max() > 0.9 and spread.max() <= 1
        assert all(a < b for p in full.positions if len(p) > 1 for a, b in zip(p, p[1:]))


def battery(s):
    """The three tests in plain Python: p-value of a run, None without an encoding."""
    lower, upper, digit = (re.search(x, s) for x in ("[a-z]", "[A-Z]", "[0-9]"))
    if not digit:
        return None
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) and (lower or upper):
        alphabet, s = secrets.HEX_SYMBOLS, s.lower()
    elif re.fullmatch("[A-Z2-7]+", s) and upper:
        alphabet = secrets.B32_SYMBOLS
    elif lower and upper:
        alphabet = secrets.B64_SYMBOLS
    else:
        return None
    x = [alphabet.index(c) for c in s.replace("-", "+").replace("_", "/")]
    n, a = len(x), len(alphabet)
    two = lambda z: math.erfc(abs(z) / math.sqrt(2))
    chi = sum(x.count(k) ** 2 for k in set(x)) * a / n - n
    h = 2 / (9 * (a - 1))
    z = ((max(chi, 1e-9) / (a - 1)) ** (1 / 3) - (1 - h)) / math.sqrt(h)
    p_chi = two(z) / 2 if z > 0 else 1 - two(z) / 2
    high = [k >= a / 2 for k in x]
    runs, n1 = 1 + sum(u != v for u, v in zip(high, high[1:])), sum(high)
    mean = 2 * n1 * (n - n1) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = two((runs - mean) / math.sqrt(var)) if var > 0 else 0
    c = (a - 1) / 2
    power = sum((k - c) ** 2 for k in x)
    p_serial = two(sum((u - c) * (v - c) for u, v in zip(x, x[1:])) / power * math.sqrt(n)) if power else 0
    return min(1, 3 * min(p_chi, p_runs, p_serial))


def test_random_spans_by_brute_force(spark):
    rng = random.Random(3)
    alphabets = ["0123456789abcdef", secrets.B32_SYMBOLS, secrets.B64_SYMBOLS.replace("/", "_").replace("+", "-"), "abcXYZ019", "aB3" * 2]
    texts = [" ".join(["so"] + ["".join(rng.choice(rng.choice(alphabets[:4]) if k % 5 == 4 else alphabets[k % 5]) for _ in range(rng.choice((23, 24, 31, 40, 70, 130)))) for _ in range(rng.randrange(4))] + ["token=" + "Q7" * 12]) for k in range(250)]
    texts += ["key=" + "ab " * 400 + "secret: abcdefgh1 " * 300]
    found = {r.doc_id: r.found for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    candidates, bins = {}, {}
    for i, t in enumerate(texts):
        base = [(s.start, s.end) for s in found[i] if s.kind != "random"]
        for m in re.finditer("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", t):
            p = battery(m[0])
            if p is not None and not any(a < m.end() and b > m.start() for a, b in base):
                group = sum(m.end() - m.start() >= x for x in secrets.LENGTHS)
                candidates[i, m.start(), m.end()] = group, p
                bins.setdefault(group, [0] * secrets.BINS)[min(int(p * secrets.BINS), secrets.BINS - 1)] += 1
    least = {}
    for g, n in bins.items():
        secret = 2 * sum(n[secrets.BINS // 2 :])
        fits = [k for k in range(secrets.BINS) if n[k] and (sum(n[k:]) - (1 - k / secrets.BINS) * secret) / sum(n[k:]) <= secrets.RATE]
        least[g] = min(fits) / secrets.BINS if fits else 2
    edge = lambda p, g: abs(p * secrets.BINS - round(p * secrets.BINS)) < 1e-4  # noqa: E731  either side by rounding
    want = {k for k, (g, p) in candidates.items() if p >= least[g] and not edge(p, g)}
    got = {(i, s.start, s.end) for i, f in found.items() for s in f if s.kind == "random"}
    assert want <= got and all(edge(*candidates[k][::-1]) for k in got - want) and len(want) > 40


def test_many_matches_have_right_positions(spark):
    text = "x1 yy22 " * 1000
    row = spark.createDataFrame([(text,)], "t string").select(spans.find_spans(F.col("t"), "[0-9]+").alias("s")).first().s
    assert [(s.start, s.end, s.text) for s in row] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]
    one = lambda xs: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in xs])
    rng = random.Random(1)
    others = sorted((a, a + rng.randrange(1, 9)) for a in rng.sample(range(5000), 400))
    some = [(a, a + 3) for a in rng.sample(range(5000), 60)]
    got = spark.range(1).select(spans.clear_of(one(some), one(others)).alias("s")).first().s
    assert [tuple(s) for s in got] == [s for s in some if not any(s[0] < e and b < s[1] for b, e in others)]


def best_path(scores, penalty):
    v, back = scores[:, 0].copy(), []
    for t in range(1, scores.shape[1]):
        m = np.array([[v[a] - penalty * (a != b) for a in range(len(v))] for b in range(len(v))])
        back.append(m.argmax(1))
        v = m.max(1) + scores[:, t]
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi_by_brute_force():
    rng = np.random.default_rng(0)
    value = lambda s, p: sum(s[k, t] for t, k in enumerate(p)) - 8 * sum(a != b for a, b in zip(p, p[1:]))
    for _ in range(100):
        sizes = rng.integers(1, 30, rng.integers(1, 8))
        scores, first = rng.normal(0, 4, (4, sizes.sum())), np.cumsum(sizes) - sizes
        got, total = langid.viterbi(scores, 8.0, first, sizes), [scores[:, a : a + n].sum(1) for a, n in zip(first, sizes)]
        best = np.array([t.argmax() for t in total])
        sure = langid.steady(scores, best, np.repeat(np.arange(len(sizes)), sizes), np.r_[first, sizes.sum()], 8.0)
        for i, (a, n) in enumerate(zip(first, sizes)):
            want = best_path(scores[:, a : a + n], 8.0)
            assert abs(value(scores[:, a : a + n], got[a : a + n]) - value(scores[:, a : a + n], want)) < 1e-9
            assert not sure[i] or set(want) == {best[i]}


def test_two_gains_in_a_row_are_decoded():
    """One change pays for two runs in other languages, each below the penalty."""
    scores = np.array([[0.0, 0.0], [15.0, -40.0], [-40.0, 15.0]])
    assert not langid.steady(scores, np.array([0]), np.zeros(2, int), np.array([0, 2]), 20.0)[0]
    assert langid.viterbi(scores, 20.0, np.array([0]), np.array([2])).tolist() == [1, 2]


def test_scripts_by_code_point():
    text = "mañana Привет தமிழ் हिन्दी ไทย 漢字 かな plain ქართული አማርኛ 𠀀 😀"
    w = K.split_words(*langid.padded(*K.string_buffer(pa.array([text]))))
    bits = langid.word_scripts(w, w.data).tolist()
    assert len({b for b in bits if b}) == 9 and bits[7] == bits[11] == 0 and bits[5] == bits[10]


def test_language_labels_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    got = {r.doc_id: r.language for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        own = b" " + (r.text or "").encode() + b" "
        parts = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", own)]
        if not parts or len(parts) > 400:
            continue
        t = langid.trigrams(np.frombuffer(own, np.uint8))
        scores = np.array([[row[t[a - 1 : b]].astype(float).sum() for a, b in parts] for row in model.logp])
        w = K.split_words(np.frombuffer(own, np.uint8), np.array([0, len(own)]))
        barred = model.barred(w, w.data)
        scores[barred & ~barred.all(0)] += langid.BARRED
        path = best_path(scores, langid.SWITCH)
        weight = [sum(b - a for (a, b), k in zip(parts, path) if k == g) for g in range(len(model.langs))]
        if any(map(str.isalpha, r.text)) and sorted(weight)[-2] != max(weight):
            assert got[r.doc_id].label == model.langs[int(np.argmax(weight))]


# Pages ------------------------------------------------------------------------------


def site(n, shared="Subscribe now and never miss a story from us", name="story"):
    rng = random.Random(4)
    say = lambda k: " ".join(rng.choice("river stone light green apple walk early house train".split()) + str(rng.randrange(99)) for _ in range(k))
    rows = []
    for k in range(n):
        body = f"<div class=lead>{say(5)}</div><div class='{name}'><div>{say(30)}</div><div>{shared}</div><div>{say(40)}</div></div><div class=more>{say(6)}</div>"
        rows.append((k, f"https://site.example/{k}", f"<html><body><div class=top>Welcome to the site of the town, open daily from nine</div>{body}<div class=low>Imprint and terms of the town</div></body></html>"))
    return rows


def test_votes_decide_what_is_content(spark):
    """No element here is called anything: only the alignment finds the region and its constant slot."""
    pages = spark.createDataFrame(site(8), "page_id long, url string, html string")
    rows = htmltext.laid_out(pages)
    wrappers = htmltext.induce(rows)
    assert wrappers.count() == 1
    one = wrappers.first()
    assert htmltext.Tree(one.pivot).nodes[one.region].label == "div.story" and len(one.template) == 1
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    for k, _, source in site(8):
        inner = re.search("<div class='story'>(.*?)</div></div>", source)[1]
        assert got[k] == " ".join(x for x in re.findall("<div>(.*?)(?:</div>|$)", inner) if not x.startswith("Subscribe"))
    without = {r.page_id: r.text for r in htmltext.extract(pages, wrappers.limit(0)).collect()}
    assert all(without[k] != got[k] and "Subscribe" in without[k] and "Welcome" in without[k] for k in got)


def test_layouts_and_copies_apart(spark):
    """Two layouts of one host have wrappers of their own, and copies of a page make none."""
    other = [(100 + k, u.replace("site", "SITE"), h.replace("class=top", "class=bar").replace("'story'", "'entry'")) for k, u, h in site(6)]
    copies = [(200 + k, f"http://copy.example/{k}", site(1)[0][2]) for k in range(5)]
    pages = spark.createDataFrame(site(8) + other + copies, "page_id long, url string, html string")
    found = {r.layout: htmltext.Tree(r.pivot).nodes[r.region].label for r in htmltext.induce(htmltext.laid_out(pages)).collect()}
    assert sorted(found.values()) == ["div.entry", "div.story"]
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    assert "Subscribe" not in got[3] + got[103] and "Subscribe" in got[202]


def test_large_hosts_are_dealt_out(spark, monkeypatch):
    pages = spark.createDataFrame(site(30), "page_id long, url string, html string")
    want = sorted(map(str, htmltext.extract(pages).collect()))
    monkeypatch.setattr(htmltext, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "PART_ROWS", 4)
    monkeypatch.setattr(common.spread_join, "__defaults__", (None, 4, "inner"))
    assert sorted(map(str, htmltext.extract(pages).collect())) == want


def test_names_break_ties_only():
    page = "<article><h1>Head</h1><p class='share price'>The share price fell</p><div class=comments><p>Reader says</p></div><p>Last</p></article><aside/><p>beside"
    assert htmltext.main_text(htmltext.Tree(page)) == "Head The share price fell Last"


@pytest.mark.parametrize("page", ["<div>" * 5000 + "x" + "</div>" * 5000, "<b>" * 5000 + "x", "x" + "<a " * 350_000, "x<a \"y>" * 150_000, "x" + "<!" * 500_000, "x<script></script " * 60_000, "<ul>x" + "<li>a" * 30_000, "<p>x</b></i>" * 30_000])
def test_hard_pages_take_little_time(page):
    began = time.perf_counter()
    a = htmltext.Tree(page)
    a.layout()
    htmltext.votes_of(a, htmltext.Tree(page + "<p>more"))
    assert "x" in htmltext.main_text(a) and time.perf_counter() - began < 5


def test_pages_with_clashing_columns(spark):
    schema = "page_id long, url string, html string, host string, layout string, pivot int, text string, n_chars int"
    rows = [(k, u, h, "h", "l", 1, "t", 2) for k, u, h in site(4)] + [(None, None, None, None, None, None, None, None), (0, "https://site.example/0", site(1)[0][2], "h", "l", 1, "t", 2)]
    pages = spark.createDataFrame(rows, schema)
    out = htmltext.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == 6
    assert out.where("page_id = 0").select("text").distinct().count() == 1 and out.where("page_id is null").first().text == ""


# Pseudonyms -------------------------------------------------------------------------


def plain_feistel(left, right, a, b, key, tweak):
    for r in range(8):
        half, modulus = (right, a) if r % 2 == 0 else (left, b)
        noise = int(hashlib.sha256(f"{key}:{tweak}:{r}:{half}".encode()).hexdigest()[:15], 16)
        if r % 2 == 0:
            left = (left + noise) % modulus
        else:
            right = (right + noise) % modulus
    return left, right


def test_feistel_by_plain_python(spark):
    rng = random.Random(0)
    import datetime as d

    ssn = [(rng.choice([x for x in range(1, 900) if x != 666]), rng.randrange(1, 100), rng.randrange(1, 10000)) for _ in range(200)] + [(1, 1, 1), (665, 99, 9999), (667, 1, 1), (899, 99, 9999)]
    want = {}
    for area, group, serial in ssn:
        l, r = plain_feistel(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "key", "ssn")
        want["%03d-%02d-%04d" % (area, group, serial)] = "%03d-%02d-%04d" % (l + (2 if l >= 665 else 1), r // 9999 + 1, r % 9999 + 1)
    for octets in [(97, 51, 17, 173), (0, 0, 0, 0), (255, 255, 255, 255)]:
        l, r = plain_feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, "key", "ipv4")
        want[".".join(map(str, octets))] = f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"
    for iso in ("1900-01-01", "1987-02-28", "2099-12-31"):
        n = (d.date.fromisoformat(iso) - d.date(1900, 1, 1)).days
        l, r = plain_feistel(n // 17, n % 17, 4297, 17, "key", "date")
        day = d.date(1900, 1, 1) + d.timedelta(l * 17 + r)
        for form in ("%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y"):
            want[d.date.fromisoformat(iso).strftime(form)] = day.strftime(form)
    luhn = lambda s: sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(s)))) % 10
    card = "4111111111111111"
    l, r = plain_feistel(int(card[:7]), int(card[7:15]), 10**7, 10**8, "key", "number:0")
    body = "%07d%08d" % (l, r)
    want[card] = next(body + c for c in "0123456789" if luhn(body + c) == 0)
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", pseudonyms.pseudonymise(F.col("t"), "key").alias("p")).collect()
    assert {r.t: r.p for r in got} == want


YES = ["4111 1111 1111 1111", "378282246310005", "3782 822463 10005", "account no. 12345678", "Konto: 9807915762804490", "+1 (017) 555-7713", "(555) 123-4567", "555-123-4567", "+15551234567", "+49 30 1234567", "+44 20 7946 0958", "020 7946 0958", "12/31/1990", "31.12.1990", "123-45-6789", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "1 555 123 4567"]
NO = ["9807915762804490", "ts=1700000000000", "9780306406157", "1999-02-30", "12/32/1990", "GB83WEST12345698765432", "985-90-4924", "666-12-1234", "+12 34"]


def test_formats_and_what_is_none(spark):
    rows = [(i, f"a {t} b {t}, c") for i, t in enumerate(YES)] + [(100 + i, f"x {t} y") for i, t in enumerate(NO)]
    out = pseudonyms.replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), "k").cache()
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(YES):
        m = re.fullmatch("a (.*) b (.*), c", got[i].text)
        assert m[1] == m[2] != t and got[i].n_found == 2 and re.sub(r"\d", "9", m[1]) == re.sub(r"\d", "9", t)
    assert all(got[100 + i].text == f"x {t} y" and got[100 + i].n_found == 0 for i, t in enumerate(NO))
    back = out.select("doc_id", pseudonyms.pseudonymise(F.col("text"), "k", back=True).alias("b")).collect()
    assert {r.doc_id: r.b for r in back} == dict(rows)


def test_security_numbers_are_permuted_among_valid_ones(spark):
    areas = [x for x in range(1, 900) if x != 666]
    df = spark.range(100_000).select(F.format_string("%03d-%02d-%04d", F.get(F.array(*[F.lit(x) for x in areas]), (F.col("id") % 898).cast("int")), F.col("id") % 99 + 1, F.col("id") * 7919 % 9999 + 1).alias("s"))
    out = df.withColumn("p", pseudonyms.pseudonymise(F.col("s"), "k")).withColumn("b", pseudonyms.pseudonymise(F.col("p"), "k", back=True))
    row = out.agg(F.sum((F.col("s") != F.col("b")).cast("int")), F.sum((~F.col("p").rlike(f"^(?:{pseudonyms.SSN})$")).cast("int")), F.countDistinct("s"), F.countDistinct("p")).first()
    assert row[0] == row[1] == 0 and row[2] == row[3]


def test_key_comes_from_the_session(spark):
    with pytest.warns(UserWarning):
        assert queries.pseudonym_key(spark) == "test"
    spark.conf.set(queries.PSEUDONYM_SETTING, "secret")
    try:
        assert queries.pseudonym_key(spark) == "secret"
    finally:
        spark.conf.unset(queries.PSEUDONYM_SETTING)


def test_crc_of_token_ids_is_of_four_bytes(spark):
    folder = tokens.write_tokens(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), queries.tokenizer_path())
    row = tokens.read_tokens(spark, folder).first()
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(queries.tokenizer_path()).encode("one two", add_special_tokens=False).ids + [2]
    assert row.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes()) and len(words("one two")) == 2


def test_many_items_with_one_prompt_are_one_window():
    """Work follows the text's windows, not the items that share them."""
    rng = random.Random(4)
    prompt = " ".join(f"prompt{k}" for k in range(13))
    items = [f"{prompt} {' '.join('w%d' % rng.randrange(5000) for _ in range(8))}" for _ in range(3000)]
    index = decontamination.Index([str(k) for k in range(3000)], items, 10, 5)
    text = " ".join([prompt] * 400)
    w = K.split_words(*K.string_buffer(pa.array([text])), K.ALNUM, lower=True)
    start, length, lists = decontamination.hits(w, index, 10, 5)
    assert len(start) == 400 * 4 and len(set(start.tolist())) == len(start) and len(set(lists.tolist())) == 1
    assert len(index.items(np.unique(lists))) == 3000


def test_items_that_share_some_windows(spark):
    rng = random.Random(6)
    prompt = [f"p{k}" for k in range(13)]
    items = [(k, " ".join(prompt[: 10 + k % 4] + ["w%d" % rng.randrange(300) for _ in range(k % 7)])) for k in range(60)] + [(60, "short one"), (61, "short one"), (62, None)]
    docs = [(1, " ".join(["x", *prompt, "y"])), (2, " ".join(prompt[:11])), (3, "a short one here"), (4, " ".join(prompt[:9])), (5, None)] + [(10 + k, f"a {t} b") for k, (_, t) in enumerate(items[:20])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.hits.n_hit, list(r.hits["items"])) for r in decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    for doc, text in docs:
        w = words(text, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        hit, found = set(), set()
        for item, other in items:
            o = words(other, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
            n = min(10, len(o))
            own = {tuple(o[k : k + n]) for k in range(len(o) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in own:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        assert got[doc] == (len(hit), sorted(found)), doc


def test_classes_split_until_none_is_shared(spark, monkeypatch):
    """Four sets of one class need three rounds; every round's classes stay known."""
    cls, check = np.array([5, 5, 5, 5], np.uint64), np.array([1, 2, 3, 4], np.uint64)
    clashes, rounds = {}, 0
    while True:
        out = ngram_join.split_clashes(cls, check, clashes)
        found = {}
        for c in np.unique(out):
            some = check[out == c]
            if len(some) > 1:
                found[int(c.view(np.int64))] = int(some.min())
        if not found:
            break
        clashes |= found
        rounds += 1
    assert len(np.unique(out)) == 4 and rounds >= 1 and out[0] == 5


def test_a_long_run_of_digits_in_an_address(spark):
    digits = "".join(str(k * 7 % 10) for k in range(100))
    texts = [f"write to a{digits}b@example.com now", "a@example.com", "a1@example.com"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = [r[0] for r in df.select(pseudonyms.pseudonymise(F.col("text"), "k")).collect()]
    changed = re.search(r"a?(\d{100})", out[0]).group(1)
    assert changed != digits and changed[36:72] != digits[36:72] and changed[72:] != digits[72:]
    back = spark.createDataFrame([(t,) for t in out], "text string").select(pseudonyms.pseudonymise(F.col("text"), "k", True)).collect()
    assert [r[0] for r in back] == texts


def test_long_lists_of_children_keep_their_longest_match(monkeypatch):
    rng = random.Random(2)
    assert len(htmltext._common(["x", *"b" * 300], [*"b" * 300, "x"])) == 300
    for _ in range(60):
        p, q = ([rng.choice("abcd") for _ in range(rng.randrange(40))] for _ in range(2))
        want = len(htmltext._table(p, q)) if p and q else 0
        monkeypatch.setattr(htmltext, "TABLE", 6)
        got = htmltext._common(p, q)
        monkeypatch.undo()
        assert len(got) == want and all(p[s] == q[t] for s, t in got)
        assert got == sorted(got) and len({s for s, _ in got}) == len({t for _, t in got}) == len(got)
    p, q = ([rng.choice("ab") for _ in range(20_000)] for _ in range(2))
    began = time.time()
    assert len(htmltext._common(p, q)) > 14_000 and time.time() - began < 30


def test_articles_without_a_tag_of_their_own_come_through_the_wrapper(spark):
    """Only alignment tells article from notice: same tags, no names, no semantic elements."""
    rng = random.Random(9)
    say = lambda n: " ".join("w%d" % rng.randrange(4000) for _ in range(n))
    notice, links = say(40), [say(3) for _ in range(6)]
    rows, want = [], {}
    for k in range(24):
        parts = [say(rng.randrange(30, 60)) for _ in range(rng.randrange(3, 6))]
        body = "".join(f"<p>{t}</p>" for t in parts)
        rows.append((k, f"http://site.example/{k}", f"<html><body><div>{''.join(f'<p>{t}</p>' for t in links)}</div><div><p>{notice}</p></div><div>{body}</div><div><p>{links[0]} {links[1]}</p></div></body></html>"))
        want[k] = " ".join(parts)
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def texts_of(pages, induced=True):
    """Main texts of one group's pages, the first being its pivot, by votes of all of them."""
    pivot = htmltext.Tree(pages[0])
    votes = [v for p in pages if p != pages[0] for v in htmltext.votes_of(pivot, htmltext.Tree(p))]
    wrapper = (pages[0], *htmltext.choose(pivot, votes)) if induced and votes else None
    return [htmltext.read_page(p, wrapper, htmltext.Pivots()) for p in pages]


def prose(rng, n):
    return " ".join(f"w{k}" for k in rng.integers(0, 5000, n))


@pytest.mark.parametrize("n, article, copies, gone", [(12, 60, 0, True), (2, 300, 0, True), (3, 300, 0, True), (2, 60, 0, False), (12, 60, 6, True), (12, 60, 9, True), (40, 200, 30, True), (2, 60, 2, False)])
def test_a_notice_goes_and_copied_articles_stay(n, article, copies, gone):
    rng = np.random.default_rng(n + article)
    notice, shared = prose(rng, 120), [prose(rng, article // 3) for _ in range(2)]
    bodies = [[*(shared if k < copies else [prose(rng, article // 3) for _ in range(2)]), prose(rng, article // 3)] for k in range(n)]
    pages = ["<html><body><div><ul><li>Home<li>News</ul></div><div><p>" + "</p><p>".join([notice, *body]) + "</p></div></body></html>" for body in bodies]
    for text, body in zip(texts_of(pages), bodies):
        assert text.endswith(" ".join(body)) and (notice not in text) == gone


def test_pages_without_semantic_tags_need_their_wrapper(spark):
    """Given pages with every semantic tag made a div and without classes: exact by induction, and by it alone."""
    groups = {}
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id < 800").select("url", "html").orderBy("page_id").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        true = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>|</?p>|</?h1>", " ", body))).split())
        bare = re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\b", r"<\1div", r.html)
        bare = re.sub(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", bare)
        groups.setdefault((r.url.split("/")[2], htmltext.Tree(bare).layout()), []).append((bare, true))
    groups = [g for g in groups.values() if len(g) > 2]
    assert sum(map(len, groups)) > 700
    for group in groups:
        pages, true = map(list, zip(*group))
        assert texts_of(pages) == true
        assert all(a != b for a, b in zip(texts_of(pages, induced=False), true))


def test_equal_rows_unfold_in_runs(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 3), ("c", 10), ("d", 7)], "k string, n long")
    got = mixing.unfold(rows, "n", "nth", 3).orderBy("k", "nth").collect()
    assert [(r.k, r.nth) for r in got] == [(k, i) for k, n in (("a", 1), ("b", 3), ("c", 10), ("d", 7)) for i in range(n)]
    docs = spark.createDataFrame([(None if k % 3 else k, "w " * (k % 7), "a" if k % 2 else "b") for k in range(200)], "doc_id long, text string, source string")
    whole, cut = ([tuple(map(str, r)) for r in mixing.mix(docs, run=run).collect()] for run in (100, 2))
    assert sorted(whole) == sorted(cut) and len(cut) == 200


def test_rows_of_one_doc_id_are_dealt(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, "head " + text)] + [(5, f"{k % 9} {text} {k}") for k in range(60)] + [(None, text)] * 5 + [(5, None), (6, text), (6, text)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 13, per_part=4).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == brute_repeats(rows, 13)
