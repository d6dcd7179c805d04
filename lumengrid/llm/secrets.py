"""Secret scans: patterns, and a battery of randomness tests with false-discovery control.

Beside three fixed patterns, every long run of encoding characters is a
candidate.  Its encoding (hex, base32 or base64) is inferred from the
characters it holds, its symbols are numbered within that alphabet, and three
tests ask whether they could be uniform random: chi-squared over the alphabet
(Wilson-Hilferty), runs about the middle of the alphabet, and lag-one serial
correlation.  The least of the three p-values times three is the candidate's
p-value.  Secrets spread evenly over (0, 1); ordinary strings crowd at 0, and
how far they leak upwards depends on length.  So within each length class the
number of secrets is estimated from the upper half, and the threshold is the
least one whose expected share of ordinary strings above it is at most
``rate``.  All counts are over all candidates; the histogram that decides is
of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .spans import clear_of, find_spans, let

# Fixed values of the contract: pattern and least length by kind, in order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
ASSIGN_LENGTH = 8

#: Maximal runs of encoding characters, with room for the tests to have power.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"
BINS = 50
#: Upper ends of the length classes.
LENGTHS = (32, 48, 64, 96, 128, 256)
RATE = 0.05

# Abramowitz and Stegun 7.1.26, approximation of erf.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

HEX_SYMBOLS = "0123456789abcdef"
B32_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
B64_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind) of the three patterns, by start then kind."""
    assign = F.filter(find_spans(text, ASSIGN, "[:=]"), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= ASSIGN_LENGTH)
    tag = lambda spans, rank, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.sort_array(F.concat(tag(assign, 0, "assign"), tag(find_spans(text, ACCESS, "AKIA"), 1, "access"), tag(find_spans(text, HEX, "[0-9a-f]{8}"), 2, "hex")))


def encoding_size(s: Column) -> Column:
    """Size of the inferred alphabet; null if the run fits no encoding of secrets."""
    lower, upper, digit = s.rlike("[a-z]"), s.rlike("[A-Z]"), s.rlike("[0-9]")
    return (
        F.when(~digit, F.lit(None))
        .when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$") & (lower | upper), F.lit(16))
        .when(s.rlike("^[A-Z2-7]+$") & upper, F.lit(32))
        .when(lower & upper & digit, F.lit(64))
    )


def two_sided(z: Column) -> Column:
    """P(|N(0,1)| >= |z|)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.least(F.greatest(poly * F.exp(-x * x), F.lit(0.0)), F.lit(1.0))


def p_value(s: Column) -> Column:
    """The battery's p-value for a candidate; null without an inferred encoding."""
    def battery(sym: Column, a: Column) -> Column:
        n = F.size(sym).cast("double")
        seen = F.array_distinct(sym)
        squares = F.aggregate(seen, F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter(sym, lambda x: x == c)).cast("double"), F.lit(2.0)))
        df = a - 1.0
        chi = squares * a / n - n
        h = 2.0 / (9.0 * df)
        z_chi = (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1.0 - h)) / F.sqrt(h)
        p_chi = F.when(z_chi > 0, two_sided(z_chi) / 2).otherwise(1 - two_sided(z_chi) / 2)
        pairs = F.zip_with(F.slice(sym, F.lit(1), F.size(sym) - 1), F.slice(sym, F.lit(2), F.size(sym) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        high = lambda x: x.cast("double") >= a / 2
        n1 = F.size(F.filter(sym, high)).cast("double")
        runs = 1.0 + F.size(F.filter(pairs, lambda q: high(q["x"]) != high(q["y"]))).cast("double")
        mean = 2.0 * n1 * (n - n1) / n + 1.0
        var = (mean - 1.0) * (mean - 2.0) / (n - 1.0)
        p_runs = F.when(var > 0, two_sided((runs - mean) / F.sqrt(var))).otherwise(0.0)
        centre = (a - 1.0) / 2.0
        power = F.aggregate(sym, F.lit(0.0), lambda acc, x: acc + (x - centre) * (x - centre))
        serial = F.aggregate(pairs, F.lit(0.0), lambda acc, q: acc + (q["x"] - centre) * (q["y"] - centre))
        p_serial = F.when(power > 0, two_sided(serial / power * F.sqrt(n))).otherwise(0.0)
        return F.least(3.0 * F.least(p_chi, p_runs, p_serial), F.lit(1.0))

    size = encoding_size(s)
    plain = F.translate(s, "-_", "+/")
    letters = F.when(size == 16, F.lit(HEX_SYMBOLS)).when(size == 32, F.lit(B32_SYMBOLS)).otherwise(F.lit(B64_SYMBOLS))
    folded = F.when(size == 16, F.lower(plain)).otherwise(plain)
    symbols = F.transform(F.split(folded, ""), lambda c: F.position(c, letters) - 1)
    return F.when(size.isNotNull(), let(F.struct(symbols.alias("sym"), size.cast("double").alias("a")), lambda x: battery(x["sym"], x["a"])))


def _length_class(n: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for i in reversed(range(len(LENGTHS))):
        out = F.when(n < LENGTHS[i], i).otherwise(out)
    return out


def thresholds(found: DataFrame, rate: float = RATE) -> DataFrame:
    """(length class, least p to report) from the histogram of all candidates."""
    one = found.select(F.explode("candidates").alias("c")).where("c.p is not null")
    bins = one.groupBy(F.col("c.stratum").alias("stratum"), F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("stratum")
    above = whole.orderBy(F.desc("bin"))
    secrets = 2 * F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).over(whole)
    t = F.col("bin") / BINS
    bins = bins.withColumn("above", F.sum("n").over(above)).withColumn("false_share", (F.col("above") - (1 - t) * secrets) / F.col("above"))
    return bins.where(F.col("false_share") <= rate).groupBy("stratum").agg((F.min("bin") / BINS).alias("least_p"))


def scan_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per document: doc_id and ``found``, all spans (start, rank, end, kind) in order.

    Kinds are assign, access, hex, and random (rank 3) for runs that pass the
    battery and overlap no other span.  Offsets are code points, end exclusive.
    Null and empty text have no spans; null and repeated doc_ids are ordinary
    rows; an empty table gives none; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = docs.select("doc_id", base_spans(text).alias("base"), find_spans(text, CANDIDATE, "[0-9]").alias("runs"))
    scored = F.transform(clear_of(F.col("runs"), F.col("base")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _length_class(s["end"] - s["start"]).alias("stratum"), p_value(s["text"]).alias("p")))
    found = stage(raw.select("doc_id", "base", F.filter(scored, lambda c: c["p"].isNotNull()).alias("candidates")), "secret_spans")
    least = {r[0]: r[1] for r in thresholds(found, rate).collect()}  # one row per length class
    limit = F.create_map(*[F.lit(x) for k in range(len(LENGTHS) + 1) for x in (k, float(least.get(k, 2.0)))])
    extra = F.transform(F.filter("candidates", lambda c: c["p"] >= F.element_at(limit, c["stratum"])), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end"), F.lit("random").alias("kind")))
    return found.select("doc_id", "base", F.sort_array(F.concat("base", extra)).alias("found"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
