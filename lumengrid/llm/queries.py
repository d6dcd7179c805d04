"""The registered queries of this subpackage, and SQL twins where SQL can say it."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontamination, dedup, htmltext, langid, mixing, ngram_join, pseudonyms, secrets, substring, tokens, warc, whitening

#: Setting that names the secret key of the pseudonyms.
PSEUDONYM_SETTING = "spark.lumengrid.pseudonym.key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pseudonym_key(spark: SparkSession) -> str:
    """The session's secret key; without one the word "test", which protects nothing and says so."""
    key = spark.conf.get(PSEUDONYM_SETTING, None)
    if not key:
        warnings.warn(f"{PSEUDONYM_SETTING} is unset: pseudonyms of synthetic test data only")
    return key or "test"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixing.in_training_order(mixed.select("doc_id", "size", "source_size", "target", "taken", "position", F.get("positions", F.lit(1)).alias("position_2")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(dedup.halves(_table(spark, sf_dir, "documents")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"), secrets.spans_text(F.col("found")).alias("spans"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(found).alias("held_out"), F.col("language.label").alias("lang_pred"), F.col("language.score").alias("score"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(spark, tokens.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), window=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    h = F.col("hits")
    return found.select("doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(h["items"]), ","), 256).alias("items_sha256"), (h["n_hit"] > 0).alias("contaminated"))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.replace_personal_data(_table(spark, sf_dir, "documents"), pseudonym_key(spark))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def op12_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(_table(spark, sf_dir, "pages"))
    captures = warc.assemble(warc.read_records(warc.archive_files(spark, folder), payloads=False))
    return warc.page_captures(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_exact_dedup, op3_secret_scan, op4_language_id, op5_token_output, op6_html_extraction, op7_ngram_join, op8_substring_dedup, op9_decontaminate, op10_pseudonyms, op11_centroid_clusters, op12_warc_captures, op13_whitening)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Training time of a demand x under the schedule w0 + slope * t.
_TIME = "round(least(greatest(CASE WHEN w0 + sqrt(greatest(w0 * w0 + 2 * slope * {x}, 0)) > 0 THEN 2 * {x} / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * {x}, 0))) ELSE 0.0 END, 0.0), 1.0), 9) + (CASE WHEN {x} IS NULL THEN NULL ELSE 0.0 END)"

ORACLE_SQL = {
    "op1_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', 'mix', doc_id::VARCHAR)) AS k
  FROM documents),
s AS (SELECT sk, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY sk) - 1) % 3 AS r FROM sized GROUP BY sk),
w AS (SELECT *, CASE r WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             CASE r WHEN 0 THEN 4.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE END AS w0,
             CASE r WHEN 0 THEN -3.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS slope,
             (2 * source_size)::DOUBLE AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, sk) AS k,
             (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
             sum(weight) OVER (ORDER BY cap / weight, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, first_value(CASE WHEN cap > level * weight THEN level END IGNORE NULLS) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM l),
t AS (SELECT sk, source_size, weight, w0, slope, least(cap, coalesce(lv * weight, cap)) AS target FROM f),
d AS (SELECT sized.*, source_size, weight, w0, slope, target, floor(target)::BIGINT AS due,
             coalesce(sum(size) OVER (PARTITION BY sized.sk ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior
      FROM sized JOIN t ON sized.sk = t.sk),
e AS (SELECT *, (least(greatest(due - prior, 0), size) + least(greatest(due - source_size - prior, 0), size))::BIGINT AS taken FROM d),
p AS (SELECT *, CASE WHEN taken > 0 THEN prior / target * weight END AS x, CASE WHEN due - source_size - prior > 0 AND size > 0 THEN (prior + source_size) / target * weight END AS x2 FROM e)
SELECT doc_id, size, source_size, target, taken, """ + _TIME.format(x="x") + " AS position, " + _TIME.format(x="x2") + " AS position_2 FROM p",
    "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d""",
    "op7_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS k FROM w WHERE len(w) >= 4)
      UNION SELECT doc_id, '<' || array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.v)
SELECT documents.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM documents JOIN r ON r.v = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id GROUP BY documents.doc_id""",
    "op8_substring_dedup": rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM w WHERE len(w) >= 13)),
m AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY g) AS f FROM g) WHERE f < doc_id),
c AS (SELECT DISTINCT doc_id, k + j AS p FROM m, range(0, 13) AS o(j)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t FROM x ANTI JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY x.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id""",
    "op9_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k+n-1], ' ') AS g FROM
      (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM q),
g AS (SELECT doc_id, n, k, array_to_string(w[k:k+n-1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, z WHERE len(w) >= n)),
h AS (SELECT g.doc_id, g.k, g.n, q.item_id FROM g JOIN q ON g.n = q.n AND g.g = q.g),
p AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM h, range(0, 10) AS o(j) WHERE j < n GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, p.n IS NOT NULL AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id""",
}

def _cluster_twin(rounds: int = 3, k: int = 16) -> str:
    """k-means on whole numbers: every vector against every centroid, round by round."""
    out = rf"""
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept QUALIFY c < {k}),"""
    for r in range(rounds + 1):
        out += rf"""
f{r} AS (SELECT vec_id, kept.v, c.c, list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{r} c),
a{r} AS (SELECT vec_id, v, min(struct_pack(d := d, c := c)) AS best FROM f{r} GROUP BY vec_id, v),"""
        if r < rounds:
            out += rf"""
s{r} AS (SELECT best.c AS c, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{r}) GROUP BY 1, 2),
c{r + 1} AS (SELECT c{r}.c, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN
  (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM s{r} GROUP BY c) m ON m.c = c{r}.c),"""
    return out.rstrip(",") + rf"""
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = best.c"""


ORACLE_SQL["op11_centroid_clusters"] = _cluster_twin()
