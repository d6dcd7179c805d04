"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again before the next.  All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.llm import decontamination, langid, mixing, ngram_join, tokens
from lumengrid.llm.common import free_name, quoted, spread_join, stage
from lumengrid.llm.queries import tokenizer_path

#: Least fit of a text (langid.identify): chosen between the texts of the given tables and sentences of other languages.
LEAST_FIT = -0.47
#: Ids that may be broadcast; beyond this the join is shuffled.
BROADCAST_IDS = 1_000_000


def _bounded(df: DataFrame) -> DataFrame:
    df = stage(df, "pipeline_ids")
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _same(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*map(quoted, docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that no learned language fits.

    The fit is absolute and follows the spans, so mixtures of learned languages stay.
    Null and empty texts go; null doc_ids and repeated rows are judged by their
    text.  Other columns are kept as they are; an empty table stays empty, and
    without a labelled row every text goes.
    """
    into = free_name(docs, "language")
    found = langid.identify(docs, langid.fit(docs), docs.columns, into)
    return _same(found.where((F.col(f"{into}.label") != langid.UNKNOWN) & (F.col(f"{into}.fit") >= LEAST_FIT)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near copies (5 words, 0.8).

    Rows that repeat a doc_id and its text become one.  Rows without a doc_id stay,
    and so do texts without words, which are copies of nothing.  Other columns,
    whatever their names, are kept as they are; an empty table stays empty.
    """
    found = stage(ngram_join.join(docs, n=5, percent=80).select("doc_id", "component_id"), "pipeline_components")
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    kept = _same(named.join(_bounded(gone), "doc_id", "left_anti"), docs).unionByName(_same(nameless, docs))
    ids = found.where("doc_id is not null")
    return kept.dropDuplicates(["doc_id", "text"]) if ids.count() != ids.distinct().count() else kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay, as do null doc_ids; each of
    repeated rows is judged alike.  Other columns are kept as they are; an
    empty table stays empty, and an empty benchmark drops nothing.
    """
    into = free_name(docs, "hits")
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs.columns, into)
    return _same(found.where(F.col(f"{into}.n_hit") == 0), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (whole passes; none, one or two).

    Rows of one doc_id, repeated ones too, take the same number of passes:
    their share of words, rounded; so do rows without a doc_id, by source.
    Texts without words take one.  A null source is a source.  Other columns
    are kept as they are; an empty table stays empty.
    """
    key, passes, one = (free_name(docs, x) for x in ("_key", "_passes", "_pass"))
    share = F.when(F.sum("size") > 0, F.round(F.sum("taken") / F.sum("size")).cast("int")).otherwise(1).alias(passes)
    mixed = mixing.mix(docs)
    taken = stage(mixed.where("doc_id is not null").groupBy("doc_id").agg(share), "pipeline_passes")
    named = docs.where("doc_id is not null")
    if taken.count() <= BROADCAST_IDS:
        named = named.join(F.broadcast(taken), "doc_id")
    else:
        named = spread_join(named, taken, ["doc_id"], ["text"], named.select("doc_id"))
    sources = F.broadcast(mixed.where("doc_id is null").groupBy(F.col("source").alias(key)).agg(share))  # one row a source
    nameless = docs.where("doc_id is null").join(sources, F.col("source").eqNullSafe(F.col(key)))
    columns = [*map(quoted, docs.columns), F.col(passes)]
    out = named.select(*columns).unionByName(nameless.select(*columns))
    return _same(out.withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(passes)))), docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in doc_id order, and per document what they hold.

    Null texts hold only the end id; null doc_ids come first; repeated rows are
    all written.  Other columns are left out; an empty table gives no rows.
    """
    return tokens.read_tokens(spark, tokens.write_tokens(docs, tokenizer_path()))


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontaminate), ("mixing_sources", mix), ("token_output", token_output)]

#: SQL has no tokenizer; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline_{name}")
    return docs
