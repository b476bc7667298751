"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of their docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, langid, mixing, ngram_join, secret_scan
from gridloom.llm.common import discard, staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised; ``lang`` becomes the recognised one.

    Learns from the rows' own ``lang`` where it isn't null. A row that is rejected
    goes: no text, no letter, or too narrow a margin between two languages.
    """
    dictionaries = langid.fit_dictionaries(docs.where(langid.remainder("doc_id", 5) != 0))
    rows = langid.classify(docs, dictionaries).where("NOT lang_rejected").withColumn("lang", F.col("lang_pred"))
    return rows.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that shingles of five words link at a similarity of 0.8: that of the smallest ``doc_id``.

    Rows without words are linked with nothing and stay, as do all rows with a null
    id. Rows that repeat an id go each by their own text; those that repeat both id
    and text count once.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    rows = docs.withColumn("__row", key)
    groups = ngram_join.jaccard_components(rows, words=5, percent=80, id_col="__row", keep=["doc_id"]).where("__row IS NOT NULL")
    linked = groups.where("n_shingles > 0")
    stay = linked.groupBy("component_id").agg(F.min(F.struct("doc_id", "__row"))["__row"].alias("stay"))
    gone = staged(linked.join(stay, "component_id").where("__row <> stay").select("__row").distinct())
    again = staged(groups.groupBy("__row").count().where("count > 1").select("__row"))
    kept = rows.join(gone, "__row", "left_anti")
    once = kept.join(again, "__row", "left_anti").select(docs.columns)
    return once.unionByName(kept.join(again, "__row", "left_semi").dropDuplicates(["__row"]).select(docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; in ``text`` each secret is replaced by [redacted kind], or [example kind] where it is a copied example.

    Null and empty texts stay as they are; rows that repeat are treated alike, and a null id is a value of its own.
    """
    key = list(secret_scan.ROW_KEY)
    found = secret_scan.find_secrets(docs).where(F.size("spans") > 0).dropDuplicates(key).select(*key, F.col("spans").alias("__spans"))
    rows = docs.withColumns(secret_scan.row_key("doc_id", "text")).join(staged(found), key, "left").drop(*key)
    return secret_scan.redact(rows, "text", "__spans").withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that sources weigh the square root of their rows, in a shuffled order.

    A null source is a source of its own; rows that repeat an id are drawn alike, those with a null id by their content.
    """
    return mixing.mix(docs).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, intact): token ids of each row, and whether they decode to its text.

    A null text counts as empty, with no ids; each row is encoded by itself, repeated or not.
    """
    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.bpe_roundtrip(docs, vocab, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("intact"))


STAGES = [
    ("language identification", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: Compression and similarity joins are out of SQL's reach; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir))
        if hasattr(before, "_gridloom_path"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
