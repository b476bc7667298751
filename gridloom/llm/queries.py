"""The queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, mixing, ngram_join, passages, quality, repair, repetition, secret_scan, sharding, spelling, toolcalls, topk
from .common import table


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = repetition.repetition_verdict(repetition.repetition_stats(docs, keep=["doc_id"]))
    return rows.select("doc_id", *repetition.COUNTS, "base_failed", "kept", "repeated_words", "longest_repeat")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.bpe_roundtrip(docs, vocab, public_tokenizers.PATTERN, keep=["doc_id"]))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op8_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_zstd_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.remainder("doc_id", 5) == 0)
    dictionaries = langid.fit_dictionaries(docs.where(~F.col("held_out")))
    rows = langid.classify(docs.select("doc_id", "held_out", "text"), dictionaries, keep=["doc_id", "held_out"])
    return rows.select("doc_id", "held_out", "lang_pred", "score", "lang_rejected")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "text", "copy", "shuffle_key")


def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.duplicate_passages(table(spark, sf_dir, "documents"))


def op7_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op9_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.chat_as_calls(table(spark, sf_dir, "conversations"))
    return toolcalls.link_calls(calls, results, toolcalls.CHAT_SCHEMAS)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.repair_conversations(repair.damaged(table(spark, sf_dir, "conversations"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_repetition,
        op2_byte_bpe,
        op3_secret_ownership,
        op4_ngram_jaccard,
        op5_poisson_mix,
        op6_compact_windows,
        op7_impact_topk,
        op8_rff_quality,
        op9_tool_links,
        op10_zstd_langid,
        op11_spelling_variants,
        op12_feistel_shards,
        op13_conversation_repair,
    )
}
ORACLES: dict[str, str] = {
    "op5_poisson_mix": mixing.MIX_SQL,
    "op7_impact_topk": topk.TOPK_SQL,
    "op9_tool_links": toolcalls.CHAT_SQL,
    "op11_spelling_variants": spelling.SPELLING_SQL,
    "op12_feistel_shards": sharding.SHARD_SQL,
    "op13_conversation_repair": repair.REPAIR_SQL,
}
