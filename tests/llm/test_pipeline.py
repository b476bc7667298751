"""The pipeline's stages, each on its own input, and as a whole."""

import collections

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import bpe, langid, mixing
from tests.llm.helpers import frame, odd_rows
from tests.llm.test_corpus import brute_components
from tests.llm.test_texts import base_spans

SF = "/root/testdata/sf0.01"


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_are_named_and_keep_the_columns(spark):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["identify_language", "drop_near_duplicates", "redact_secrets", "mix_sources", "encode_tokens"]
    docs = frame(spark, odd_rows())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_language_keeps_clean_documents(spark):
    docs = docs_of(spark)
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    same = kept.join(docs.select("doc_id", F.col("lang").alias("was")), "doc_id").where("lang = was").count()
    assert kept.count() >= 0.98 * docs.count() and same >= 0.98 * kept.count()
    foreign = frame(spark, [(5001, "日本語の文章です。" * 30, *[None] * 6), (5002, "12345 ...", *[None] * 6)]).select("doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.identify_language(spark, docs.unionByName(foreign), SF).where("doc_id > 5000").count() == 0
    assert langid.MIN_MARGIN < 0.05


def test_one_document_of_each_group_stays(spark):
    rows = [(r["doc_id"], r["text"]) for r in docs_of(spark).collect()]
    want = {c for _, c in brute_components(rows[:400], 5, 80).values()}
    some = docs_of(spark).where(F.col("doc_id").isin([i for i, _ in rows[:400]]))
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, some.unionByName(some), SF).collect()} == want
    odd = corpus_pipeline.drop_near_duplicates(spark, frame(spark, odd_rows()), SF)
    assert sorted(str(r["doc_id"]) for r in odd.collect()) == sorted(["0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "None"])


def test_near_duplicates_of_repeated_and_null_ids(spark):
    stage = lambda rows: sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, [(*r, *[None] * 6) for r in rows]), SF).collect())
    copied, unique = "one text that is the same in three rows of the table", "quite another text that stands in one row of this table"
    assert stage([(3, copied), (7, copied), (7, unique)]) == [("3", copied), ("7", unique)]
    nulls = [(None, copied)] * 3
    assert stage(nulls) == [("None", copied)] * 3
    assert stage([*nulls, *nulls, (5, unique), (5, unique)]) == sorted([("5", unique), *[("None", copied)] * 6])
    assert stage([(1, ""), (1, ""), (2, None)] )[0] == ("1", "") and len(stage([(1, ""), (1, ""), (2, "")])) == 2


def test_secrets_are_gone_and_other_texts_stay(spark):
    docs = docs_of(spark)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = corpus_pipeline.redact_secrets(spark, docs, SF).collect()
    assert len(after) == len(before)
    changed = {r["doc_id"] for r in after if r["text"] != before[r["doc_id"]]}
    assert {i for i, t in before.items() if base_spans(t)} <= changed
    assert not any(base_spans(r["text"]) for r in after) and all(r["n_chars"] == len(r["text"]) for r in after)
    assert corpus_pipeline.redact_secrets(spark, frame(spark, odd_rows()), SF).count() == len(odd_rows())


def test_mixing_repeats_whole_documents(spark):
    docs = docs_of(spark)
    out = corpus_pipeline.mix_sources(spark, docs, SF)
    assert out.select("doc_id", "text").distinct().exceptAll(docs.select("doc_id", "text")).count() == 0
    drawn = collections.Counter(r["doc_id"] for r in out.collect())
    copies = collections.Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert drawn == copies


def test_whole_run_encodes_what_the_stages_keep(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in docs_of(spark).collect()}
    assert len(out) > 800 and all(r["intact"] and r["n_tokens"] == len(r["ids"]) for r in out)
    same = sum(plain.decode(r["ids"]) == texts[r["doc_id"]] for r in out)
    assert same > 0.9 * len(out)
