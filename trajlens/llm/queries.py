"""Registered queries of the corpus operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlens.llm import (
    contextual_pii, conversation_repair, language_crf, media_columns, ngram_join, prefix_trie, segment_bpe, source_mixing, text_density, token_counts, token_records, url_rules,
    weighted_fingerprints,
)
from trajlens.llm.common import ship, table
from trajlens.llm.oracles import ORACLES

WORD_BPE = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
#: Target weights of the registered mix and of the pipeline.
MIX_WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}


def op1_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"), table(spark, folder, "labels"))


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return ngram_join.shingle_classes(table(spark, folder, "documents"), width=3, threshold=90)


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # The first line is counted apart from the rest.
    fields = [
        ("source", F.col("source")), ("lang", F.col("lang")), ("title", F.regexp_extract("text", r"\A[^\n]*", 0)),
        ("body", F.regexp_replace("text", r"\A[^\n]*\n?", "")),
    ]
    return token_counts.field_token_counts(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, fields)


def held_out(id_column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(4)) == 2


def op4_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    model = language_crf.train(docs, ~F.col("held_out"))
    return language_crf.predict(docs, model, ["doc_id", "held_out"])


def op5_segment_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return segment_bpe.encoded_digests(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


def op6_weighted_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return weighted_fingerprints.compare_with_edits(table(spark, folder, "documents"))


def op7_text_density(spark: SparkSession, folder: str) -> DataFrame:
    return text_density.extract(table(spark, folder, "pages"))


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return source_mixing.mix(table(spark, folder, "documents"), MIX_WEIGHTS)


def op9_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    stored = media_columns.media_table(table(spark, folder, "documents"))
    return media_columns.describe(stored).withColumnRenamed("id", "doc_id")


def op10_token_records(spark: SparkSession, folder: str) -> DataFrame:
    return token_records.round_trip(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


def op11_contextual_pii(spark: SparkSession, folder: str) -> DataFrame:
    return contextual_pii.digests(contextual_pii.personal_data(table(spark, folder, "documents")))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = conversation_repair.damaged(table(spark, folder, "conversations"))
    return conversation_repair.summaries(conversation_repair.repaired(turns))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, folder, "conversations")))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    build.__name__: build
    for build in (
        op1_url_rules, op2_ngram_jaccard, op3_token_counts, op4_language_crf, op5_segment_bpe, op6_weighted_fingerprints,
        op7_text_density, op8_source_mixing, op9_media_columns, op10_token_records,
        op11_contextual_pii, op12_conversation_repair, op13_conversation_trie, pipeline,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
