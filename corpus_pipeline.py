"""Training corpus pipeline: language ID, near duplicates, source mixing, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlens.llm import language_crf, ngram_join, segment_bpe, source_mixing
from trajlens.llm.common import ship
from trajlens.llm.queries import MIX_WEIGHTS, WORD_BPE, held_out
from trajlens.session import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the model stay: letters, a mean posterior over chance, letter triples as usual there.

    Their ``lang`` is then the language found, whether a row had a label or not, and the mix draws by it. The model learns from
    labelled rows that are not held out.
    """
    model = language_crf.train(docs, F.coalesce(~held_out(), F.lit(True)))
    return language_crf.accepted(docs, model, lang_column="lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: five-word shingles, Jaccard similarity of 0.8 or more."""
    ship(spark)
    return ngram_join.one_per_class(docs, width=5, threshold=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn for the target weights, once per epoch drawn, with their whole text."""
    return source_mixing.mixed_rows(docs, MIX_WEIGHTS)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each row.

    Executors come here with the memory of the stages before, so workers remember fewer words than those of op5.
    """
    return segment_bpe.encoded_digests(docs, public_tokenizers.path(WORD_BPE), remembered=WORDS, chars=CHARS)


#: Words that a worker remembers, and characters of text that it takes at once, in the tokenization.
WORDS, CHARS = 40_000, 300_000

STAGES = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokenization", tokenization),
]

#: A conditional random field and merges by rank are beyond SQL; the tests use brute force.
ORACLE_SQL = None


#: Rows per Arrow batch: with whole documents in a row, a batch of Spark's usual size takes tens of megabytes several times.
BATCH_ROWS = 2_000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, BATCH_ROWS)
    try:
        return _run(spark, sf_dir)
    finally:
        spark.conf.set(setting, before)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/llm/pipeline-{uuid.uuid4().hex}"
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
