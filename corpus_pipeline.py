"""A training-data pipeline over ``documents``: filter, dedup, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``docs``, whatever their names.

Defined results of every stage: a null text counts as an empty one and stays null; texts
of any length are taken whole; an empty table gives an empty table with its columns.
Null and repeated ids are allowed: no stage takes rows of one id for one row.  Repeated
rows are judged alike by ``quality`` and ``decontaminate``, keep the same text in
``lines``, and are reduced to one by ``near_duplicates`` (empty texts per id); of linked
rows the least id stays, then the least text hash, then the first row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verbatlas.llm import bm25_decontam, byte_bpe, line_dedup, ngram_jaccard, quality_qda
from verbatlas.llm.common import settle, small_batches, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; empty texts are scored like any other."""
    small_batches(spark)
    return quality_qda.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three lines in a row go; n_chars follows the text, and stays where the text is null."""
    return line_dedup.clean(docs, size="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return ngram_jaccard.keep_one(docs, words=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; without items all stay."""
    return bm25_decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256, a row a row."""
    return byte_bpe.digest(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, remembered=120_000, pairs=100_000)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("encode", encode)]

#: SQL can express neither the classifier nor the encoder; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
