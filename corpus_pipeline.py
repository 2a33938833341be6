"""Corpus cleaning in five stages, each a training-data operator over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each
result is written as Parquet to the shared folder and read again as the next stage's docs, so a lost executor costs
tasks of one stage only.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import line_dedup, ngram_join, registry, spaced_seeds, toxicity
from vellum.llm.bpe_encode import encode_documents
from vellum.llm.common import checkpoint_dir, fresh, table


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of expected severity 0.3 or more go. The model is fitted on a bounded sample of labelled rows."""
    model = toxicity.train_from(docs, table(spark, sf_dir, "labels"), registry.GRADE)
    return toxicity.keep_below(docs, model)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line of the corpus go; a document that lost lines and has nothing but white space left goes too."""
    removed = fresh(docs, "removed")
    clean = line_dedup.dedup_lines(docs, words=True, counts=(fresh(docs, "lines"), removed))
    return clean.where((F.col(removed) == 0) | F.col("text").rlike(r"\S")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays."""
    return ngram_join.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, a few words changed or not, go."""
    return spaced_seeds.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining text as token ids, with digests of the ids and of the bytes decoded from them."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("toxicity", toxic_documents), ("line_dedup", repeated_lines), ("ngram_jaccard", near_copies), ("decontamination", benchmark_leaks), ("bpe_encode", tokens)]

#: Components, fits and merges aren't SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}-{name}")
        docs = spark.read.parquet(f"{folder}/{n}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
