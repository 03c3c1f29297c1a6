"""A corpus pipeline of five stages, each one operator on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import bpe, decontaminate, near_copies, suffix_dedup, toxicity
from attesta.llm.common import materialise, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity model marks."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_copies.deduplicate(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 200 bytes and more that occur again, in this document or another."""
    return suffix_dedup.rewrite(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, verbatim or with other values."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with counts and digests."""
    return bpe.encode(docs, with_ids=True)


STAGES = [
    ("toxicity", clean),
    ("simhash_near_dedup", one_of_each),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmarks),
    ("bpe_encoding", encoded),
]

#: Trained models and byte-level rules: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
