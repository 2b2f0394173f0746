"""A corpus cleaned and encoded in five stages, each written as Parquet and read again by the next.

Quality classifier and compression bands reject documents, of each group of near duplicates one stays, documents that hold
benchmark texts go, and what is left is encoded. Each stage works on all that the one before it kept. Columns and rows
that a stage keeps are those it got; what is done with nulls, empty texts and repeated rows is what its operator says.
Stages that send texts to Python have the session make Arrow batches of a few megabytes, unless it was told a size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingoframe.llm import bpe, compression, quality, simhash, suffixes
from lingoframe.llm.shared import kept, small_batches, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose posterior of being good is under the threshold.

    Null and blank texts go; null hosts and sections are groups of their own; repeated rows and ties of the posterior are
    judged alike (at the threshold they stay); texts of any length are measured whole; an empty table stays empty; columns
    named like the operator's stand aside and come back.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kept(docs, lambda d: quality.judged(d, labels), quality.MADE)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents outside the compression bands.

    Null and empty texts go; repeated rows are judged alike; texts of any length are compressed whole and by chunks; an empty
    table stays empty; columns named like the operator's stand aside and come back.
    """
    small_batches(spark)
    return kept(docs, compression.compression_bands, compression.MADE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest (doc_id, hash of the text).

    Texts that are null or without a word all stay; of repeated rows of one document one stays; texts of any length count
    whole; an empty table stays empty; columns of any names pass.
    """
    small_batches(spark)
    return simhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark of 13 words or a shorter benchmark text as a whole.

    Null and empty texts stay; repeated rows stay or go alike; texts of any length are searched whole; an empty table or
    benchmark changes nothing; columns of any names pass.
    """
    small_batches(spark)
    return suffixes.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids, n_tokens and decoded_same.

    A null text has nulls there, an empty one no ids; repeated rows are encoded alike; texts of any length are encoded whole;
    an empty table stays empty; columns of these three names are replaced, others pass.
    """
    small_batches(spark)
    return bpe.encode(docs)


STAGES = [
    ("quality", classify),
    ("rules", rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: No SQL can express the stages; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
