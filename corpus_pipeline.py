"""A corpus pipeline of five operators, each over everything that its predecessor kept.

Every stage's result is written as Parquet to the shared folder and read again, so that a lost
executor costs a reread and not the stages before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import bpe, exact_dedup, mixing, ngram_join, quality_fm
from rasterlake.llm.queries import RANKS, table
from rasterlake.llm.scratch import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more stay."""
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest id stays."""
    return exact_dedup.drop_duplicates_of(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose 5-word shingles have a similarity of 0.8 or more, directly or by a chain, the smallest id stays."""
    return ngram_join.keep_one_of_each(docs, k=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id`, `ids` and `n_tokens` of every row."""
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources", mixture), ("byte-level BPE", tokens)]

#: A trained classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
