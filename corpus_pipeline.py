"""The corpus pipeline: documents in, encoded documents out.

Each stage reads what the stage before kept, as Parquet, and returns the columns of ``documents``; the
last returns token ids with their digests.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.llm import bpe, decontaminate, near_copies, quality, suffix_dedup
from axisframe.llm.common import small_batches, table
from axisframe.session import materialize


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    small_batches(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of all 5-word shingles) stays, the one with
    the smallest id."""
    small_batches(spark)
    return near_copies.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that stand in more than one place are cut out; ``n_chars`` follows the text."""
    small_batches(spark)
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again for the digest."""
    small_batches(spark)
    return bpe.round_trip(docs, "doc_id", public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN, with_ids=True, bounds=bpe.NARROW)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify_quality),
    ("near_duplicates", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

#: The stages train a classifier, hash shingles, sort suffixes and encode: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
