"""Corpus pipeline: quality classifier, SimHash near-dedup, benchmark decontamination, byte-level BPE.

``run`` passes ``documents`` through STAGES; each stage's result is written as Parquet to the
shared folder of the checkpoints and read again for the next one. All stages but the last return
the columns of their input. Nulls, empty texts, ties, repeated rows and empty tables are handled
as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from carescope.llm import byte_bpe, decontam, quality, simhash
from carescope.llm.common import documents, shared_folder, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: that of least id."""
    return simhash.drop_near_duplicates(docs, length=3, distance=3)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), max_edit=0.2, target=0.95)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded."""
    # smaller tables than a job of its own: workers have the earlier stages behind them
    return byte_bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, share=0.5)


STAGES = [("quality", good_quality), ("near_dedup", distinct_documents), ("decontamination", clean_of_benchmark),
          ("byte_bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: SQL can express neither the classifier nor the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None
