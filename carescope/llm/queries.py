"""The registered queries of this subpackage: one a dealt operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from carescope.llm import (byte_bpe, collocations, cws, decontam, lm, prefix_trie, quality, secret_scan, sharding, simhash,
                           token_counts, token_files, warc)
from carescope.llm.common import documents, table
from carescope.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir), shards=16)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                       public_tokenizers.PATTERN)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir), fold=1)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files_round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprint_documents(documents(spark, sf_dir), samples=32)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), length=3, distance=3)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), max_edit=0.2, target=0.95)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archives_round_trip(table(spark, sf_dir, "pages"), revisit_bytes=0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"), threshold=0.3)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), least=100, top=2000)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_token_counts, op3_byte_bpe, op4_lm_scores, op5_token_files, op6_fingerprints, op7_simhash,
                            op8_decontamination, op9_warc, op10_quality, op11_prefix_trie, op12_collocations,
                            op13_secret_scan)
}
