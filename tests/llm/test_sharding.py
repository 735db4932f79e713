"""Feistel sharding: a permutation, its inverse, gapless slots, shard sizes, awkward rows."""

import zlib

import pytest
from data import SF, awkward, empty
from pyspark.sql import functions as F

from carescope.llm import sharding
from carescope.llm.queries import QUERIES


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000])
def test_permutation_and_inverse(spark, n):
    x = spark.range(n).withColumn("p", sharding.permuted(F.col("id"), n, 5))
    got = x.withColumn("back", sharding.permuted(F.col("p"), n, 5, inverse=True)).collect()
    assert sorted(r["p"] for r in got) == list(range(n))
    assert all(r["back"] == r["id"] for r in got)


def test_seed_changes_the_order(spark):
    x = spark.range(500).select(sharding.permuted(F.col("id"), 500, 1).alias("a"), sharding.permuted(F.col("id"), 500, 2).alias("b"))
    rows = x.collect()
    assert sum(r["a"] == r["b"] for r in rows) < 20
    assert sum(r["a"] == k for k, r in enumerate(rows)) < 20


def test_shard_and_slot_give_the_row(spark):
    n = 103
    shard, slot = sharding.shard_of(F.col("id"), n, 16, 9)
    rows = spark.range(n).withColumns({"shard": shard, "slot": slot}).withColumn(
        "back", sharding.row_of(F.col("shard"), F.col("slot"), n, 16, 9)).collect()
    assert all(r["back"] == r["id"] for r in rows)


def check(rows, docs, shards=16):
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i is None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    by = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op1_sharding"](spark, SF).collect()
    check(rows, docs)
    assert [r["row_number"] for r in sorted(rows, key=lambda r: r["doc_id"])] == list(range(len(docs)))


def test_awkward_rows(spark):
    docs = awkward(spark)
    check(sharding.shard_rows(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sharding.shard_rows(empty(spark)).count() == 0
