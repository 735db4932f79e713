"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking.

Rows are numbered 0..n-1 in the order of their id; the permutation moves row number r to place
p(r) of 0..n-1, and shard = p mod shards, slot = p div shards. Shard sizes so differ by one at
most (law ``rows``), slots have no gaps, and shard and slot of any row number, or the row number
of any shard and slot, come from arithmetic alone, without data.

The permutation works on a grid of a x b >= n cells, a and b near the root of n: a number is the
pair (number div b, number mod b), and each round adds to one half, modulo its side, a keyed
function of the other. Numbers that leave 0..n-1 walk on until they return (cycle walking). At
most a + b numbers lie outside, so a walk is short, and its bound is their number; nothing is cut
off. Everything is DataFrame expressions.

Cases: null ids come last in the order, a null text counts as empty (size 1, crc32 0). Equal ids
are ordered by text checksum and size; rows equal in all of these are interchangeable. An empty
table gives an empty result. Only the id and text columns are read, so other columns, whatever
their names, do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carescope.llm.common import row_numbers, whole_text

ROUNDS = 8
PRIME = 2_147_483_647      # 2^31 - 1, the modulus of the round function
FACTOR = 48_271            # a primitive root of it


def grid(n: int) -> tuple[int, int]:
    """Sides a x b of the smallest near-square grid with at least n cells."""
    b = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return max(1, -(-n // b)), b


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """Keys of the rounds: successive values of the multiplicative generator from the seed."""
    keys, x = [], seed % (PRIME - 1) + 1
    for _ in range(rounds):
        x = x * FACTOR % PRIME
        keys.append(x)
    return keys


def _mix(half: Column, key: Column) -> Column:
    """Keyed function of a half: two multiplications modulo the prime; all products fit 63 bits."""
    t = (half % F.lit(PRIME) * F.lit(FACTOR) + key) % F.lit(PRIME)
    return t * (t % F.lit(65_536) + F.lit(1)) % F.lit(PRIME)


def _steps(keys: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(i % 2).alias("side"))
                     for i, k in enumerate(keys)])


def _once(x: Column, n: int, keys: list[int], inverse: bool) -> Column:
    """One pass through all rounds, on the whole grid."""
    a, b = grid(n)
    big_a, big_b = F.lit(a).cast("long"), F.lit(b).cast("long")

    def step(s: Column, k: Column) -> Column:
        change = F.when(k["side"] == 0, _mix(s["r"], k["key"]) % big_a).otherwise(_mix(s["l"], k["key"]) % big_b)
        moved = -change if inverse else change
        return F.struct(F.when(k["side"] == 0, F.pmod(s["l"] + moved, big_a)).otherwise(s["l"]).alias("l"),
                        F.when(k["side"] == 1, F.pmod(s["r"] + moved, big_b)).otherwise(s["r"]).alias("r"))

    steps = _steps(keys)
    halves = F.struct(((x - x % big_b) / big_b).cast("long").alias("l"), (x % big_b).alias("r"))
    return F.aggregate(F.reverse(steps) if inverse else steps, halves, step, lambda s: s["l"] * big_b + s["r"])


def permuted(x: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """Where row number ``x`` of 0..n-1 goes; with ``inverse``, which row number comes to ``x``."""
    keys, (a, b) = round_keys(seed), grid(n)
    outside = a * b - n
    y = _once(x.cast("long"), n, keys, inverse)
    if not outside:
        return y
    # a walk meets each cell outside 0..n-1 once at most
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(outside)), y,
                       lambda at, _: F.when(at >= F.lit(n), _once(at, n, keys, inverse)).otherwise(at))
    return F.when(y >= F.lit(n), walk).otherwise(y)


def shard_of(x: Column, n: int, shards: int, seed: int) -> tuple[Column, Column]:
    """(shard, slot) of row number ``x``."""
    place = permuted(x, n, seed)
    return (place % F.lit(shards)).cast("int"), ((place - place % F.lit(shards)) / F.lit(shards)).cast("long")


def row_of(shard: Column, slot: Column, n: int, shards: int, seed: int) -> Column:
    """The row number that lies in a slot of a shard."""
    return permuted(slot * F.lit(shards) + shard, n, seed, inverse=True)


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20_240_601, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Id, size (UTF-8 bytes and 1), text_crc32, law, shard, slot, grown_shard (null under this law),
    and the row number that shard and slot are computed from."""
    text = whole_text(text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = row_numbers(narrow, ["doc_id", "text_crc32", "size"])
    placed = numbered.withColumn("place", permuted(F.col("row_number"), n, seed))
    shard = F.col("place") % F.lit(shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
                         ((F.col("place") - shard) / F.lit(shards)).cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "row_number")
