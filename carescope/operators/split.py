"""Entity-grouped split, leakage check and split set operations.

The split is a pure function of the group key: bucket = int(md5('seed:group')[0:8], 16) % 10000,
test when bucket < 10000*test_size, validation when bucket < 10000*(test_size+val_size), else
train. No shuffle, no driver state, stable when rows are appended, every row of a group lands in
the same split (so leakage is impossible by construction; ``leakage_check`` verifies it on data).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import md5_bucket

BUCKETS = 10000


def assign_split(df: DataFrame, group: str = "patient_nbr", test_size: float = 0.15,
                 val_size: float = 0.15, seed: int = 42, out: str = "split", exact: bool = False) -> DataFrame:
    """Add ``split`` in {'train','val','test'} by a hash of the group key.

    Default: fixed cut points on bucket = int(md5('seed:group')[0:8], 16) % 10000 (stateless,
    stable when rows are appended; fractions of groups are approximate). ``exact=True`` takes the
    cut points from exact percentiles of the 32-bit group hash over the distinct groups (one
    distributed aggregate, two numbers back to the driver), so the group fractions are exact up
    to one group.
    """
    if not exact:
        b = md5_bucket(F.col(group), seed, BUCKETS)
        t_cut, v_cut = int(round(BUCKETS * test_size)), int(round(BUCKETS * (test_size + val_size)))
    else:
        from .quantiles import exact_percentiles
        from .scalars import scalar_row
        b = md5_bucket(F.col(group), seed, 1 << 32)
        groups = df.select(b.alias("_b"), F.col(group)).dropDuplicates([group])
        cuts = exact_percentiles(groups, "_b", (test_size, test_size + val_size))
        row = scalar_row(cuts.agg(F.max(F.when(F.col("p") == float(test_size), F.col("percentile"))).alias("t"),
                                  F.max(F.when(F.col("p") == float(test_size + val_size),
                                               F.col("percentile"))).alias("v")))
        t_cut, v_cut = row["t"], row["v"]
    return df.withColumn(out, F.when(b < F.lit(t_cut), F.lit("test")).when(b < F.lit(v_cut), F.lit("val"))
                         .otherwise(F.lit("train")))


def split_summary(df: DataFrame, label: str = "label", split: str = "split",
                  group: str = "patient_nbr") -> DataFrame:
    """A5 per split: rows, distinct groups, positive rate."""
    return df.groupBy(split).agg(F.count("*").cast("bigint").alias("rows"),
                                 F.count_distinct(group).cast("bigint").alias("groups"),
                                 F.avg(F.col(label).cast("double")).alias("positive_rate"))


def leakage_check(df: DataFrame, group: str = "patient_nbr", split: str = "split") -> DataFrame:
    """J3 + U2 in one pass: per pair of splits, the number of groups present in both.

    groupBy(group) collects the (at most 3) distinct split names of each group, then the
    pairs are counted. An empty result means no leakage. Never three joins.
    """
    per_group = df.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    pairs = per_group.where(F.size("splits") > 1).select(
        F.explode(F.transform(
            F.filter(F.flatten(F.transform("splits", lambda a: F.transform(
                F.col("splits"), lambda b: F.array(a, b)))), lambda p: p[0] < p[1]),
            lambda p: F.concat_ws("&", p))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count("*").cast("bigint").alias("shared_groups"))


def assert_no_leakage(df: DataFrame, group: str = "patient_nbr", split: str = "split") -> None:
    """J3 as a guard: raise with the overlap count of every pair of splits sharing a group.

    The leakage table has at most three rows (pairs of splits), so only that reaches the driver.
    """
    pairs = {r["pair"]: r["shared_groups"] for r in leakage_check(df, group, split).collect()}
    if pairs:
        raise ValueError(f"groups shared between splits: {pairs}")


def rows_of_split(raw: DataFrame, split_keys: DataFrame, key: str = "encounter_id") -> DataFrame:
    """Raw rows of a split, recovered by key (left-semi join, not by position)."""
    return raw.join(split_keys.select(key), key, "left_semi")


def union_splits(df: DataFrame, splits: Sequence[str] = ("train", "val"), split: str = "split") -> DataFrame:
    """The refit set as a filter over the split column (no union of copies)."""
    return df.where(F.col(split).isin(*splits))


def shared_groups(a: DataFrame, b: DataFrame, group: str = "patient_nbr") -> DataFrame:
    """Groups present in both inputs (distinct intersection)."""
    return a.select(group).intersect(b.select(group))
