"""Sampling and row picks (T3-T6, W3). Hash orders make every pick deterministic under retries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import md5_unit
from .joins import join_on


def seeded_sample(df: DataFrame, n: int, key: str = "encounter_id", seed: int = 42) -> DataFrame:
    """N rows by ascending md5(seed:key) (all rows when n >= size); a take-ordered, not a full sort."""
    return df.orderBy(md5_unit(F.lit(seed), F.col(key)), F.col(key)).limit(n)


def extreme_rows(df: DataFrame, score: str = "score", key: str = "encounter_id",
                 label: str = "label", target: float = 0.05) -> DataFrame:
    """T4 + T5 in one aggregate: the highest-score row, and the negative row nearest ``target``.

    Ties: highest score then lowest key; nearest distance then lowest key.
    """
    row = F.struct(F.col(key).alias("key"), F.col(score).alias("score"), F.col(label).alias("label"))
    hi = F.max_by(row, F.struct(F.col(score), -F.col(key)))
    dist = F.abs(F.col(score) - F.lit(target))
    lo = F.min_by(F.when(F.col(label) == 0, row), F.when(F.col(label) == 0, F.struct(dist, F.col(key))))
    agg = df.where(F.col(score).isNotNull()).agg(hi.alias("highest"), lo.alias("nearest"))
    return agg.select(F.inline(F.array(
        F.struct(F.lit("highest_risk").alias("pick"), F.col("highest.*")),
        F.struct(F.lit("true_negative_near_target").alias("pick"), F.col("nearest.*")))))


def first_valid(df: DataFrame, valid: Column, n: int, key: str = "encounter_id", strict: bool = False) -> DataFrame:
    """The first n valid rows by key (take-ordered). ``strict`` raises when fewer than n exist
    (one count over at most n rows)."""
    out = df.where(valid).orderBy(key).limit(n)
    if strict:
        got = out.count()
        if got < n:
            raise ValueError(f"only {got} valid rows, {n} requested")
    return out


def diverse_pick(df: DataFrame, band: Column, group: Column, n: int = 5, key: str = "encounter_id",
                 seed: int = 42, salts: int | None = None) -> DataFrame:
    """Per band, round-robin over groups (largest first) with a seeded shuffle inside groups.

    Selection order within a band = (rank in group, group size desc, group name). Only the first
    n of each group can ever be chosen, so each group is cut to n by a salted two-level top-n
    (a hot group is split over ``salts`` window partitions, as many as a shuffle has if not given), and group sizes come from an
    aggregate joined back, not from a window over the group.
    """
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("band", "grp")]   # outputs replace same-named inputs
    base = df.select(*keep, band.alias("band"), group.alias("grp"),
                     md5_unit(F.lit(seed), F.col(key)).alias("_h")).where(F.col("band").isNotNull())
    sizes = base.groupBy("band", "grp").agg(F.count("*").cast("bigint").alias("group_size"))
    order = [F.col("_h"), F.col(key)]
    salted = base.withColumn("_salt", F.pmod(F.xxhash64(F.col(key)), F.lit(salts)))
    w1 = Window.partitionBy("band", "grp", "_salt").orderBy(*order)
    cut1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n)
    w2 = Window.partitionBy("band", "grp").orderBy(*order)
    cut2 = cut1.withColumn("group_rank", F.row_number().over(w2)).where(F.col("group_rank") <= n)
    ranked = join_on(cut2, sizes, ["band", "grp"])
    w3 = Window.partitionBy("band").orderBy(F.col("group_rank"), F.col("group_size").desc(), F.col("grp"))
    picked = ranked.withColumn("pick_order", F.row_number().over(w3)).where(F.col("pick_order") <= n)
    return picked.drop("_h", "_salt", "_r1")


def selection_group(diag_group: Column, age_cat: Column) -> Column:
    """W3 composite key: '<diag bucket>_<age category>' (F11)."""
    return F.concat_ws("_", F.coalesce(diag_group, F.lit("missing")), F.coalesce(age_cat, F.lit("unknown")))


def keep_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)
