"""Joins on grouping keys where a null key is a group like any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` with null-safe equality (a null group meets its own totals), one copy of
    the keys kept. Planned as an ordinary hash / sort-merge / broadcast equi-join."""
    keys = list(keys)
    renamed = right.select(*[F.col(f"`{k}`").alias(f"_rk_{i}") for i, k in enumerate(keys)],
                           *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    cond = [left[f"`{k}`"].eqNullSafe(renamed[f"_rk_{i}"]) for i, k in enumerate(keys)]
    return left.join(renamed, cond, how).drop(*[f"_rk_{i}" for i in range(len(keys))])
