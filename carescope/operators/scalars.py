"""Attach the values of a one-row aggregate to another DataFrame.

A one-row aggregate (a total, a best trial, a base rate) is fetched with one small job and its
values become literals in the consuming projection: no join, no cross product, and nothing but a
single row passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scalar_row(one_row: DataFrame):
    rows = one_row.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected exactly one row, got {len(rows)}")
    return rows[0]


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` plus every column of the one-row ``one_row`` as a typed literal."""
    r = scalar_row(one_row)
    return df.select("*", *[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in one_row.schema.fields])
