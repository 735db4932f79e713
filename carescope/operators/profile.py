"""Table profiling (A1-A10): each profile is one aggregate pass, then an unpivot of the one-row result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .scalars import with_scalars
from .joins import join_on


def _unpivot_row(row_df: DataFrame, cols: Sequence[str], name: str, value: str) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in cols])
    return row_df.select(F.inline(arr))


def null_counts(df: DataFrame) -> DataFrame:
    """A1: (column, rows, nulls) for every column in one aggregate."""
    cols = df.columns
    row = df.agg(F.count("*").alias("__rows"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    return row.select(F.col("__rows").cast("bigint").alias("rows"), F.inline(F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("bigint").alias("nulls")) for c in cols])))


def missing_profile(df: DataFrame, min_fraction: float | None = None) -> DataFrame:
    """A2: (column, missing_fraction) from one aggregate; optional strict cut (e.g. > 0.005).

    Present the top n with ``orderBy(desc).limit(n)`` (a take-ordered on a one-row-per-column table).
    """
    cols = df.columns
    row = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in cols])
    out = _unpivot_row(row, cols, "column", "missing_fraction")
    return out.where(F.col("missing_fraction") > min_fraction) if min_fraction is not None else out


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """A4: (value, n, share) of one column; share over the counted rows."""
    base = df.where(F.col(col).isNotNull()) if dropna else df
    vc = base.groupBy(F.col(col).alias("value")).agg(F.count("*").cast("bigint").alias("n"))
    total = base.agg(F.count("*").alias("_total"))
    return with_scalars(vc, total).select("value", "n", (F.col("n") / F.col("_total")).alias("share"))


def entity_summary(df: DataFrame, group: str = "patient_nbr", approx_rsd: float | None = None) -> DataFrame:
    """Rows, distinct entities, mean rows per entity.

    Exact by default; with ``approx_rsd`` the distinct count is a HyperLogLog++ sketch with that
    relative standard deviation (no shuffle of distinct keys).
    """
    distinct = F.count_distinct(group) if approx_rsd is None else F.approx_count_distinct(group, approx_rsd)
    return df.agg(F.count("*").cast("bigint").alias("rows"),
                  distinct.cast("bigint").alias("entities")).select(
        "rows", "entities", (F.col("rows") / F.col("entities")).alias("rows_per_entity"))


def entity_histogram(df: DataFrame, group: str = "patient_nbr") -> DataFrame:
    """Count of counts - how many entities have k rows (two chained aggregates)."""
    per = df.groupBy(group).agg(F.count("*").cast("bigint").alias("rows_per_entity"))
    return per.groupBy("rows_per_entity").agg(F.count("*").cast("bigint").alias("entities"))


def cardinality(df: DataFrame, cols: Sequence[str], approx_rsd: float | None = None) -> DataFrame:
    """Distinct non-null values per column in one aggregate.

    Exact by default (Spark expands the rows once per column for the distinct keys); with
    ``approx_rsd`` each column is a HyperLogLog++ sketch merged map-side, for very wide inputs.
    """
    def distinct(c: str):
        return F.count_distinct(F.col(c)) if approx_rsd is None else F.approx_count_distinct(c, approx_rsd)
    row = df.agg(*[distinct(c).cast("bigint").alias(c) for c in cols])
    return _unpivot_row(row, cols, "column", "distinct_values")


def label_correlation(df: DataFrame, label: str = "label", cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson r of each numeric column with the label, one aggregate.

    A constant column has no correlation (null) instead of a divide-by-zero error.
    """
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != label]
    y = F.col(label).cast("double")
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        ok = F.stddev_pop(x) > 0
        aggs.append(F.when(ok & (F.stddev_pop(y) > 0), F.corr(x, y)).alias(c))
    row = df.agg(*aggs)
    return _unpivot_row(row, cols, "column", "corr").select(
        "column", "corr", F.abs("corr").alias("abs_corr"))


def density_histogram(df: DataFrame, cols: Sequence[str], bin_width: float, label: str = "label") -> DataFrame:
    """A10: class-conditional density of numeric columns on fixed-width bins.

    density = n / (N_class * bin_width), N_class = non-null rows of that column and class.
    """
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])
    long = df.select(F.col(label).alias("label"), F.inline(arr)).where(F.col("x").isNotNull())
    binned = long.select("column", "label", (F.floor(F.col("x") / F.lit(bin_width)) * F.lit(bin_width)).alias("bin_start"))
    counts = binned.groupBy("column", "label", "bin_start").agg(F.count("*").cast("bigint").alias("n"))
    totals = binned.groupBy("column", "label").agg(F.count("*").alias("n_class"))
    return join_on(counts, totals, ["column", "label"]).select(
        "column", "label", "bin_start", "n",
        (F.col("n") / (F.col("n_class") * F.lit(float(bin_width)))).alias("density"))
