"""Percentiles by window and group in a stream (X2): mergeable quantile sketches as aggregation state.

A value is counted in a cell whose bounds grow by a fixed factor, so that the cell's representative is
within ``alpha`` of every value in it, relative to the value. Counts per (window, group, cell) are an
ordinary streaming aggregate: they merge by addition, in any order, and a window's state has as many
rows as its values span cells (some 1,200 over twelve decades at 1 %), however many values there are.
A second aggregate brings a closed window's cells together and reads the percentiles off them.
Percentiles interpolate linearly between order statistics, each known to ``alpha``, so for values of
one sign the result is within ``alpha`` of the exact percentile. Values nearer to 0 than ``SMALL``
count as 0. Nulls are not counted.

In append mode a window comes out once, when the watermark has passed its end; the file sink commits
each batch's files in one step. ``end_of_stream`` lands a row without a value behind all others, so
that the next run closes every window that was still open.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ALPHA = 0.01
SMALL = 1e-12


def representative(value: Column, alpha: float = ALPHA) -> Column:
    """The value that stands for all values of its cell."""
    growth = (1 + alpha) / (1 - alpha)
    cell = F.ceil(F.log(F.abs(value)) / F.lit(math.log(growth)))
    size = F.lit(2.0) * F.pow(F.lit(growth), cell.cast("double")) / F.lit(growth + 1)
    return F.when(F.abs(value) < SMALL, F.lit(0.0)).otherwise(F.signum(value) * size)


def cell_counts(df: DataFrame, size: str, group_cols: Sequence[str], ts: str, value: str, alpha: float = ALPHA) -> DataFrame:
    """(cell_window, group..., rep, n, total, largest): what a sketch holds, one row a cell."""
    v = F.col(value).cast("double")
    return df.groupBy(F.window(ts, size).alias("cell_window"), *group_cols, representative(v, alpha).alias("rep")).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.max(v).alias("largest"))


def percentile_of(cells: Column, n: Column, p: float) -> Column:
    """Linear-interpolated percentile of sorted (rep, n) cells."""
    at = F.lit(p) * (n - 1)

    def ranked(rank: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(0.0).alias("v"))
        return F.aggregate(cells, start, lambda a, c: F.when(a["before"] <= rank, F.struct((a["before"] + c["n"]).alias("before"), c["rep"].alias("v")))
                           .otherwise(a), lambda a: a["v"])
    low, high = ranked(F.floor(at)), ranked(F.ceil(at))
    return low + (at - F.floor(at)) * (high - low)


def percentile_rollup(df: DataFrame, size: str = "1 hour", group_cols: Sequence[str] = ("risk_band",), ts: str = "ts", value: str = "value",
                      alpha: float = ALPHA, percentiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Window start, group, n, mean, max and percentiles; ``df`` is a batch, or a stream with a watermark on ``ts``."""
    cells = cell_counts(df, size, group_cols, ts, value, alpha)
    whole = cells.groupBy(F.window(F.window_time("cell_window"), size).alias("w"), *group_cols).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("largest").alias("max_value"),
        F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("rep", "n")))).alias("cells"))
    return whole.where(F.col("n") > 0).select(
        F.col("w.start").alias("window_start"), *group_cols, "n", (F.col("total") / F.col("n")).alias("mean_value"), "max_value",
        *[percentile_of(F.col("cells"), F.col("n"), p).alias(f"p{round(100 * p)}") for p in percentiles])


def end_of_stream(spark: SparkSession, source_dir: str, schema: StructType, at: dt.datetime, ts: str = "ts") -> None:
    """Land one row without values at time ``at``, later than the last window's end by more than the watermark."""
    row = tuple(at if f.name == ts else None for f in schema.fields)
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(source_dir)
