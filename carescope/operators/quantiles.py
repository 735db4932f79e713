"""Exact linear-interpolated percentiles without holding a group's values in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer; a hot group
would pull an unbounded set into one task. Instead:

1. histogram: (group, value, count) by partial aggregation;
2. cumulative counts by ascending value with :func:`curves.running_totals` (blocked for large
   histograms, so a hot group is split over many tasks);
3. for each requested p the 0-based position h = p * (n - 1) falls between order statistics
   floor(h) and floor(h) + 1; the histogram rows holding them are kept by a filter, at most two
   rows per (group, p), and interpolated as (ceil(h) - h) * lower + (h - floor(h)) * upper.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import curves
from .scalars import with_scalars
from .joins import join_on


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float], group_cols: Sequence[str] = (),
                      strategy: str = "blocked") -> DataFrame:
    """(group..., p, percentile) for every p in ``probs``; nulls are ignored."""
    g = list(group_cols)
    hist = (df.where(F.col(value).isNotNull())
              .groupBy(*g, F.col(value).cast("double").alias("_v"))
              .agg(F.count("*").cast("bigint").alias("_c")))
    # running_totals accumulates by its order column descending: order by -value for ascending values
    hist = hist.withColumn("_neg", -F.col("_v"))
    cum = curves.running_totals(hist, g, order_col="_neg", value_cols=("_c",), out_cols=("_cum",),
                                strategy=strategy)
    totals = cum.groupBy(*g).agg(F.sum("_c").alias("_n"))
    cum = join_on(cum, totals, g) if g else with_scalars(cum, totals)
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    pos = (F.col("_n") - 1).cast("double") * F.col("p")
    lower = F.floor(pos)
    upper = F.ceil(pos)
    before = F.col("_cum") - F.col("_c")          # order statistics before this value
    holds = lambda i: (before <= i) & (i < F.col("_cum"))
    rows = cum.select(*g, "_v", "_c", "_cum", "_n", ps).select(
        "*", pos.alias("_pos"), lower.alias("_lo"), upper.alias("_hi"))
    rows = rows.where(holds(F.col("_lo")) | holds(F.col("_hi")))
    agg = rows.groupBy(*g, "p").agg(
        F.max(F.when(holds(F.col("_lo")), F.col("_v"))).alias("_vlo"),
        F.max(F.when(holds(F.col("_hi")), F.col("_v"))).alias("_vhi"),
        F.first("_pos").alias("_pos"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    value_at = F.when(F.col("_hi") == F.col("_lo"), F.col("_vlo")).otherwise(
        (F.col("_hi") - F.col("_pos")) * F.col("_vlo") + (F.col("_pos") - F.col("_lo")) * F.col("_vhi"))
    return agg.select(*g, "p", value_at.alias("percentile"))
