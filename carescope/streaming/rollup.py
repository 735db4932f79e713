"""Scoring-log statistics (A27) and event-time rollups (X2), shared by batch and streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_summary(df: DataFrame, value: str = "value", group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated p50/p95/p99, mean and sample stdev per group.

    Percentiles come from the distributed histogram method of :mod:`carescope.operators.quantiles`
    (no group's values are gathered into one buffer); moments are one partial aggregate.
    """
    from ..operators.quantiles import exact_percentiles
    from ..operators.scalars import with_scalars
    g = list(group_cols)
    q = exact_percentiles(df, value, (0.5, 0.95, 0.99), g)
    wide = q.groupBy(*g).agg(*[F.max(F.when(F.col("p") == p, F.col("percentile"))).alias(name)
                               for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
    moments = df.groupBy(*g).agg(F.count(value).cast("bigint").alias("n"), F.avg(value).alias("mean"),
                                 F.stddev_samp(value).alias("stdev"))
    out = moments.join(wide, g, "left") if g else with_scalars(moments, wide)
    return out.select(*g, "n", "p50", "p95", "p99", "mean", "stdev")


def window_rollup(df: DataFrame, size: str = "1 hour", group_cols: Sequence[str] = ("event_type",),
                  ts: str = "ts", value: str = "value") -> DataFrame:
    """X2 (batch form): count, mean and max of the value per tumbling event-time window and group."""
    return df.groupBy(F.window(ts, size).alias("w"), *group_cols).agg(
        F.count("*").cast("bigint").alias("n"), F.avg(value).alias("mean_value"),
        F.max(value).alias("max_value")).select(F.col("w.start").alias("window_start"), *group_cols,
                                                 "n", "mean_value", "max_value")
