"""Score histograms and running totals by descending score (W1): the base of every ranking metric.

A ranking metric never sorts rows. Rows are first reduced to a histogram with one row per
(group, distinct score) holding positive and negative counts (map-side partial aggregation),
then cumulative counts are taken over that histogram.

The cumulative step is a two-pass prefix sum at every size: the histogram is range partitioned on
(group, score) into balanced blocks and checkpointed, per-block totals (tiny) give each block an
offset, and the window runs per (block, group). A group holding a third of all scores is spread
over many blocks. ``strategy="window"`` (one window a group) is there to test against.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scalars import with_scalars
from .joins import join_on


def score_histogram(df: DataFrame, score: str = "score", label: str = "label",
                    group_cols: Sequence[str] = (), weight: Column | str | None = None) -> DataFrame:
    """(group..., score, pos, neg) with one row per distinct score; null scores/labels are dropped."""
    w = F.lit(1) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    y = F.col(label)
    return (df.where(F.col(score).isNotNull() & y.isNotNull())
              .groupBy(*group_cols, F.col(score).alias("score"))
              .agg(F.sum(F.when(y == 1, w).otherwise(0)).cast("bigint").alias("pos"),
                   F.sum(F.when(y == 1, 0).otherwise(w)).cast("bigint").alias("neg")))


def running_totals(hist: DataFrame, group_cols: Sequence[str] = (), order_col: str = "score",
                   value_cols: Sequence[str] = ("pos", "neg"), out_cols: Sequence[str] = ("tp", "fp"),
                   strategy: str = "blocked", n_blocks: int | None = None) -> DataFrame:
    """Cumulative sums of ``value_cols`` over ``order_col`` descending, current row included."""
    g = list(group_cols)
    if strategy == "window":
        w = (Window.partitionBy(*g).orderBy(F.col(order_col).desc())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return hist.select("*", *[F.sum(v).over(w).alias(o) for v, o in zip(value_cols, out_cols)])
    if strategy != "blocked":
        raise ValueError(f"unknown strategy {strategy}")
    spark = hist.sparkSession
    n = n_blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    ranged = hist.repartitionByRange(n, *[F.col(c) for c in g], F.col(order_col).desc())
    ranged = cut_lineage(ranged.withColumn("_blk", F.spark_partition_id()))
    totals = ranged.groupBy("_blk", *g).agg(*[F.sum(v).alias(v) for v in value_cols])
    before = (Window.partitionBy(*g).orderBy("_blk")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_blk", *g, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_off_{v}")
                                           for v in value_cols])
    inner = (Window.partitionBy("_blk", *g).orderBy(F.col(order_col).desc())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = join_on(ranged, offsets, ["_blk", *g])
    return joined.select(*hist.columns,
                         *[(F.sum(v).over(inner) + F.col(f"_off_{v}")).alias(o)
                           for v, o in zip(value_cols, out_cols)])


def curve(df: DataFrame, score: str = "score", label: str = "label", group_cols: Sequence[str] = (),
          weight: Column | str | None = None, strategy: str = "blocked") -> DataFrame:
    """Per group and distinct threshold: pos, neg, cumulative tp/fp (score >= threshold)."""
    hist = score_histogram(df, score, label, group_cols, weight)
    return running_totals(hist, group_cols, strategy=strategy)


def with_group_totals(curve_df: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Attach P (total positives) and N (total negatives) of each group by a join on the group keys.

    The totals table has one row per group; AQE turns the join into a broadcast when it is small.
    """
    g = list(group_cols)
    totals = curve_df.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if not g:
        return with_scalars(curve_df, totals)  # one totals row, attached as literals
    return join_on(curve_df, totals, g)
