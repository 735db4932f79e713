"""Subgroup audit (A19-A21, J5): metrics per subgroup, over several dimensions in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bootstrap, curves, metrics
from .joins import join_on

MIN_SAMPLES = 50     # fixed: subgroups with fewer rows are skipped
MIN_POSITIVES = 5    # fixed: subgroups with fewer positives are skipped


def subgroup_metrics(df: DataFrame, group_cols: Sequence[str] = ("subgroup",), score: str = "score",
                     label: str = "label", min_samples: int = MIN_SAMPLES, min_positives: int = MIN_POSITIVES,
                     with_ci: bool = False, key: str = "encounter_id", n_iterations: int = 1000,
                     seed: int = 42, strategy: str = "blocked", ci_mode: str = "rows") -> DataFrame:
    """N, prevalence, mean_pred, auroc, auprc per subgroup, rounded to 4 dp.

    Null subgroups are excluded; rows without a score or label do not count. Subgroups below ``min_samples`` rows or ``min_positives``
    positives (or without a negative) are skipped. With ``with_ci`` the bootstrap CI columns
    (A22-A24) are added. Output is not globally sorted; use :func:`ordered` to present it.
    """
    g = list(group_cols)
    data = df.dropna(subset=g)
    # One pass over the rows: the score histogram carries every statistic of the table
    # (n, positives, prevalence, mean prediction) next to the ranking metrics.
    cur = curves.curve(data, score, label, g, strategy=strategy)
    P, N, auroc, auprc = metrics._ranking_aggs()
    weight = F.col("pos") + F.col("neg")
    stats = cur.groupBy(*g).agg(
        (P + N).cast("bigint").alias("n"), P.cast("bigint").alias("_pos"), (P / (P + N)).alias("prevalence"),
        (F.sum(F.col("score").cast("double") * weight) / (P + N)).alias("mean_pred"),
        auroc.alias("auroc"), auprc.alias("auprc"))
    kept = stats.where((F.col("n") >= min_samples) & (F.col("_pos") >= min_positives) &
                       (F.col("n") - F.col("_pos") >= 1))
    out = kept.select(*g, "n", *[F.round(c, 4).alias(c) for c in ("prevalence", "mean_pred", "auroc", "auprc")])
    if with_ci:
        # The bootstrap multiplies work by the replicate count: restrict it to kept groups first.
        data = data.join(kept.select(*g), g, "left_semi")
        ci = bootstrap.bootstrap_ci(data, key, score, label, g, n_iterations, seed=seed,
                                    mode=ci_mode).drop("skipped", "auroc", "auprc")
        out = join_on(out, ci, g, "left")
    return out


def ordered(df: DataFrame, by: str = "n", tie: Sequence[str] = ("subgroup",)) -> DataFrame:
    """Sort a small result by a metric descending with a tie-breaker."""
    return df.orderBy(F.col(by).desc(), *tie)


def explode_dimensions(df: DataFrame, dimensions: Mapping[str, Column | str],
                       keep: Sequence[str]) -> DataFrame:
    """Unpivot audit dimensions: one row per (input row, dimension) with a string ``subgroup``."""
    arr = F.array(*[F.struct(F.lit(name).alias("dimension"),
                             (F.col(c) if isinstance(c, str) else c).cast("string").alias("subgroup"))
                    for name, c in dimensions.items()])
    return df.select(*keep, F.inline(arr))


def multi_dimension_audit(df: DataFrame, dimensions: Mapping[str, Column | str], score: str = "score",
                          label: str = "label", key: str = "encounter_id", **kw) -> DataFrame:
    """Subgroup metrics over several dimensions in one grouped pass over (dimension, subgroup)."""
    long = explode_dimensions(df, dimensions, [key, score, label])
    return subgroup_metrics(long, ["dimension", "subgroup"], score, label, key=key, **kw)


def disparity(audit: DataFrame, metric: str = "auroc") -> DataFrame:
    """Max - min of a metric per dimension, with the group count."""
    return audit.groupBy("dimension").agg(
        F.count("*").cast("bigint").alias("groups"),
        F.round(F.max(metric) - F.min(metric), 4).alias(f"{metric}_spread"))


def footnote(rows: DataFrame, audit: DataFrame, row_key: str = "subgroup") -> DataFrame:
    """Attach a subgroup's metrics to each row (left join; rows without a match keep nulls).

    The audit table has one row per subgroup, so its size is bounded by the subgroup count and
    AQE broadcasts it.
    """
    return rows.join(audit.withColumnRenamed("subgroup", row_key), row_key, "left")
