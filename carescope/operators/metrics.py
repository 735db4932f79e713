"""Binary-classification metrics from one score histogram.

All metrics are grouped: pass ``group_cols`` to get one row per group (split, model,
subgroup, replicate ...). Nothing is collected to the driver.

Exact semantics (tie-aware, matching rank-based definitions):
  AUROC = (sum neg*(TP - pos) + 0.5*sum neg*pos) / (P*N)          null if P=0 or N=0
  AP    = sum (pos/P) * TP/(TP+FP)                                  step sum, not trapezoid
with TP/FP cumulative by descending score including the current score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import curves

F1_EPS = 1e-12  # fixed: F1 = 2pr/(p+r+1e-12)


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _ranking_aggs() -> tuple[Column, Column, Column, Column]:
    """(P, N, AUROC, AP) aggregate expressions over a curve table (pos, neg, tp, fp)."""
    pos, neg, tp, fp = _d("pos"), _d("neg"), _d("tp"), _d("fp")
    P, N = F.sum(pos), F.sum(neg)
    auroc = F.when((P > 0) & (N > 0),
                   (F.sum(neg * (tp - pos)) + F.lit(0.5) * F.sum(neg * pos)) / (P * N))
    auprc = F.when((P > 0) & (N > 0), F.sum(pos * tp / (tp + fp)) / P)
    return P, N, auroc, auprc


def _best_f1_agg() -> Column:
    """max_by over thresholds of F1 (needs the group total P on each curve row); ties -> lowest threshold."""
    tp, fp = _d("tp"), _d("fp")
    precision = tp / (tp + fp)
    recall = F.when(F.col("P") > 0, tp / _d("P")).otherwise(F.lit(0.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall + F.lit(F1_EPS))) \
        .otherwise(F.lit(0.0))
    return F.max_by(F.struct(f1.alias("f1"), F.col("score").alias("score")),
                    F.struct(F.round(f1, 12), -F.col("score")))


def ranking_metrics(df: DataFrame, score: str = "score", label: str = "label",
                    group_cols: Sequence[str] = (), weight: Column | str | None = None,
                    strategy: str = "blocked") -> DataFrame:
    """A11 + A12: (group..., n, positives, auroc, auprc) per group."""
    g = list(group_cols)
    cur = curves.curve(df, score, label, g, weight, strategy)
    P, N, auroc, auprc = _ranking_aggs()
    return cur.groupBy(*g).agg((P + N).cast("bigint").alias("n"), P.cast("bigint").alias("positives"),
                               auroc.alias("auroc"), auprc.alias("auprc"))


def best_f1(df: DataFrame, score: str = "score", label: str = "label",
            group_cols: Sequence[str] = (), strategy: str = "blocked") -> DataFrame:
    """Best F1 over thresholds (predict positive when score >= threshold).

    Ties on F1 (compared at 12 decimals) go to the lowest threshold.
    """
    g = list(group_cols)
    cur = curves.with_group_totals(curves.curve(df, score, label, g, strategy=strategy), g)
    return cur.groupBy(*g).agg(_best_f1_agg().alias("_b")).select(
        *g, F.col("_b.f1").alias("best_f1"), F.col("_b.score").alias("best_threshold"))


def brier(df: DataFrame, score: str = "score", label: str = "label", group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of the probability."""
    return df.groupBy(*group_cols).agg(F.avg(F.pow(_d(score) - _d(label), 2)).alias("brier"))


def metric_bundle(df: DataFrame, score: str = "score", label: str = "label",
                  group_cols: Sequence[str] = (), prefix: str = "", strategy: str = "blocked") -> DataFrame:
    """Auroc, auprc, brier, best_f1, best_threshold per group, names optionally prefixed.

    Everything comes from one score histogram and one aggregate over its curve: the Brier score
    is sum(pos * (s - 1)^2 + neg * s^2) / n over the histogram rows, so the rows are read once.
    """
    g = list(group_cols)
    cur = curves.with_group_totals(curves.curve(df, score, label, g, strategy=strategy), g)
    P, N, auroc, auprc = _ranking_aggs()
    s = _d("score")
    br = F.sum(_d("pos") * F.pow(s - F.lit(1.0), 2) + _d("neg") * F.pow(s, 2)) / (P + N)
    out = cur.groupBy(*g).agg(auroc.alias("auroc"), auprc.alias("auprc"), br.alias("brier"),
                              _best_f1_agg().alias("_b"))
    p = f"{prefix}_" if prefix else ""
    return out.select(*g, *[F.col(n).alias(p + n) for n in ("auroc", "auprc", "brier")],
                      F.col("_b.f1").alias(p + "best_f1"), F.col("_b.score").alias(p + "best_threshold"))


def confusion_at(df: DataFrame, thresholds: Sequence[float], score: str = "score", label: str = "label",
                 group_cols: Sequence[str] = (), base_rate: Column | None = None) -> DataFrame:
    """A16 + A28: tp/fp/tn/fn, precision, recall, specificity, ppv lift at each threshold.

    One pass: thresholds become an exploded literal array, counts are conditional sums.
    Zero denominators give 0.0. Lift = precision / prevalence of the group (0 if prevalence is 0).
    """
    g = list(group_cols)
    # Reduce rows to the score histogram first, so the threshold fan-out multiplies distinct
    # scores, not rows.
    hist = curves.score_histogram(df, score, label, g)
    base = hist.select(*g, "score", "pos", "neg",
                       F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    pred = F.col("score") >= F.col("threshold")
    agg = base.groupBy(*g, "threshold").agg(
        F.sum(F.when(pred, F.col("pos")).otherwise(0)).cast("bigint").alias("tp"),
        F.sum(F.when(pred, F.col("neg")).otherwise(0)).cast("bigint").alias("fp"),
        F.sum(F.when(pred, 0).otherwise(F.col("neg"))).cast("bigint").alias("tn"),
        F.sum(F.when(pred, 0).otherwise(F.col("pos"))).cast("bigint").alias("fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision = ratio(tp, tp + fp)
    prevalence = ratio(tp + fn, tp + fp + tn + fn) if base_rate is None else base_rate
    return agg.select(*g, "threshold", "tp", "fp", "tn", "fn",
                      precision.alias("precision"), ratio(tp, tp + fn).alias("recall"),
                      ratio(tn, tn + fp).alias("specificity"),
                      F.when(prevalence > 0, precision / prevalence).otherwise(F.lit(0.0)).alias("lift"))


def calibration_bin(p: Column, n_bins: int = 10) -> Column:
    """Bin = number of interior edges i/n_bins strictly below p (left-sided search)."""
    expr = F.lit(0)
    for i in range(1, n_bins):
        expr = expr + F.when(F.lit(i).cast("double") * F.lit(1.0 / n_bins) < p, 1).otherwise(0)
    return expr


def calibration_table(df: DataFrame, score: str = "score", label: str = "label",
                      group_cols: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """Equal-width reliability table; empty bins do not appear."""
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
              .groupBy(*group_cols, calibration_bin(F.col(score), n_bins).alias("bin"))
              .agg(F.count("*").alias("n"), F.avg(_d(score)).alias("mean_pred"),
                   F.avg(_d(label)).alias("observed_rate")))


def calibration_in_the_large(df: DataFrame, score: str = "score", label: str = "label",
                             group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean prediction vs observed rate, their difference and the Brier score."""
    return df.groupBy(*group_cols).agg(
        F.count("*").alias("n"), F.avg(_d(score)).alias("mean_pred"), F.avg(_d(label)).alias("observed_rate"),
        (F.avg(_d(score)) - F.avg(_d(label))).alias("calibration_gap"),
        F.avg(F.pow(_d(score) - _d(label), 2)).alias("brier"))
