"""Per-row additive attributions and their summaries.

Linear / logistic models have a closed form in log-odds space:
    contribution_j = w_j * (x_j - mean_j),   base = b + sum_j w_j * mean_j,
so base + sum_j contribution_j equals the margin exactly (E3). Contributions are plain column
arithmetic; no Python in the hot path. Tree ensembles use :mod:`carescope.operators.treeshap`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PredictionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class LinearScorer:
    """A frozen logistic scorer: ordered features, weights, intercept, background means, optional Platt."""

    features: list[str]
    weights: list[float]
    intercept: float
    means: list[float]
    platt: tuple[float, float] | None = None   # (a, b): calibrated = sigmoid(a * p + b)

    def _x(self, f: str) -> Column:
        return F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0))

    def prepare(self, df: DataFrame) -> DataFrame:
        """Nothing to add: all methods are expressions over the features."""
        return df

    def margin(self) -> Column:
        m = F.lit(float(self.intercept))
        for f, w in zip(self.features, self.weights):
            m = m + F.lit(float(w)) * self._x(f)
        return m

    def base_value(self) -> float:
        return float(self.intercept) + sum(w * m for w, m in zip(self.weights, self.means))

    def raw_probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))

    def probability(self) -> Column:
        p = self.raw_probability()
        if self.platt is not None:
            a, b = self.platt
            p = platt_apply(p, a, b)
        return p

    def contributions(self) -> Column:
        """array<struct<position, feature, value, feature_value>> in feature order."""
        return F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"),
                                  (F.lit(float(w)) * (self._x(f) - F.lit(float(m)))).alias("value"),
                                  self._x(f).alias("feature_value"))
                         for i, (f, w, m) in enumerate(zip(self.features, self.weights, self.means))])


def platt_apply(p: Column, a: float, b: float) -> Column:
    """M7 applied: sigmoid(a * p + b) on the probability, as a closed-form column."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(a)) * p + F.lit(float(b)))))


def top_k(contribs: Column, k: int = 5) -> Column:
    """The k largest |value| entries (ties: lower feature position first), k clamps.

    Sorts a struct whose first fields are (-|value|, position) with the natural, code-generated
    struct ordering instead of an interpreted comparator lambda.
    """
    keyed = F.transform(contribs, lambda c: F.struct((-F.abs(c["value"])).alias("k"),
                                                     c["position"].alias("position"),
                                                     c["feature"].alias("feature"),
                                                     c["value"].alias("value"),
                                                     c["feature_value"].alias("feature_value")))
    top = F.slice(F.sort_array(keyed), 1, k)
    return F.transform(top, lambda c: F.struct(c["feature"].alias("feature"), c["value"].alias("value"),
                                               c["feature_value"].alias("feature_value")))


def long_contributions(df: DataFrame, contribs: Column, key: str = "encounter_id") -> DataFrame:
    """(key, position, feature, value, feature_value): one row per row and feature."""
    return df.select(key, F.inline(contribs))


def additivity(df: DataFrame, scorer: LinearScorer, key: str = "encounter_id") -> DataFrame:
    """Both sides per row: base + sum(contributions), and the margin."""
    total = F.aggregate(scorer.contributions(), F.lit(0.0), lambda acc, c: acc + c["value"])
    return df.select(key, (F.lit(scorer.base_value()) + total).alias("attributed"), scorer.margin().alias("margin"))


def additivity_error(df: DataFrame, scorer: LinearScorer, key: str = "encounter_id") -> DataFrame:
    """Max |base + sum(contributions) - margin| over all rows (should be ~0)."""
    err = F.abs(F.col("attributed") - F.col("margin"))
    return additivity(df, scorer, key).agg(F.max(err).alias("max_additivity_error"), F.count("*").alias("rows"))


def linear_importance(df: DataFrame, scorer: LinearScorer) -> DataFrame:
    """A25 for a linear model: mean |contribution| per feature from one aggregate (no explode)."""
    aggs = [F.avg(F.abs(F.lit(float(w)) * (scorer._x(f) - F.lit(float(m))))).alias(f"c{i}")
            for i, (f, w, m) in enumerate(zip(scorer.features, scorer.weights, scorer.means))]
    row = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"),
                             F.col(f"c{i}").alias("mean_abs_contribution"))
                    for i, f in enumerate(scorer.features)])
    return row.select(F.inline(arr))


def importance(long: DataFrame) -> DataFrame:
    """A25 for any model: mean |value| per feature over a long-form contribution table."""
    return long.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs_contribution"))


def waterfall(df: DataFrame, contribs: Column, base_value: float, key: str = "encounter_id") -> DataFrame:
    """For each selected row, steps in |value| order with a running total from the base value.

    The window is partitioned by row key: one row's steps (feature count) per partition key.
    """
    keyed = F.transform(contribs, lambda c: F.struct((-F.abs(c["value"])).alias("k"), c["position"].alias("position"),
                                                     c["feature"].alias("feature"), c["value"].alias("value")))
    steps = df.select(key, F.posexplode(F.sort_array(keyed)).alias("step", "c"))
    w = Window.partitionBy(key).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.select(key, (F.col("step") + 1).alias("step"), F.col("c.feature").alias("feature"),
                        F.col("c.value").alias("value"),
                        (F.lit(float(base_value)) + F.sum("c.value").over(w)).alias("running_total"))


def beeswarm(long: DataFrame, top: int = 20) -> DataFrame:
    """Long-form rows of the ``top`` most important features (broadcast semi join on <= top names)."""
    imp = importance(long).orderBy(F.col("mean_abs_contribution").desc(), "feature").limit(top)
    return long.join(F.broadcast(imp.select("feature")), "feature", "left_semi")


def explain_base_stage(model):
    """The predictor that attributions explain, not a calibrator or an assembler around it.

    A composite's ``base`` is unwrapped first; of a pipeline's stages the last prediction model counts.
    """
    while hasattr(model, "base"):
        model = model.base
    for stage in reversed(list(getattr(model, "stages", [model]))):
        if isinstance(stage, PredictionModel):
            return stage
    raise TypeError(f"no prediction model in {type(model).__name__}")


def from_logistic_model(model, feature_names: Sequence[str], background: DataFrame) -> LinearScorer:
    """E1 for a fitted Spark logistic-regression pipeline: weights and intercept from the model
    (original feature scale), background means from one aggregate over ``background``.

    The scorer's margin equals the model's raw margin, so the closed-form contributions explain
    the trained model exactly (E3), in log-odds space.
    """
    lr = model.stages[-1]
    coefs = [float(c) for c in lr.coefficients.toArray()]
    row = background.agg(*[F.avg(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0))).alias(f"m{i}")
                           for i, f in enumerate(feature_names)]).first()
    means = [float(row[f"m{i}"]) for i in range(len(feature_names))]
    return LinearScorer(list(feature_names), coefs, float(lr.intercept), means)
