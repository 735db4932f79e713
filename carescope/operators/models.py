"""Model training, calibration and comparison on Spark ML.

Capability parity with the reference, not score parity: logistic regression maps exactly
(regParam = 1 / (C * sum of weights), penalty on standardised features). Gradient boosting grown best
leaf first is in :mod:`boosting`; ``fit_gbt`` here is Spark's own depth-wise learner.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics
from .explain import platt_apply
from .scalars import with_scalars
from .joins import join_on


def class_weight_table(df: DataFrame, label: str = "label") -> DataFrame:
    """M2: balanced weights n / (2 * n_c) per class (one row per class)."""
    per = df.groupBy(label).agg(F.count("*").cast("bigint").alias("n"))
    total = df.agg(F.count("*").alias("_N"))
    return with_scalars(per, total).select(label, "n", (F.col("_N") / (F.lit(2.0) * F.col("n"))).alias("weight"))


def class_weights(df: DataFrame, label: str = "label") -> list[tuple]:
    """M2 on the driver, in one pass: (class, rows, weight), one a class."""
    rows = df.groupBy(label).agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in rows)
    return [(r[label], r["n"], total / (2.0 * r["n"])) for r in rows]


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight", weights: Sequence[tuple] | None = None) -> DataFrame:
    """Attach the class weight as a literal per class (two numbers fetched once; no join on the label)."""
    w = None
    for value, _, weight in class_weights(df, label) if weights is None else weights:
        cond = F.col(label).isNull() if value is None else (F.col(label) == F.lit(value))
        w = F.when(cond, F.lit(weight)) if w is None else w.when(cond, F.lit(weight))
    return df.withColumn(out, w) if w is not None else df.withColumn(out, F.lit(None).cast("double"))


def fit_logreg(train: DataFrame, feature_cols: Sequence[str], label: str = "label", C: float = 1.0,
               max_iter: int = 2000, weight_col: str | None = "weight") -> PipelineModel:
    """M1 + M3: L2 logistic regression on standardised features with balanced class weights."""
    if weight_col and weight_col not in train.columns:
        weights = class_weights(train, label)
        data, sum_w = with_class_weights(train, label, weight_col, weights), sum(n * w for _, n, w in weights) if weights else None
    else:
        data, sum_w = train, train.agg(F.sum(weight_col) if weight_col else F.count("*")).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter,
                            regParam=1.0 / (C * float(sum_w)), elasticNetParam=0.0, standardization=True,
                            **({"weightCol": weight_col} if weight_col else {}))
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[asm, lr]).fit(data)


def fit_gbt(train: DataFrame, feature_cols: Sequence[str], label: str = "label", max_iter: int = 500,
            step_size: float = 0.05, max_depth: int = 5, min_instances: int = 50, subsample: float = 0.8,
            feature_subset: str = "all", weight_col: str | None = "weight", seed: int = 42) -> PipelineModel:
    """M4: gradient-boosted trees (depth-wise) with balanced class weights."""
    data = with_class_weights(train, label, weight_col) if weight_col and weight_col not in train.columns else train
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, stepSize=step_size,
                        maxDepth=max_depth, minInstancesPerNode=min_instances, subsamplingRate=subsample,
                        featureSubsetStrategy=feature_subset, seed=seed,
                        **({"weightCol": weight_col} if weight_col else {}))
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[asm, gbt]).fit(data)


def score(model: PipelineModel, df: DataFrame, out: str = "probability_1") -> DataFrame:
    """M6: class-1 probability as a double column."""
    return model.transform(df).withColumn(out, vector_to_array(F.col("probability"))[1]) \
        .drop("features", "rawPrediction", "probability", "prediction")


def per_iteration_auc(trees: Sequence, weights: Sequence[float], valid: DataFrame, feature_cols: Sequence[str],
                      label: str = "label") -> DataFrame:
    """M5: validation AUROC of every ensemble prefix (iterations 1..T) in one pass, by exact margins.

    Each task evaluates all trees with numpy, takes the running margin over trees and counts a batch's rows
    by (iteration, margin, label); running totals over the margins are blocked at every size.
    """
    import numpy as np
    import pandas as pd

    from .boosting import auroc_by
    from .treeshap import tree_predict
    trees, weights = list(trees), [float(w) for w in weights]
    feats = valid.where(F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("y"),
        F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in feature_cols]).alias("x"))

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            X, y = np.array(pdf["x"].tolist(), dtype=float), pdf["y"].to_numpy() == 1
            margin = np.zeros(len(X))
            for it, (t, w) in enumerate(zip(trees, weights)):
                margin += w * tree_predict(X, t)
                scores, at = np.unique(margin, return_inverse=True)
                pos = np.bincount(at, y, len(scores)).astype(np.int64)
                yield pd.DataFrame({"iteration": np.int32(it + 1), "score": scores, "pos": pos,
                                    "neg": np.bincount(at, minlength=len(scores)) - pos})

    return auroc_by(feats.mapInPandas(run, "iteration int, score double, pos long, neg long"), ["iteration"])


def best_iteration(iter_auc: DataFrame, patience: int = 50) -> int:
    """M5: the iteration early stopping keeps (patience rule on validation AUROC).

    Iterations are scanned in order; boosting stops once ``patience`` rounds pass without a
    better AUROC (compared at 12 decimals) and the best iteration seen so far is kept. The table
    has one row per boosting round, so it is bounded by the iteration count.
    """
    rows = iter_auc.orderBy("iteration").collect()
    best_i, best = None, None
    for r in rows:
        a = None if r["auroc"] is None else round(r["auroc"], 12)
        if a is not None and (best is None or a > best):
            best_i, best = r["iteration"], a
        if best_i is not None and r["iteration"] - best_i >= patience:
            break
    return int(best_i if best_i is not None else rows[-1]["iteration"])


@dataclass
class CalibratedModel:
    """M8: a fitted pipeline with Platt coefficients; saves, loads and transforms as one model."""

    base: PipelineModel
    a: float
    b: float

    def transform(self, df: DataFrame, out: str = "probability_1") -> DataFrame:
        return score(self.base, df, out).withColumn(out, platt_apply(F.col(out), self.a, self.b))

    def save(self, path: str) -> None:
        """The pipeline under ``base``, the coefficients as a one-row table; any file system Spark knows."""
        spark = SparkSession.getActiveSession()
        self.base.write().overwrite().save(f"{path}/base")
        spark.createDataFrame([(self.a, self.b)], "a double, b double").write.mode("overwrite").parquet(f"{path}/platt")

    @staticmethod
    def load(path: str) -> CalibratedModel:
        row = SparkSession.getActiveSession().read.parquet(f"{path}/platt").first()
        return CalibratedModel(PipelineModel.load(f"{path}/base"), row["a"], row["b"])


def fit_platt(valid_scored: DataFrame, prob_col: str = "probability_1", label: str = "label") -> tuple[float, float]:
    """M7: one-feature unpenalised logistic fit of the label on the probability -> (a, b)."""
    asm = VectorAssembler(inputCols=[prob_col], outputCol="_pf")
    lr = LogisticRegression(featuresCol="_pf", labelCol=label, regParam=0.0, standardization=False, maxIter=200)
    m = lr.fit(asm.transform(valid_scored.select(prob_col, label)))
    return float(m.coefficients[0]), float(m.intercept)


def calibrated(prob: Column, a: float, b: float) -> Column:
    """M8: the calibrated wrapper as one column expression on top of the base probability."""
    return platt_apply(prob, a, b)


def compare(scored: DataFrame, models: dict[str, str], label: str = "label", split: str = "split",
            baseline: str | None = None) -> DataFrame:
    """(model, split) x metric table, with AUROC and Brier deltas vs a baseline model per split."""
    long = scored.select(split, label, F.inline(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(col).cast("double").alias("p")) for name, col in models.items()])))
    bundle = metrics.metric_bundle(long, "p", label, ["model", split])
    if baseline is None:
        return bundle
    # the baseline rows: one per split, joined back on the split key
    base = bundle.where(F.col("model") == baseline).select(split, F.col("auroc").alias("_base_auroc"),
                                                           F.col("brier").alias("_base_brier"))
    return (join_on(bundle, base, [split], "left")
            .withColumn("auroc_delta", F.col("auroc") - F.col("_base_auroc"))
            .withColumn("brier_delta", F.col("brier") - F.col("_base_brier"))   # A18 before/after
            .drop("_base_auroc", "_base_brier"))
