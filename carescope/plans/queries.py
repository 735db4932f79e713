"""Registered queries: one per operator family of SURVEY section 7.5, keyed by its stable name.

Every query reads the driver tables (through the ``encounters`` stand-in or directly) and
returns a DataFrame; outputs are rounded where floating sums could differ in the last bits
between engines. The SQL twins live in :mod:`carescope.plans.oracle`.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import columns as C
from ..operators import (audit, boosting, bootstrap, curves, explain, features, metrics, models, prep, profile, sample,
                         score, split, treeshap, tune, user_aggregate, validate, wide)
from ..operators.explain import LinearScorer, platt_apply
from ..operators.scalars import with_scalars
from ..session import checkpoint_dir, cut_lineage, kept_table, remove_folder, small_methods
from ..sources import bundles, runs
from ..sources.fixtures import encounters, table
from ..streaming import rollup, scoring, sketch

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return deco


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 + P4 on the encounter stand-in: the labelled cohort (raw columns kept)."""
    return prep.cohort_label(encounters(spark, sf_dir))


def _r(c, d: int = 9, name: str | None = None):
    """Round a double output column (keeps the name) so engines agree past float noise."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, d).alias(name or c)


# --------------------------------------------------------------------------- prep / codes
@register("cohort_label")
def q_cohort_label(spark, sf_dir):
    return cohort(spark, sf_dir).select("encounter_id", "patient_nbr", "discharge_disposition_id", "label")


@register("icd9_group")
def q_icd9_group(spark, sf_dir):
    e = encounters(spark, sf_dir)
    return e.select("encounter_id", "diag_1", codes.icd9_group(F.col("diag_1")).alias("diag_group"))


# --------------------------------------------------------------------------- metrics
@register("auroc_auprc")
def q_auroc_auprc(spark, sf_dir):
    m = metrics.ranking_metrics(cohort(spark, sf_dir), group_cols=["race"])
    return m.select("race", "n", "positives", _r("auroc"), _r("auprc"))


@register("subgroup_metrics")
def q_subgroup_metrics(spark, sf_dir):
    c = prep.derive_audit_dimensions(cohort(spark, sf_dir)).withColumnRenamed("age_group", "subgroup")
    return audit.subgroup_metrics(c)


# --------------------------------------------------------------------------- shared inputs
NUMERIC = ["admission_type_id", "discharge_disposition_id", "admission_source_id", "time_in_hospital",
           "num_lab_procedures", "num_procedures", "num_medications", "number_inpatient", "number_diagnoses"]
CATEGORICAL = ["race", "gender", "age", "medical_specialty", "diag_1", "max_glu_serum", "A1Cresult", "insulin"]
STRING_COLS = ["race", "gender", "age", "medical_specialty", "diag_1", "max_glu_serum", "A1Cresult",
               "insulin", "readmitted"]


def cleaned(spark, sf_dir, raw=None):
    """S1/P2 semantics on the stand-in: trimmed strings, blank / '?' / 'None' -> null. ``raw``: the encounters, if
    the caller has them already (a query that reads them several times keeps them, see ``encounters``)."""
    return prep.trim_string_cells(encounters(spark, sf_dir) if raw is None else raw, prep.NULL_TOKENS)


def clean_cohort(spark, sf_dir, raw=None):
    return prep.cohort_label(cleaned(spark, sf_dir, raw))


def prepared_cohort(spark, sf_dir, raw=None):
    return features.prepare(clean_cohort(spark, sf_dir, raw))


def fitted_spec(prepared):
    return features.fit_vocabulary(prepared, CATEGORICAL, NUMERIC)


def with_split(df):
    return split.assign_split(df)


@register("trim_blank_to_null")
def q_trim_blank_to_null(spark, sf_dir):
    e = encounters(spark, sf_dir).select(
        "encounter_id", *[F.col(c).alias(f"  {c} ") for c in ("diag_1", "A1Cresult", "medical_specialty")])
    return prep.trim_string_cells(prep.trim_column_names(e), prep.NULL_TOKENS)


@register("fill_sentinels")
def q_fill_sentinels(spark, sf_dir):
    return prepared_cohort(spark, sf_dir).select("encounter_id", "race", "medical_specialty",
                                                 "A1Cresult", "max_glu_serum", "diag_1")


@register("rare_collapse")
def q_rare_collapse(spark, sf_dir):
    p = prepared_cohort(spark, sf_dir)
    spec = fitted_spec(p)
    return p.select("encounter_id", spec.mapped("medical_specialty").alias("medical_specialty"))


@register("one_hot")
def q_one_hot(spark, sf_dir):
    p = prepared_cohort(spark, sf_dir)
    return fitted_spec(p).transform(p, keep=["encounter_id"])


@register("wide_one_hot")
def q_wide_one_hot(spark, sf_dir):
    """P8 + P9 by an index table: the positions of every record's categories in the manifest's order."""
    p = prepared_cohort(spark, sf_dir)
    coded = wide.encode(p, wide.fit_index(p, CATEGORICAL, NUMERIC), "encounter_id", CATEGORICAL, NUMERIC)
    active = F.slice("indices", F.lit(len(NUMERIC) + 1), F.greatest(F.size("indices") - len(NUMERIC), F.lit(0)))
    return coded.select("encounter_id", F.array_join(active.cast("array<string>"), ",").alias("positions"))


@register("sanitize_names")
def q_sanitize_names(spark, sf_dir):
    spec = fitted_spec(prepared_cohort(spark, sf_dir))
    return features.vocabulary_table(spec, spark)


@register("align_manifest")
def q_align_manifest(spark, sf_dir):
    """Test-split rows encoded by their own (dynamic) vocabulary, aligned to the train manifest."""
    p = with_split(prepared_cohort(spark, sf_dir))
    spec = fitted_spec(p.where(F.col("split") == "train"))
    test = p.where(F.col("split") == "test")
    dyn = features.dynamic_one_hot(test, CATEGORICAL, NUMERIC, keep=["encounter_id"])
    return features.align_to_manifest(dyn, spec.feature_names(), keep=["encounter_id"])


@register("schema_drift")
def q_schema_drift(spark, sf_dir):
    p = with_split(prepared_cohort(spark, sf_dir))
    expected = features.vocabulary_table(fitted_spec(p.where(F.col("split") == "train")), spark)
    actual_spec = features.fit_vocabulary(p.where(F.col("split") == "test"), CATEGORICAL, NUMERIC,
                                          rare_columns=(), label=None)
    return features.drift(expected, features.vocabulary_table(actual_spec, spark))


@register("age_brackets")
def q_age_brackets(spark, sf_dir):
    e = encounters(spark, sf_dir)
    return e.select("encounter_id", "age", C.age_bracket(F.col("age")).alias("age_group"),
                    C.age_category(F.col("age")).alias("age_category"))


@register("code_label")
def q_code_label(spark, sf_dir):
    e = prep.exclude_sentinel(encounters(spark, sf_dir))
    return e.select("encounter_id", "gender", C.admission_type(F.col("admission_type_id")).alias("admission_type"))


@register("risk_band")
def q_risk_band(spark, sf_dir):
    e = encounters(spark, sf_dir)
    band = C.risk_band(F.col("score"))
    return e.select("encounter_id", "score", band.alias("risk_band"), C.lift(F.col("score")).alias("lift"),
                    C.selection_band(F.col("score")).alias("selection_band"), C.action_line(band).alias("action"))


@register("clean_vocab")
def q_clean_vocab(spark, sf_dir):
    e = encounters(spark, sf_dir)
    vocab = {c: validate.VOCABULARIES[c] for c in ("A1Cresult", "max_glu_serum", "insulin", "gender")}
    return prep.clean_vocabulary(e, vocab).select("encounter_id", *vocab)


@register("validate_rules")
def q_validate_rules(spark, sf_dir):
    v = validate.validate(encounters(spark, sf_dir).drop("prior_n", "o_orderdate", "score", "readmitted", "patient_nbr"))
    return v.select("encounter_id", "valid", F.size("errors").cast("bigint").alias("n_errors"),
                    F.concat_ws("; ", "errors").alias("errors"), F.concat_ws("; ", "warnings").alias("warnings"),
                    validate.is_valid_row().alias("valid_row"))


# --------------------------------------------------------------------------- split / sets / joins
def split_cohort(spark, sf_dir):
    return with_split(clean_cohort(spark, sf_dir))


@register("group_split")
def q_group_split(spark, sf_dir):
    s = split.split_summary(split_cohort(spark, sf_dir))
    return s.select("split", "rows", "groups", "positive_rate")


@register("leakage_check")
def q_leakage_check(spark, sf_dir):
    """J3 on a naive row-level split (hash of the encounter), which does leak patients."""
    naive = split.assign_split(clean_cohort(spark, sf_dir), group="encounter_id")
    return split.leakage_check(naive)


@register("raw_rows_of_split")
def q_raw_rows_of_split(spark, sf_dir):
    keys = split_cohort(spark, sf_dir).where(F.col("split") == "test")
    raw = encounters(spark, sf_dir).select("encounter_id", "patient_nbr", "age", "diag_1", "readmitted")
    return split.rows_of_split(raw, keys)


def age_audit(cohort_df):
    c = prep.derive_audit_dimensions(cohort_df).withColumnRenamed("age_group", "subgroup")
    return audit.subgroup_metrics(c)


@register("subgroup_footnote")
def q_subgroup_footnote(spark, sf_dir):
    c = prep.derive_audit_dimensions(split_cohort(spark, sf_dir))
    rows = c.where(F.col("split") == "test").select("encounter_id", "age_group")
    table_ = age_audit(clean_cohort(spark, sf_dir)).select("subgroup", "n", "auroc")
    return audit.footnote(rows, table_, row_key="age_group")


# --------------------------------------------------------------------------- profile
@register("missing_profile")
def q_missing_profile(spark, sf_dir):
    nc = profile.null_counts(cleaned(spark, sf_dir))
    frac = F.col("nulls") / F.col("rows")
    return nc.where(frac > 0.005).select("column", "rows", "nulls", frac.alias("missing_fraction"))


@register("value_counts")
def q_value_counts(spark, sf_dir):
    vc = profile.value_counts(cleaned(spark, sf_dir), "medical_specialty")
    return vc.select("value", "n", "share")


@register("entity_histogram")
def q_entity_histogram(spark, sf_dir):
    return profile.entity_histogram(clean_cohort(spark, sf_dir))


@register("entity_summary")
def q_entity_summary(spark, sf_dir):
    s = profile.entity_summary(clean_cohort(spark, sf_dir))
    return s.select("rows", "entities", "rows_per_entity")


@register("cardinality")
def q_cardinality(spark, sf_dir):
    return profile.cardinality(cleaned(spark, sf_dir), CATEGORICAL)


@register("label_corr")
def q_label_corr(spark, sf_dir):
    lc = profile.label_correlation(clean_cohort(spark, sf_dir), "label", NUMERIC + ["score"])
    return lc.select("column", _r("corr"), _r("abs_corr"))


@register("density_hist")
def q_density_hist(spark, sf_dir):
    d = profile.density_histogram(clean_cohort(spark, sf_dir), ["num_lab_procedures", "num_medications"], 10.0)
    return d.select("column", "label", "bin_start", "n", "density")


# --------------------------------------------------------------------------- metrics
@register("roc_curve")
def q_roc_curve(spark, sf_dir):
    cur = curves.with_group_totals(curves.curve(clean_cohort(spark, sf_dir)), [])
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    return cur.select(F.col("score").alias("threshold"), "tp", "fp",
                      (tp / F.col("P")).alias("tpr"), (fp / F.col("N")).alias("fpr"),
                      (tp / (tp + fp)).alias("precision"))


@register("best_f1")
def q_best_f1(spark, sf_dir):
    b = metrics.best_f1(split_cohort(spark, sf_dir), group_cols=["split"])
    return b.select("split", _r("best_f1"), "best_threshold")


@register("metric_bundle")
def q_metric_bundle(spark, sf_dir):
    m = metrics.metric_bundle(split_cohort(spark, sf_dir), group_cols=["split"])
    return m.select("split", *[_r(c) for c in m.columns if c != "split"])


@register("confusion")
def q_confusion(spark, sf_dir):
    c = metrics.confusion_at(split_cohort(spark, sf_dir), [0.1, 0.2, 0.3, 0.5], group_cols=["split"])
    return c.select("split", "threshold", "tp", "fp", "tn", "fn",
                    "precision", "recall", "specificity", "lift")


@register("calibration")
def q_calibration(spark, sf_dir):
    c = metrics.calibration_table(split_cohort(spark, sf_dir), group_cols=["split"])
    return c.select("split", "bin", "n", _r("mean_pred"), "observed_rate")


@register("calibration_large")
def q_calibration_large(spark, sf_dir):
    c = metrics.calibration_in_the_large(split_cohort(spark, sf_dir), group_cols=["split"])
    return c.select("split", "n", "observed_rate", *[_r(x) for x in ("mean_pred", "calibration_gap", "brier")])


def audit_dimensions():
    """A20 dimensions: age bracket (P16), gender without the sentinel (P19), race, admission type."""
    return {
        "age_group": C.age_bracket(F.col("age")),
        "gender": F.when(F.col("gender") != prep.GENDER_SENTINEL, F.col("gender")),
        "race": F.col("race"),
        "admission_type": C.admission_type(F.col("admission_type_id")),
    }


@register("multi_audit")
def q_multi_audit(spark, sf_dir):
    return audit.multi_dimension_audit(clean_cohort(spark, sf_dir), audit_dimensions())


@register("audit_disparity")
def q_audit_disparity(spark, sf_dir):
    return audit.disparity(audit.multi_dimension_audit(clean_cohort(spark, sf_dir), audit_dimensions()))


@register("bootstrap_ci")
def q_bootstrap_ci(spark, sf_dir):
    c = prep.derive_audit_dimensions(clean_cohort(spark, sf_dir))
    return bootstrap.bootstrap_ci(c.where(F.col("age_group").isNotNull()), group_cols=["age_group"],
                                  n_iterations=1000)


@register("audit_ci")
def q_audit_ci(spark, sf_dir):
    """A19 + A20 + A22-A24 + P19: the test split audited over four dimensions with bootstrap intervals;
    gender's sentinel category is left out, and ``sentinel_rows`` reports how many rows that drops."""
    c = with_split(prep.derive_audit_dimensions(clean_cohort(spark, sf_dir))).where(F.col("split") == "test")
    gender = F.when(F.coalesce(F.col("gender") != prep.GENDER_SENTINEL, F.lit(True)), F.col("gender"))
    dims = {"race": "race", "gender": gender, "age_group": "age_group", "admission_type": "admission_type"}
    a = audit.multi_dimension_audit(c, dims, with_ci=True, n_iterations=1000)
    dropped = c.agg(F.count(F.when(F.col("gender") == prep.GENDER_SENTINEL, 1)).alias("sentinel_rows"))
    return with_scalars(a, dropped)


def coarse_cohort(spark, sf_dir):
    """The audited cohort with scores in tenths: a few scores that a great many rows share."""
    c = prep.derive_audit_dimensions(clean_cohort(spark, sf_dir)).where(F.col("age_group").isNotNull())
    return c.withColumn("score", F.floor(F.col("score") * 10) / 10)


@register("bootstrap_ties")
def q_bootstrap_ties(spark, sf_dir):
    """A22 over tied scores: the metrics of every replicate and of the rows themselves (replicate 200)."""
    reps = bootstrap.replicate_metrics(coarse_cohort(spark, sf_dir), group_cols=["age_group"], n_iterations=200)
    return reps.select("age_group", "replicate", _r("auroc"), _r("auprc"))


@register("bootstrap_exact")
def q_bootstrap_exact(spark, sf_dir):
    """A22-A24 with replicates of exactly n rows: intervals by age group, and the least and largest replicate."""
    c = prep.derive_audit_dimensions(clean_cohort(spark, sf_dir)).where(F.col("age_group").isNotNull())
    return bootstrap.bootstrap_ci(c, group_cols=["age_group"], n_iterations=1000, mode="exact")


@register("class_weights")
def q_class_weights(spark, sf_dir):
    return models.class_weight_table(split_cohort(spark, sf_dir).where(F.col("split") == "train"))


# --------------------------------------------------------------------------- sampling
@register("diverse_sample")
def q_diverse_sample(spark, sf_dir):
    p = prep.derive_audit_dimensions(with_split(prepared_cohort(spark, sf_dir)))
    test = p.where(F.col("split") == "test")
    picked = sample.diverse_pick(test, C.selection_band(F.col("score")),
                                 sample.selection_group(F.col("diag_1"), F.col("age_category")), n=5)
    return picked.select("band", "pick_order", "encounter_id", "grp", "group_rank", "group_size")


@register("seeded_sample")
def q_seeded_sample(spark, sf_dir):
    return sample.seeded_sample(clean_cohort(spark, sf_dir), 5000).select("encounter_id", "patient_nbr", "score")


@register("extreme_rows")
def q_extreme_rows(spark, sf_dir):
    return sample.extreme_rows(split_cohort(spark, sf_dir).where(F.col("split") == "test"))


@register("first_valid")
def q_first_valid(spark, sf_dir):
    rows = sample.first_valid(cleaned(spark, sf_dir), validate.is_valid_row(), 10)
    return rows.select("encounter_id", "race", "gender", "age")


# --------------------------------------------------------------------------- scoring / explanations
# Fixed demonstration scorer (weights, intercept and background means are parameters of the
# query, not learned): it gives the attribution and scoring operators a model whose output
# another engine can reproduce exactly.
DEMO_WEIGHTS = {"number_inpatient": 0.35, "time_in_hospital": 0.04, "num_medications": 0.01,
                "number_diagnoses": 0.05, "diag_1_circulatory": 0.15, "diag_1_diabetes": 0.10,
                "A1Cresult__8": 0.20, "insulin_Up": 0.12, "age__70_80": 0.08}
DEMO_MEANS = {"number_inpatient": 1.0, "time_in_hospital": 7.5, "num_medications": 40.0,
              "number_diagnoses": 8.5, "diag_1_circulatory": 0.3, "diag_1_diabetes": 0.08,
              "A1Cresult__8": 0.14, "insulin_Up": 0.25, "age__70_80": 0.1}
DEMO_INTERCEPT = -3.0
DEMO_PLATT = (5.38, -2.72)


def demo_scorer(platt: bool = False):
    names = list(DEMO_WEIGHTS)
    return LinearScorer(names, [DEMO_WEIGHTS[n] for n in names], DEMO_INTERCEPT,
                        [DEMO_MEANS[n] for n in names], DEMO_PLATT if platt else None)


def prepared_rows(spark, sf_dir, raw=None):
    """Prepared cohort with split, worked out once: what the encoding and every later pass read."""
    p = with_split(prepared_cohort(spark, sf_dir, raw))
    return kept_table(p.select("encounter_id", "patient_nbr", "split", "label", "score", *NUMERIC, *CATEGORICAL), "prepared")


def encoded_cohort(spark, sf_dir, p=None):
    """Prepared cohort with split, encoded by the vocabulary fitted on the train split."""
    p = prepared_rows(spark, sf_dir) if p is None else p
    spec = fitted_spec(p.where(F.col("split") == "train"))
    return spec.transform(p, keep=["encounter_id", "patient_nbr", "split", "label", "score", "age"]), spec


@register("linear_attribution_topk")
def q_linear_attribution_topk(spark, sf_dir):
    enc, _ = encoded_cohort(spark, sf_dir)
    top = enc.select("encounter_id", F.posexplode(explain.top_k(demo_scorer().contributions(), 5))
                     .alias("rank", "c"))
    return top.select("encounter_id", (F.col("rank") + 1).alias("rank"), F.col("c.feature").alias("feature"),
                      _r("c.value", name="value"), F.col("c.feature_value").alias("feature_value"))


@register("attribution_importance")
def q_attribution_importance(spark, sf_dir):
    enc, _ = encoded_cohort(spark, sf_dir)
    imp = explain.linear_importance(enc, demo_scorer())
    return imp.select("position", "feature", _r("mean_abs_contribution"))


@register("additivity_check")
def q_additivity_check(spark, sf_dir):
    enc, _ = encoded_cohort(spark, sf_dir)
    sides = explain.additivity(enc, demo_scorer())
    # + 0.0: no negative zero
    return sides.select("encounter_id", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("attributed", "margin")])


@register("waterfall")
def q_waterfall(spark, sf_dir):
    """W4 for the highest-probability test row (T4 on the scorer output)."""
    enc, _ = encoded_cohort(spark, sf_dir)
    s = demo_scorer()
    test = enc.where(F.col("split") == "test").select("*", s.margin().alias("_m"))
    top = test.agg(F.max_by("encounter_id", F.struct(F.col("_m"), -F.col("encounter_id"))).alias("k"))
    one = test.join(F.broadcast(top), test.encounter_id == top.k, "left_semi")
    wf = explain.waterfall(one, s.contributions(), s.base_value())
    return wf.select("encounter_id", "step", "feature", _r("value"), _r("running_total"))


@register("beeswarm")
def q_beeswarm(spark, sf_dir):
    enc, _ = encoded_cohort(spark, sf_dir)
    long = explain.long_contributions(enc, demo_scorer().contributions())
    bs = explain.beeswarm(long, top=20)
    return bs.select("encounter_id", "feature", _r("value"), "feature_value")


@register("feature_labels")
def q_feature_labels(spark, sf_dir):
    enc, _ = encoded_cohort(spark, sf_dir)
    top = enc.select("encounter_id", F.posexplode(explain.top_k(demo_scorer().contributions(), 5)).alias("rank", "c"))
    name, value = C.display_name(F.col("c.feature")), F.col("c.feature_value")
    return top.select("encounter_id", (F.col("rank") + 1).alias("rank"),
                      F.concat(name, F.lit(" ("), C.format_value(value), F.lit(")")).alias("label"),
                      # values that are not integral: 120.4, 100.3 and 999.7 times a small integer
                      *[C.format_value(F.lit(f) * (value + 1)).alias(n)
                        for n, f in (("text_a", 120.4), ("text_b", 100.3), ("text_c", 999.7), ("text_d", 0.00012345))])


@register("platt_apply")
def q_platt_apply(spark, sf_dir):
    c = clean_cohort(spark, sf_dir)
    p = platt_apply(F.col("score"), *DEMO_PLATT)
    return c.select("encounter_id", _r(p, name="calibrated"), C.risk_band(p).alias("risk_band"))


@register("model_compare")
def q_model_compare(spark, sf_dir):
    s = split_cohort(spark, sf_dir).withColumn("calibrated", platt_apply(F.col("score"), *DEMO_PLATT))
    cmp = models.compare(s, {"raw": "score", "platt": "calibrated"}, baseline="raw")
    return cmp.select("model", "split", *[_r(c) for c in ("auroc", "auprc", "brier", "best_f1",
                                                          "best_threshold", "auroc_delta",
                                                          "brier_delta")])


def scored_batch(spark, sf_dir):
    p = with_split(prepared_cohort(spark, sf_dir))
    spec = fitted_spec(p.where(F.col("split") == "train"))
    src = cleaned(spark, sf_dir).drop("readmitted", "prior_n", "o_orderdate", "score", "patient_nbr")
    return score.score_batch(src, spec, demo_scorer(platt=True))


@register("scored_batch")
def q_scored_batch(spark, sf_dir):
    a = score.audit_log(scored_batch(spark, sf_dir))
    return a.select("request_id", "row_key", "valid", F.col("n_errors").cast("bigint").alias("n_errors"),
                    _r("probability"), "risk_band")


@register("batch_summary")
def q_batch_summary(spark, sf_dir):
    return score.band_counts(scored_batch(spark, sf_dir))


# --------------------------------------------------------------------------- run log / scoring log
@register("latest_run")
def q_latest_run(spark, sf_dir):
    """S10 + S11: a run table (one run per split x race, metrics as a map) and the latest run per name."""
    c = split_cohort(spark, sf_dir).where(F.col("race").isNotNull())
    rm = metrics.ranking_metrics(c, group_cols=["split", "race"])
    started = c.groupBy("split", "race").agg(F.max("o_orderdate").alias("start_time"))
    log = rm.join(started, ["split", "race"]).select(
        F.col("split").alias("name"), F.col("race").alias("run_id"), "start_time",
        F.create_map(F.lit("auroc"), F.col("auroc"), F.lit("n"), F.col("n").cast("double")).alias("metrics"))
    latest = runs.latest_runs(log)
    return latest.select("name", "run_id", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
                         _r(F.col("metrics")["auroc"], name="auroc"))


def events_utc(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@register("latency_summary")
def q_latency_summary(spark, sf_dir):
    s = rollup.latency_summary(events_utc(spark, sf_dir), group_cols=["event_type"])
    return s.select("event_type", "n", *[_r(c) for c in ("p50", "p95", "p99", "mean", "stdev")])


@register("audit_rollup")
def q_audit_rollup(spark, sf_dir):
    # Batch twin on the zone-less timestamps: hour windows independent of the session time zone.
    r = rollup.window_rollup(table(spark, sf_dir, "events"), "1 hour", ["event_type"])
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
                    "n", _r("mean_value"), "max_value")


# --------------------------------------------------------------------------- models (rows-only checks)
def model_inputs(spark, sf_dir):
    """Encoded cohort with split + the manifest feature names (vocabulary fitted on train)."""
    enc, spec = encoded_cohort(spark, sf_dir)
    return enc, spec.feature_names()


@register("logreg_scores")
def q_logreg_scores(spark, sf_dir):
    enc, names = model_inputs(spark, sf_dir)
    with small_methods(spark):
        m = models.fit_logreg(enc.where(F.col("split") == "train"), names)
    return kept_table(models.score(m, enc).select("encounter_id", "split", "label", "probability_1"), "scores")


#: Where this session has published the trained bundle of each data folder.
_PUBLISHED: dict[tuple[str, str], str] = {}


def trained_bundle(spark, sf_dir, p=None):
    """M1-M8 + S8 + S9: the published bundle of a data folder. It is fitted and published once a session (leaf-wise
    trees at the reference's settings, stopped early on the validation split, Platt on it); after that it is loaded.
    ``p``: the prepared rows, if the caller has them already."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PUBLISHED:
        enc, spec = encoded_cohort(spark, sf_dir, p)
        val = enc.where(F.col("split") == "val")
        with small_methods(spark):
            model, history = boosting.fit_boosted(enc.where(F.col("split") == "train"), spec.feature_names(), valid=val)
            platt = models.fit_platt(kept_table(model.score(val).select("probability_1", "label"), "validation"))
        root = f"{checkpoint_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
        bundles.publish(spark, root, spec, model, platt, {"best_iteration": len(model.trees), "auroc_by_iteration": history})
        _PUBLISHED[key] = root
    return bundles.load(spark, _PUBLISHED[key])


def bundle_and_inputs(spark, sf_dir):
    """The published bundle, and the cohort encoded by its manifest; both from the same prepared rows."""
    p = prepared_rows(spark, sf_dir)
    bundle = trained_bundle(spark, sf_dir, p)
    return bundle, bundle.spec.transform(p, keep=["encounter_id", "patient_nbr", "split", "label", "score", "age"])


@register("gbt_scores")
def q_gbt_scores(spark, sf_dir):
    b, enc = bundle_and_inputs(spark, sf_dir)
    return b.model.score(enc).select("encounter_id", "split", "label", "probability_1")


@register("early_stop")
def q_early_stop(spark, sf_dir):
    """M5: validation AUROC of every round of the run, up to where 50 rounds brought no better one, and the kept round."""
    card = trained_bundle(spark, sf_dir).card
    rows = [(int(i), a) for i, a in card["auroc_by_iteration"]]        # one row a round
    return spark.createDataFrame(rows, "iteration int, auroc double").withColumn("best_iteration", F.lit(card["best_iteration"]))


@register("published_scoring")
def q_published_scoring(spark, sf_dir):
    """B1 + E1 + S8 + S9: raw records scored by the published bundle, calibrated, with their top features; nothing is fitted."""
    raw = encounters(spark, sf_dir, keep=True)
    b = trained_bundle(spark, sf_dir, prepared_rows(spark, sf_dir, raw))
    src = cleaned(spark, sf_dir, raw).drop("readmitted", "prior_n", "o_orderdate", "score", "patient_nbr")
    s = score.score_batch(src, b.spec, b.scorer(), run_id=b.version)
    return s.select("row_key", "valid", "probability", "risk_band", "top_features")


@register("trained_model_compare")
def q_trained_model_compare(spark, sf_dir):
    """The trained models (logistic, trees, calibrated trees) by split, with differences from the logistic one."""
    b, enc = bundle_and_inputs(spark, sf_dir)
    with small_methods(spark):
        linear = models.fit_logreg(enc.where(F.col("split") == "train"), b.spec.feature_names())
    # the curves read the scores several times
    scored = kept_table(models.score(linear, b.model.score(enc, "gbt"), "logreg").select("split", "label", "logreg", "gbt"), "scored")
    scored = scored.withColumn("gbt_platt", models.calibrated(F.col("gbt"), *b.platt))
    return models.compare(scored, {"logreg": "logreg", "gbt": "gbt", "gbt_platt": "gbt_platt"}, baseline="logreg")


# A fixed literal ensemble: scores and attributions that another engine can compute by hand.
def literal_ensemble():
    import numpy as np

    def tree(left, right, feature, threshold, value, cover):
        return treeshap.Tree(*[np.array(x, dtype=np.int64) for x in (left, right, feature)],
                             *[np.array(x, dtype=float) for x in (threshold, value, cover)])
    a = tree([1, 2, -1, -1, -1], [4, 3, -1, -1, -1], [0, 1, -1, -1, -1], [1.5, 7.5, 0, 0, 0], [0, 0, -0.9, -0.5, 0.3],
             [100, 50, 30, 20, 50])
    b = tree([1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [2, -1, 0, -1, -1], [40.5, 0, 3.5, 0, 0], [0, -0.6, 0, 0.1, 0.8],
             [100, 60, 40, 25, 15])
    return treeshap.TreeScorer(["number_inpatient", "time_in_hospital", "num_medications"], [a, b], [1.0, 0.5], DEMO_PLATT)


@register("tree_ensemble_auroc")
def q_tree_ensemble_auroc(spark, sf_dir):
    """M5: AUROC per iteration of the literal ensemble over the validation split."""
    enc, _ = encoded_cohort(spark, sf_dir)
    s = literal_ensemble()
    per = models.per_iteration_auc(s.trees, s.weights, enc.where(F.col("split") == "val"), s.features)
    return per.select("iteration", _r("auroc"))


@register("tree_scored_batch")
def q_tree_scored_batch(spark, sf_dir):
    """B1 + E1 with a calibrated tree ensemble: probability, band and the top features of every record."""
    raw = encounters(spark, sf_dir, keep=True)
    p = with_split(prepared_cohort(spark, sf_dir, raw))
    spec = fitted_spec(p.where(F.col("split") == "train"))
    src = cleaned(spark, sf_dir, raw).drop("readmitted", "prior_n", "o_orderdate", "score", "patient_nbr")
    s = score.score_batch(src, spec, literal_ensemble())
    top = s.select("row_key", "probability", "risk_band", F.posexplode_outer("top_features").alias("rank", "t"))
    return top.select("row_key", _r("probability"), "risk_band", F.col("rank").cast("int").alias("rank"),
                      F.col("t.feature").alias("feature"), (F.round("t.value", 9) + F.lit(0.0)).alias("value"),
                      F.col("t.feature_value").alias("feature_value"))


def _attach_one_row(df, one_row):
    return with_scalars(df, one_row)


@register("platt_fit")
def q_platt_fit(spark, sf_dir):
    """M7 + M8: Platt coefficients fitted on validation scores, applied to test; calibration in the large."""
    bundle, enc = bundle_and_inputs(spark, sf_dir)
    a, b = bundle.platt
    test = bundle.model.score(enc.where(F.col("split") == "test"))
    test = test.withColumn("calibrated", models.calibrated(F.col("probability_1"), a, b))
    out = metrics.calibration_in_the_large(test, "calibrated")
    return out.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "mean_pred", "observed_rate", "brier")


@register("tune_trials")
def q_tune_trials(spark, sf_dir):
    """M9: 50 trials over the reference's ranges by successive halving, each with its own early stop; M10's choice."""
    enc, names = model_inputs(spark, sf_dir)
    enc = cut_lineage(enc)
    trials = tune.run_trials(spark, enc.where(F.col("split") == "train"), enc.where(F.col("split") == "val"), names, n_trials=50)
    best = tune.best_trial(trials).select(F.col("trial").alias("best_trial"))
    return _attach_one_row(trials, best)


@register("tree_attribution")
def q_tree_attribution(spark, sf_dir):
    """E1 + E3 for the GBT: per test row, log-odds, base, additivity error and the top-5 features."""
    b, enc = bundle_and_inputs(spark, sf_dir)
    scorer = b.scorer()
    attr = scorer.prepare(enc.where(F.col("split") == "test"))
    base = F.lit(scorer.base_value())
    total = F.aggregate("_tree.contributions", F.lit(0.0), lambda a, c: a + c)
    return attr.select("encounter_id", base.alias("base_value"), scorer.margin().alias("log_odds"),
                       F.abs(base + total - scorer.margin()).alias("additivity_error"),
                       explain.top_k(scorer.contributions(), 5).alias("top_features"))


@register("custom_metric_udaf")
def q_custom_metric_udaf(spark, sf_dir):
    """A user-supplied weighted metric (Brier) as a Column aggregate, bootstrapped per age bracket."""
    def weighted_brier(y, p, w):
        return F.sum(w * (p - y) * (p - y)) / F.sum(w)
    c = prep.derive_audit_dimensions(clean_cohort(spark, sf_dir)).where(F.col("age_group").isNotNull())
    reps = bootstrap.bootstrap_metric_columns(c, weighted_brier, group_cols=["age_group"], n_iterations=1000)
    out = reps.groupBy("age_group").agg(F.count("value").alias("replicates"),
                                        F.percentile("value", F.lit(0.025)).alias("ci_low"),
                                        F.percentile("value", F.lit(0.975)).alias("ci_high"))
    return out.select("age_group", "replicates", _r("ci_low"), _r("ci_high"))


@register("custom_metric_states")
def q_custom_metric_states(spark, sf_dir):
    """D1 in (reduce, merge, finish) form: the weighted Brier score by age bracket, one state a task and group."""
    def reduce(y, p, w):
        return np.stack([w.T @ ((p - y) ** 2), w.sum(axis=0)], axis=1)
    c = prep.derive_audit_dimensions(clean_cohort(spark, sf_dir)).where(F.col("age_group").isNotNull())
    reps = user_aggregate.bootstrap_states(c, reduce, lambda s: s[:, 0] / s[:, 1], group_cols=["age_group"], n_iterations=1000)
    out = reps.groupBy("age_group").agg(F.count("value").alias("replicates"), F.percentile("value", F.lit(0.025)).alias("ci_low"),
                                        F.percentile("value", F.lit(0.975)).alias("ci_high"))
    return out.select("age_group", "replicates", _r("ci_low"), _r("ci_high"))


@register("bootstrap_cells")
def q_bootstrap_cells(spark, sf_dir):
    """A22 in cells mode (Poisson(count) per score cell): cost independent of the row count."""
    c = prep.derive_audit_dimensions(clean_cohort(spark, sf_dir))
    return bootstrap.bootstrap_ci(c.where(F.col("age_group").isNotNull()), group_cols=["age_group"],
                                  n_iterations=1000, mode="cells")


@register("stream_scoring")
def q_stream_scoring(spark, sf_dir):
    """Records landed as files, scored by a Structured Streaming query (availableNow), read back."""
    base = os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    p = with_split(prepared_cohort(spark, sf_dir))
    spec = fitted_spec(p.where(F.col("split") == "train"))
    src = cleaned(spark, sf_dir).drop("readmitted", "prior_n", "o_orderdate", "score", "patient_nbr")
    src.write.parquet(os.path.join(base, "in"))
    stream = scoring.record_stream(spark, os.path.join(base, "in"), src.schema, max_files_per_trigger=4)
    q = scoring.write_scores(scoring.score_stream(stream, spec, demo_scorer(platt=True), run_id="batch"),
                             os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(base, "out"))
    return out.select("request_id", "row_key", "valid", F.size("errors").cast("bigint").alias("n_errors"),
                      _r("probability"), "risk_band")


@register("stream_scoring_once")
def q_stream_scoring_once(spark, sf_dir):
    """X1 without duplicates: every record file lands twice, half of them behind a restart from the checkpoint."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/once-{uuid.uuid4().hex}"
    p = with_split(prepared_cohort(spark, sf_dir))
    spec = fitted_spec(p.where(F.col("split") == "train"))
    src = cleaned(spark, sf_dir).drop("readmitted", "prior_n", "o_orderdate", "score", "patient_nbr")
    for _ in range(2):
        src.write.mode("append").parquet(f"{base}/in")
        stream = scoring.once_per_record(scoring.record_stream(spark, f"{base}/in", src.schema, max_files_per_trigger=8))
        scoring.write_scores(scoring.score_stream(stream, spec, demo_scorer(platt=True), run_id="batch"), f"{base}/out", f"{base}/ckpt").awaitTermination()
    out = cut_lineage(spark.read.parquet(f"{base}/out"))
    remove_folder(spark, base)
    return out.select("request_id", "row_key", "valid", F.size("errors").cast("bigint").alias("n_errors"), _r("probability"), "risk_band")


def scoring_log(events):
    """The scoring log with its risk band (P20); the stand-in's probability is the hundredths that ``props`` holds."""
    return events.withColumn("risk_band", C.risk_band(F.regexp_extract("props", r'"k": ?(\d+)', 1).try_cast("double") / 100))


@register("stream_band_rollup")
def q_stream_band_rollup(spark, sf_dir):
    """X2 by risk band and day: count, mean, max and p50/p95/p99 from sketches of 1 % relative error, in append mode, the
    last windows closed by an end-of-stream row."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/bands-{uuid.uuid4().hex}"
    ev = table(spark, sf_dir, "events")
    ev.write.parquet(f"{base}/in")
    for last in (False, True):
        if last:
            end = ev.agg(F.max("ts")).first()[0]
            sketch.end_of_stream(spark, f"{base}/in", ev.schema, (end or dt.datetime(1970, 1, 1)) + dt.timedelta(days=3))
        stream = scoring.event_time(scoring.record_stream(spark, f"{base}/in", ev.schema, max_files_per_trigger=4)).withWatermark("ts", "2 hours")
        scoring.write_scores(sketch.percentile_rollup(scoring_log(stream), "1 day"), f"{base}/out", f"{base}/ckpt").awaitTermination()
    r = cut_lineage(spark.read.parquet(f"{base}/out"))
    remove_folder(spark, base)
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "risk_band", "n", _r("mean_value", 6), "max_value",
                    *[_r(c, 6) for c in ("p50", "p95", "p99")])


@register("manifest_hash")
def q_manifest_hash(spark, sf_dir):
    """S8 + F9: feature count and SHA-256 of the sorted feature-name list of the fitted vocabulary."""
    vocab = features.vocabulary_table(fitted_spec(prepared_cohort(spark, sf_dir)), spark)
    return vocab.agg(F.count("*").cast("bigint").alias("n_features"),
                     C.columns_hash(F.collect_list("feature")).alias("columns_sha256"))


@register("stream_rollup")
def q_stream_rollup(spark, sf_dir):
    """The scoring-log rollup as a Structured Streaming aggregate (watermark, complete mode)."""
    base = os.path.join(checkpoint_dir(spark), f"rollup-{uuid.uuid4().hex}")
    ev = table(spark, sf_dir, "events")
    ev.write.parquet(os.path.join(base, "in"))        # landed files are the stream source
    stream = scoring.record_stream(spark, os.path.join(base, "in"), ev.schema, max_files_per_trigger=4)
    q = scoring.write_complete(scoring.rollup_stream(stream, "1 hour", "2 hours"), os.path.join(base, "out"),
                               os.path.join(base, "ckpt"))
    q.awaitTermination()
    r = cut_lineage(scoring.read_complete(spark, os.path.join(base, "out")))
    remove_folder(spark, base)
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
                    "n", _r("mean_value"), "max_value")


@register("logreg_attribution")
def q_logreg_attribution(spark, sf_dir):
    """E1-E3 for the trained logistic model: top-5 closed-form contributions per test row, with the
    model's own probability and the additivity error against its margin."""
    enc, names = model_inputs(spark, sf_dir)
    train = enc.where(F.col("split") == "train")
    with small_methods(spark):
        m = models.fit_logreg(train, names)
        scorer = explain.from_logistic_model(m, names, train)
    test = models.score(m, enc.where(F.col("split") == "test"))
    total = F.aggregate(scorer.contributions(), F.lit(0.0), lambda a, c: a + c["value"])
    logit = F.log(F.col("probability_1") / (F.lit(1.0) - F.col("probability_1")))
    out = test.select("encounter_id", "probability_1",
                      F.abs(F.lit(scorer.base_value()) + total - logit).alias("additivity_error"),
                      explain.top_k(scorer.contributions(), 5).alias("top_features"))
    return kept_table(out, "attributions")


@register("sample_export")
def q_sample_export(spark, sf_dir):
    """W3 + S7 + B1: records of the test split, picked by the model's own probability: valid rows only
    (P24), varied by diagnosis and age within each selection band (P21), fields outside their vocabulary
    null (P25), as nested JSON {label_internal, fields{...}, expected_band, model_predicted} with nulls kept."""
    raw = kept_table(clean_cohort(spark, sf_dir).select("encounter_id", "patient_nbr", "label", "score", *EXPORT_FIELDS), "cohort")
    prepared = features.prepare(raw)
    enc, _ = encoded_cohort(spark, sf_dir, with_split(prepared))
    predicted = enc.where(F.col("split") == "test").select("encounter_id", demo_scorer(platt=True).probability().alias("p"))
    valid = raw.where(validate.is_valid_row()).select("encounter_id")
    narrow = prepared.select("encounter_id", F.col("diag_1").alias("diag_bucket"), C.age_category(F.col("age")).alias("age_category"))
    # the picks read their candidates four times: one narrow table instead of four deep plans
    with small_methods(spark):
        candidates = cut_lineage(narrow.join(predicted, "encounter_id").join(valid, "encounter_id", "left_semi"))
    picks = sample.diverse_pick(candidates, C.selection_band(F.col("p")),
                                sample.selection_group(F.col("diag_bucket"), F.col("age_category")), n=5)
    fields = prep.clean_vocabulary(raw, {c: validate.VOCABULARIES[c] for c in EXPORT_VOCABULARIES}).select("encounter_id", *EXPORT_FIELDS)
    # at most five picks a band: the cohort is not shuffled for them
    picked = fields.join(F.broadcast(picks.select("encounter_id", "band", "diag_bucket", "age_category", "p")), "encounter_id")
    record = F.struct(C.composite_key(F.col("band"), F.col("age_category"), F.col("diag_bucket")).alias("label_internal"),
                      F.struct(*EXPORT_FIELDS).alias("fields"),
                      C.literal_map(C.EXPECTED_BAND)[F.col("band")].alias("expected_band"),
                      F.round("p", 4).alias("model_predicted"))
    return picked.select("encounter_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


EXPORT_FIELDS = ("race", "gender", "age", "admission_type_id", "discharge_disposition_id", "admission_source_id",
                 "time_in_hospital", "medical_specialty", "num_lab_procedures", "num_procedures", "num_medications",
                 "number_inpatient", "number_diagnoses", "diag_1", "max_glu_serum", "A1Cresult", "insulin")
EXPORT_VOCABULARIES = ("A1Cresult", "max_glu_serum", "insulin", "gender")


@register("tree_importance")
def q_tree_importance(spark, sf_dir):
    """A25 for the GBT: mean |TreeSHAP contribution| per feature over the test split (long form)."""
    b, enc = bundle_and_inputs(spark, sf_dir)
    test = enc.where(F.col("split") == "test")
    return treeshap.mean_contributions(test, b.scorer())
