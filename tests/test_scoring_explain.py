"""Batch scoring, single = batch parity, quarantine, linear and tree attributions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from carescope.operators import explain, score, treeshap
from carescope.plans import queries as Q

SF = "/root/testdata/sf0.001"


def _setup(spark):
    p = Q.with_split(Q.prepared_cohort(spark, SF))
    spec = Q.fitted_spec(p.where(F.col("split") == "train"))
    src = Q.cleaned(spark, SF).drop("readmitted", "prior_n", "o_orderdate", "score", "patient_nbr")
    return spec, src


def test_single_equals_batch(spark):
    spec, src = _setup(spark)
    scorer = Q.demo_scorer(platt=True)
    batch = score.score_batch(src, spec, scorer).where("valid")
    row = batch.first()
    single = score.score_batch(src.where(F.col("encounter_id") == row.row_key), spec, scorer).first()
    assert abs(single.probability - row.probability) <= 1e-6
    assert single.top_features == row.top_features


def test_quarantine_keeps_every_row(spark):
    spec, src = _setup(spark)
    out = score.score_batch(src, spec, Q.demo_scorer())
    assert out.count() == src.count()
    bad = out.where(~F.col("valid"))
    assert bad.count() > 0 and bad.where(F.col("probability").isNotNull()).count() == 0
    assert set(score.audit_log(out).columns) == set(score.AUDIT_COLUMNS)


def test_top_k_sorted_and_clamped(spark):
    spec, src = _setup(spark)
    out = score.score_batch(src, spec, Q.demo_scorer(), top_k=50).where("valid").first()
    vals = [abs(t.value) for t in out.top_features]
    assert len(vals) == len(Q.DEMO_WEIGHTS) and vals == sorted(vals, reverse=True)


def test_linear_additivity(spark):
    enc, _ = Q.encoded_cohort(spark, SF)
    err = explain.additivity_error(enc, Q.demo_scorer()).first()[0]
    assert err < 1e-9


def _brute_force_shap(x, tree, m):
    """Shapley values of the path-dependent conditional expectation (Algorithm 1), by enumeration."""
    def expval(S, node=0):
        if tree.left[node] < 0:
            return tree.value[node]
        f = tree.feature[node]
        l, r = tree.left[node], tree.right[node]
        if f in S:
            return expval(S, l if x[f] <= tree.threshold[node] else r)
        return (expval(S, l) * tree.cover[l] + expval(S, r) * tree.cover[r]) / tree.cover[node]
    phi = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for k in range(len(others) + 1):
            for S in itertools.combinations(others, k):
                wgt = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                phi[i] += wgt * (expval(set(S) | {i}) - expval(set(S)))
    return phi


def test_treeshap_matches_brute_force():
    # depth-3 tree over 3 features, feature 0 used twice on one path
    left = np.array([1, 3, 5, -1, -1, 7, -1, -1, -1])
    right = np.array([2, 4, 6, -1, -1, 8, -1, -1, -1])
    feat = np.array([0, 1, 2, -1, -1, 0, -1, -1, -1])
    thr = np.array([0.5, 0.3, 0.6, 0, 0, 0.8, 0, 0, 0])
    val = np.array([0, 0, 0, 1.0, -2.0, 0, 3.0, 0.5, -1.0])
    cov = np.array([100, 40, 60, 10, 30, 35, 25, 20, 15], dtype=float)
    tree = treeshap.Tree(left, right, feat, thr, val, cov)
    rng = np.random.default_rng(1)
    X = rng.random((20, 3))
    phi = treeshap.tree_shap(X, tree)
    for i in range(len(X)):
        assert np.allclose(phi[i], _brute_force_shap(X[i], tree, 3), atol=1e-10)
    pred = treeshap.tree_predict(X, tree)
    assert np.allclose(phi.sum(1) + tree.expected_value(), pred, atol=1e-10)


def test_skipped_report_and_presentation(spark):
    spec, src = _setup(spark)
    out = score.score_batch(src, spec, Q.demo_scorer())
    rep = score.skipped_report(out)
    assert rep.count() == out.where(~F.col("valid")).count()
    assert all(r.reasons for r in rep.collect())
    pres = score.with_presentation(out.where("valid")).first()
    assert len(pres.top_feature_labels) == 5 and pres.action != ""


def test_text_records_never_fail_the_batch(spark):
    """Records arriving as text: 'five' in an integer field is reported, the batch still scores."""
    spec, src = _setup(spark)
    text = src.select([F.col(c).cast("string").alias(c) for c in src.columns]).limit(20)
    bad = text.withColumn("time_in_hospital",
                          F.when(F.col("encounter_id") == F.lit(str(text.first().encounter_id)), F.lit("five"))
                          .otherwise(F.col("time_in_hospital")))
    out = score.score_batch(bad, spec, Q.demo_scorer()).collect()
    assert len(out) == 20
    flagged = [r for r in out if "time_in_hospital: must be an integer" in r.errors]
    assert len(flagged) == 1 and flagged[0].probability is None


def test_null_lab_encodes_not_measured(spark):
    spec, src = _setup(spark)
    one = src.where(F.col("A1Cresult").isNull()).limit(1)
    enc = spec.transform(__import__("carescope.operators.features", fromlist=["prepare"]).prepare(one))
    row = enc.first()
    assert row["A1Cresult_not_measured"] == 1.0
    assert all(row[n] == 0.0 for n in spec.feature_names() if n.startswith("A1Cresult_") and n != "A1Cresult_not_measured")
