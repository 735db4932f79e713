"""Ranking metrics against an independent numpy computation; blocked prefix sums == window."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from carescope.operators import curves, metrics


def np_auc_ap(y, p):
    order = np.argsort(-p, kind="mergesort")
    y, p = y[order], p[order]
    P, N = y.sum(), (1 - y).sum()
    # rank-based AUROC with ties (Mann-Whitney)
    ranks = pd.Series(p).rank(method="average").to_numpy()
    auroc = (ranks[y == 1].sum() - P * (P + 1) / 2) / (P * N)
    # step-wise AP over distinct thresholds
    ap, tp, fp = 0.0, 0, 0
    for s in np.unique(p)[::-1]:
        m = p == s
        dp, dn = y[m].sum(), (1 - y[m]).sum()
        tp, fp = tp + dp, fp + dn
        ap += dp / P * tp / (tp + fp)
    return auroc, ap


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(800) < 0.15).astype(int)
    p = np.clip(np.round(rng.random(800) * 0.7 + 0.3 * y, 2), 0, 1)   # rounded -> many ties
    g = rng.integers(0, 3, 800)
    pdf = pd.DataFrame({"k": np.arange(800), "label": y, "score": p, "g": g})
    return pdf, spark.createDataFrame(pdf)


def test_auroc_ap_match_numpy(data):
    pdf, df = data
    for strategy in ("window", "blocked"):
        row = metrics.ranking_metrics(df, strategy=strategy).first()
        a, ap = np_auc_ap(pdf.label.to_numpy(), pdf.score.to_numpy())
        assert row.auroc == pytest.approx(a, abs=1e-12)
        assert row.auprc == pytest.approx(ap, abs=1e-12)


def test_grouped_blocked_equals_window(data):
    _, df = data
    w = {r.g: (r.auroc, r.auprc) for r in metrics.ranking_metrics(df, group_cols=["g"], strategy="window").collect()}
    b = {r.g: (r.auroc, r.auprc) for r in metrics.ranking_metrics(df, group_cols=["g"], strategy="blocked").collect()}
    for k in w:
        assert w[k] == pytest.approx(b[k], abs=1e-12)


def test_running_totals_blocked_hot_group(spark):
    # one group holds most scores: blocked prefix sums must equal the plain window
    pdf = pd.DataFrame({"g": [0] * 900 + [1] * 100, "score": np.arange(1000) / 1000.0,
                        "pos": 1, "neg": 2})
    hist = spark.createDataFrame(pdf)
    a = curves.running_totals(hist, ["g"], strategy="window").orderBy("g", "score").toPandas()
    b = curves.running_totals(hist, ["g"], strategy="blocked", n_blocks=7).orderBy("g", "score").toPandas()
    assert (a[["tp", "fp"]].to_numpy() == b[["tp", "fp"]].to_numpy()).all()


def test_best_f1_and_confusion(data):
    pdf, df = data
    y, p = pdf.label.to_numpy(), pdf.score.to_numpy()
    best, thr = -1, None
    for t in np.unique(p):
        pred = p >= t
        tp = (pred & (y == 1)).sum(); fp = (pred & (y == 0)).sum()
        pr = tp / (tp + fp); re = tp / y.sum()
        f1 = 2 * pr * re / (pr + re + 1e-12) if pr + re > 0 else 0
        if round(f1, 12) > round(best, 12):
            best, thr = f1, t
    row = metrics.best_f1(df).first()
    assert row.best_f1 == pytest.approx(best) and row.best_threshold == thr
    c = metrics.confusion_at(df, [0.5]).first()
    pred = p >= 0.5
    assert (c.tp, c.fp, c.tn, c.fn) == ((pred & (y == 1)).sum(), (pred & (y == 0)).sum(),
                                         (~pred & (y == 0)).sum(), (~pred & (y == 1)).sum())


def test_calibration_bins_match_numpy(data):
    pdf, df = data
    p = pdf.score.to_numpy()
    edges = np.linspace(0, 1, 11)
    ids = np.searchsorted(edges[1:-1], p)       # numpy's left-sided search
    got = {r.bin: r.n for r in metrics.calibration_table(df).collect()}
    want = pd.Series(ids).value_counts().to_dict()
    assert got == want


def test_exact_percentiles_match_numpy(spark):
    from carescope.operators.quantiles import exact_percentiles
    rng = np.random.default_rng(3)
    vals = np.round(rng.exponential(50, 3000), 1)           # many ties
    grp = rng.integers(0, 3, 3000)
    df = spark.createDataFrame(pd.DataFrame({"g": grp, "v": vals}))
    probs = [0.0, 0.5, 0.95, 0.99, 1.0]
    for strategy in ("window", "blocked"):
        got = {(r.g, r.p): r.percentile for r in exact_percentiles(df, "v", probs, ["g"], strategy).collect()}
        for gv in range(3):
            for p in probs:
                assert got[(gv, p)] == pytest.approx(np.percentile(vals[grp == gv], 100 * p), abs=1e-9)


def test_null_group_is_a_group_in_every_strategy(spark):
    rng = np.random.default_rng(11)
    n = 2000
    g = np.where(rng.random(n) < 0.3, None, rng.choice(["a", "b"], n))
    y = (rng.random(n) < 0.2).astype(int)
    p = np.round(rng.random(n), 3)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "label": y, "score": p}).astype({"g": object}),
                               "g string, label long, score double")
    w = {r.g: (r.auroc, r.auprc) for r in metrics.ranking_metrics(df, group_cols=["g"], strategy="window").collect()}
    b = {r.g: (r.auroc, r.auprc) for r in metrics.ranking_metrics(df, group_cols=["g"], strategy="blocked").collect()}
    assert None in w and set(w) == set(b)
    for k in w:
        assert w[k] == pytest.approx(b[k], abs=1e-12)
    bf = {r.g: r.best_f1 for r in metrics.best_f1(df, group_cols=["g"]).collect()}
    assert None in bf
