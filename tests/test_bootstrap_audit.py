"""Bootstrap CI properties and subgroup audit rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from carescope.operators import audit, bootstrap, metrics


@pytest.fixture(scope="module")
def boot_df(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(800) < 0.15).astype(int)
    p = np.clip(rng.random(800) * 0.7 + 0.3 * y, 0, 1)
    return spark.createDataFrame(pd.DataFrame({"encounter_id": np.arange(800), "label": y, "score": p}))


def test_ci_brackets_point(boot_df):
    point = metrics.ranking_metrics(boot_df).first().auroc
    ci = bootstrap.bootstrap_ci(boot_df, n_iterations=200).first()
    assert ci.auroc_ci_low <= point <= ci.auroc_ci_high
    assert ci.skipped == 0


def test_width_shrinks_with_data(spark, boot_df):
    small = boot_df.where(F.col("encounter_id") < 200)
    w_small = bootstrap.bootstrap_ci(small, n_iterations=200).first()
    w_big = bootstrap.bootstrap_ci(boot_df, n_iterations=200).first()
    assert (w_big.auroc_ci_high - w_big.auroc_ci_low) < (w_small.auroc_ci_high - w_small.auroc_ci_low)


def test_cells_mode_close_to_rows_mode(boot_df):
    a = bootstrap.bootstrap_ci(boot_df, n_iterations=300).first()
    b = bootstrap.bootstrap_ci(boot_df, n_iterations=300, mode="cells").first()
    assert abs(a.auroc_ci_low - b.auroc_ci_low) < 0.03 and abs(a.auroc_ci_high - b.auroc_ci_high) < 0.03


def test_unreliable_ci_is_null(spark):
    # 200 rows with 2 positives: many single-class replicates -> CI suppressed
    pdf = pd.DataFrame({"encounter_id": np.arange(200), "label": [1, 1] + [0] * 198,
                        "score": np.linspace(0, 1, 200)})
    ci = bootstrap.bootstrap_ci(spark.createDataFrame(pdf), n_iterations=200).first()
    assert ci.skipped > 20 and ci.auroc_ci_low is None


def test_subgroup_skip_rules(spark):
    rows = [(i, "big", i % 5 == 0 and 1 or 0, (i % 17) / 17.0) for i in range(200)]
    rows += [(1000 + i, "small", i % 2, 0.5) for i in range(30)]          # n < 50
    rows += [(2000 + i, "fewpos", int(i < 3), i / 100.0) for i in range(100)]  # < 5 positives
    rows += [(3000 + i, None, 1, 0.3) for i in range(60)]                  # null subgroup
    df = spark.createDataFrame(rows, "encounter_id long, subgroup string, label int, score double")
    out = audit.subgroup_metrics(df).collect()
    assert [r.subgroup for r in out] == ["big"] and out[0].n == 200


def test_multi_audit_and_disparity(spark):
    from __spark_entry__ import queries
    df = queries()["multi_audit"](spark, "/root/testdata/sf0.001")
    dims = {r.dimension for r in df.collect()}
    assert dims <= {"age_group", "gender", "race", "admission_type"} and "age_group" in dims
    assert all(r.subgroup != "Unknown/Invalid" for r in df.collect())


def test_hot_subgroup_blocked_equals_window(spark):
    # one subgroup holds most rows and distinct scores: the blocked prefix sum must agree exactly
    rng = np.random.default_rng(5)
    n = 6000
    sub = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b"], n))
    y = (rng.random(n) < 0.2).astype(int)
    p = np.round(rng.random(n) * 0.8 + 0.2 * y, 4)
    df = spark.createDataFrame(pd.DataFrame({"encounter_id": np.arange(n), "subgroup": sub, "label": y, "score": p}))
    w = {r.subgroup: tuple(r) for r in audit.subgroup_metrics(df, strategy="window").collect()}
    b = {r.subgroup: tuple(r) for r in audit.subgroup_metrics(df, strategy="blocked").collect()}
    assert w == b and set(w) == {"hot", "a", "b"}


def test_diverse_pick_salting_is_exact(spark):
    from carescope.functions import columns as C
    from carescope.operators import sample
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"encounter_id": np.arange(n), "score": rng.random(n) * 0.5,
                        "grp": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcdef"), n))})
    df = spark.createDataFrame(pdf)
    one = sample.diverse_pick(df, C.selection_band(F.col("score")), F.col("grp"), n=5, salts=1)
    many = sample.diverse_pick(df, C.selection_band(F.col("score")), F.col("grp"), n=5, salts=16)
    cols = ["band", "pick_order", "encounter_id", "grp", "group_rank", "group_size"]
    assert sorted(map(tuple, one.select(cols).collect())) == sorted(map(tuple, many.select(cols).collect()))
    assert one.count() == 4 * 5          # four selection bands cover [0, 0.5), five picks each


def test_custom_metric_column_form_equals_pandas_form(boot_df):
    def brier_np(y, p, w):
        return float(np.sum(w * (p - y) ** 2) / np.sum(w))

    def brier_col(y, p, w):
        return F.sum(w * (p - y) * (p - y)) / F.sum(w)
    a = {r.replicate: r.value for r in bootstrap.bootstrap_custom_metric(boot_df, brier_np, n_iterations=40).collect()}
    b = {r.replicate: r.value for r in bootstrap.bootstrap_metric_columns(boot_df, brier_col, n_iterations=40).collect()}
    assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_unreliable_ci_kept_when_not_suppressed(spark):
    pdf = pd.DataFrame({"encounter_id": np.arange(200), "label": [1, 1] + [0] * 198,
                        "score": np.linspace(0, 1, 200)})
    ci = bootstrap.bootstrap_ci(spark.createDataFrame(pdf), n_iterations=200, suppress_unreliable=False).first()
    assert ci.unreliable and ci.auroc_ci_low is not None


def test_subgroup_metrics_with_ci(spark):
    from __spark_entry__ import queries  # noqa: F401
    from carescope.plans import queries as Q
    from carescope.operators import prep
    c = prep.derive_audit_dimensions(Q.clean_cohort(spark, "/root/testdata/sf0.001")).withColumnRenamed(
        "age_group", "subgroup")
    out = audit.subgroup_metrics(c, with_ci=True, n_iterations=100).collect()
    assert out and all(r.auroc_ci_low is None or r.auroc_ci_low <= r.auroc + 1e-3 for r in out)


def tied(spark, n=4000, scores=1):
    """Labels in order of the key, so that blocks differ, and few scores."""
    return spark.createDataFrame([(i, int(i < n // 4), float(i % scores) / 8) for i in range(n)], "encounter_id long, label int, score double")


@pytest.mark.parametrize("mode", ["rows", "cells", "exact"])
def test_one_score_is_one_tie_over_any_blocks(spark, mode):
    reps = bootstrap.replicate_metrics(tied(spark), n_iterations=20, mode=mode).collect()
    assert len(reps) == 21 and all(r.auroc == pytest.approx(0.5, abs=1e-12) for r in reps)
    point = metrics.ranking_metrics(tied(spark)).first()
    assert [r for r in reps if r.replicate == 20][0].auprc == pytest.approx(point.auprc, abs=1e-12)


@pytest.mark.parametrize("scores", [2, 3, 40])
@pytest.mark.parametrize("parts", [2, 16])
def test_few_scores_over_many_blocks(spark, scores, parts):
    """Every replicate against the metric of its weighted rows, computed from the weights themselves."""
    df = tied(spark, 900, scores)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.replicate: r for r in bootstrap.replicate_metrics(df, n_iterations=8).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    w = bootstrap.replicate_weights(df, "encounter_id", 8).toPandas()
    for rep, part in w.groupby("replicate"):
        cells = part.assign(p=part.w * part.label, n=part.w * (1 - part.label)).groupby("score")[["p", "n"]].sum().sort_index(ascending=False)
        tp, fp = cells.p.cumsum(), cells.n.cumsum()
        P, N = cells.p.sum(), cells.n.sum()
        assert got[rep].auroc == pytest.approx((cells.n * (tp - cells.p) + 0.5 * cells.n * cells.p).sum() / (P * N), abs=1e-12)
        assert got[rep].auprc == pytest.approx((cells.p * tp / (tp + fp)).sum() / P, abs=1e-12)
        assert got[rep]["size"] == P + N


def test_exact_draws_have_size_n_and_do_not_depend_on_partitions(spark, boot_df, monkeypatch):
    monkeypatch.setattr(bootstrap, "UNITS_AT_ONCE", 64)
    df = boot_df.withColumn("g", (F.col("encounter_id") % 3).cast("string")).withColumn("score", F.round("score", 1))
    sizes = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in ("2", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append({(r.g, r.replicate): (r.auroc, r.auprc, r["size"]) for r in
                    bootstrap.replicate_metrics(df, group_cols=["g"], n_iterations=40, mode="exact").collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(size == sizes[g] for (g, _), (_, _, size) in got[0].items())
    assert got[0].keys() == got[1].keys() and all(a == pytest.approx(b, abs=1e-12) for a, b in zip(
        (got[0][k] for k in sorted(got[0])), (got[1][k] for k in sorted(got[1]))))


def test_split_draws_add_up_and_are_binomial():
    total, size, b = 1000, 64, 4000
    chunks = [bootstrap.split_draws([7], b, total, size, k) for k in range(-(-total // size))]
    assert (np.sum(chunks, axis=0) == total).all()
    for k, m in enumerate(chunks):
        share = (min(total, (k + 1) * size) - k * size) / total
        assert abs(m.mean() - total * share) < 5 * np.sqrt(total * share * (1 - share) / b)
        assert m.var() == pytest.approx(total * share * (1 - share), rel=0.15)


def test_exact_interval_is_close_to_the_poisson_one(boot_df):
    a = bootstrap.bootstrap_ci(boot_df, n_iterations=300).first()
    b = bootstrap.bootstrap_ci(boot_df, n_iterations=300, mode="exact").first()
    assert a.auroc == b.auroc and abs(a.auroc_ci_low - b.auroc_ci_low) < 0.02 and abs(a.auroc_ci_high - b.auroc_ci_high) < 0.02


def test_many_digests_at_once_equal_the_library():
    import hashlib
    heads = [h.encode() for h in ("42:1:", "42:22:", "42:é:", "42:" + "x" * 48 + ":", "42:" + "y" * 70 + ":", "")]
    tails = [str(k).encode() for k in range(120)]
    got = bootstrap.md5_words(heads, tails)
    for i, h in enumerate(heads):
        assert [got[i, j].astype(">u4").tobytes() for j in range(120)] == [hashlib.md5(h + t).digest() for t in tails]


def test_metric_columns_send_cells_not_pairs(spark):
    """Nulls, NaN and repeated keys; the plan below the metric holds no row a (row, replicate) pair."""
    rows = [(k % 40 if k % 9 else None, [0.25, 0.5, None, float("nan")][k % 4], [0, 1, 1, None, 0][k % 5], "ab"[k % 2] if k % 7 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "encounter_id int, score double, label int, g string")
    count = lambda y, p, w: F.sum(F.when(~F.isnan(p) & y.isNotNull(), w * (p + y)))
    got = bootstrap.bootstrap_metric_columns(df, count, group_cols=["g"], n_iterations=10)
    pairs = bootstrap.replicate_weights(df, "encounter_id", 10)
    y, p, w = F.col("label").cast("double"), F.col("score"), F.col("w").cast("double")
    want = pairs.groupBy("g", "replicate").agg(F.when(F.max(y) > F.min(y), count(y, p, w)).alias("value"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "md5" not in plan.lower()


def test_crowded_scores_have_entries_of_their_own(spark):
    """Scores that many rows of a block share are drawn once; every replicate against its weighted rows."""
    scores = pd.Series([9.0] * 5 + [8.0] * 1100 + [7.0] * 40 + [6.5] * 3 + [6.0] * 1024 + [5.0] * 7 + [4.0] * 5)
    assert bootstrap._runs(scores) == {7.0: 7.0, 6.5: 7.0, 5.0: 5.0}
    assert bootstrap._runs(scores[:5]) == bootstrap._runs(scores[:1105]) == {}
    n, rng = len(scores), np.random.default_rng(3)
    y = (rng.random(n) < 0.3).astype(int)
    pdf = pd.DataFrame({"encounter_id": np.arange(n), "label": y, "score": scores})
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        reps = {r.replicate: r for r in bootstrap.replicate_metrics(spark.createDataFrame(pdf), n_iterations=12).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    w = np.concatenate((bootstrap.poisson_weights([f"42:{k}:" for k in range(n)], 12), np.ones((n, 1))), axis=1).astype(float)
    for r in range(13):
        up = ap = tp = fp = 0.0
        for s in sorted(set(scores), reverse=True):
            p, q = (w[(scores == s) & (y == v), r].sum() for v in (1, 0))
            up, ap = up + q * tp + 0.5 * q * p, ap + (p * (tp + p) / (tp + p + fp + q) if p else 0.0)
            tp, fp = tp + p, fp + q
        assert reps[r].auroc == pytest.approx(up / (tp * fp), abs=1e-12) and reps[r].auprc == pytest.approx(ap / tp, abs=1e-12)
        assert reps[r]["size"] == tp + fp
