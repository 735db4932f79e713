"""Model operators (M2-M8): weights, early-stopping curve, Platt, logistic mapping sanity."""

import pytest
from pyspark.sql import functions as F

from carescope.operators import metrics, models
from carescope.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    enc, names = Q.model_inputs(spark, SF)
    m = models.fit_gbt(enc.where(F.col("split") == "train"), names, max_iter=8, max_depth=3, min_instances=5)
    return enc, names, m


def test_class_weights_balance(spark):
    enc, _ = Q.model_inputs(spark, SF)
    w = models.class_weight_table(enc).collect()
    total = sum(r.n for r in w)
    assert all(abs(r.weight - total / (2 * r.n)) < 1e-12 for r in w)
    assert abs(sum(r.n * r.weight for r in w) - total) < 1e-6


def test_per_iteration_auc_last_equals_model(spark, fitted):
    from carescope.operators.treeshap import gbt_trees
    enc, names, m = fitted
    val = enc.where(F.col("split") != "train")
    trees, weights = gbt_trees(m.stages[-1], spark)
    per = models.per_iteration_auc(trees, weights, val, names).orderBy("iteration").collect()
    assert [r.iteration for r in per] == list(range(1, 9))
    full = metrics.ranking_metrics(models.score(m, val), "probability_1", strategy="window").first().auroc
    assert per[-1].auroc == pytest.approx(full, abs=1e-12)


def test_trained_calibrated_model_scores_batches_and_streams(spark, fitted, tmp_path):
    from carescope.operators import explain, score
    from carescope.operators.treeshap import tree_scorer
    from carescope.streaming import scoring
    enc, names, m = fitted
    composite = models.CalibratedModel(m, *models.fit_platt(models.score(m, enc.where(F.col("split") != "train"))))
    composite.save(str(tmp_path / "model"))
    loaded = models.CalibratedModel.load(str(tmp_path / "model"))
    assert explain.explain_base_stage(loaded).__class__.__name__ == "GBTClassificationModel"
    _, spec = Q.encoded_cohort(spark, SF)
    src = Q.cleaned(spark, SF).drop("readmitted", "prior_n", "o_orderdate", "score", "patient_nbr")
    scorer = tree_scorer(loaded, names, spark)
    batch = {r.row_key: r for r in score.score_batch(src, spec, scorer).collect()}
    want = {r.encounter_id: r.probability_1 for r in loaded.transform(enc).collect()}
    both = [k for k in want if batch[k].valid]
    assert both and all(abs(batch[k].probability - want[k]) < 1e-6 for k in both)
    assert all(len(batch[k].top_features) == 5 for k in both)
    one = score.score_batch(src.where(F.col("encounter_id") == both[0]), spec, scorer).first()
    assert abs(one.probability - batch[both[0]].probability) < 1e-12 and one.top_features == batch[both[0]].top_features
    src.limit(200).write.parquet(str(tmp_path / "in"))
    stream = scoring.record_stream(spark, str(tmp_path / "in"), src.schema)
    scoring.write_scores(scoring.score_stream(stream, spec, scorer), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(streamed) == 200
    assert all(r.probability is None or abs(r.probability - batch[r.row_key].probability) < 1e-6 for r in streamed)
    # base + sum of all contributions = log-odds
    wide = scorer.prepare(spec.transform(Q.prepared_cohort(spark, SF), keep=["encounter_id"]))
    total = F.aggregate("_tree.contributions", F.lit(0.0), lambda x, y: x + y) + F.lit(scorer.base_value())
    assert wide.select(F.max(F.abs(total - scorer.margin()))).first()[0] < 1e-6


def test_platt_improves_calibration(fitted):
    enc, _, m = fitted
    val = models.score(m, enc.where(F.col("split") != "train"))
    a, b = models.fit_platt(val)
    cal = val.withColumn("c", models.calibrated(F.col("probability_1"), a, b))
    row = cal.agg(F.avg("c").alias("mc"), F.avg("label").alias("y"), F.avg("probability_1").alias("mp")).first()
    # balanced class weights push raw probabilities up; Platt brings the mean back to the base rate
    assert abs(row.mc - row.y) < abs(row.mp - row.y)


def test_model_save_load_round_trip(fitted, tmp_path):
    from carescope.sources import io
    enc, _, m = fitted
    path = str(tmp_path / "gbt")
    io.save_model(m, path)
    back = io.load_model(path)
    test = enc.where(F.col("split") == "test")
    a = {r.encounter_id: r.probability_1 for r in models.score(m, test).collect()}
    b = {r.encounter_id: r.probability_1 for r in models.score(back, test).collect()}
    assert a == b


def test_search_best_and_refit(spark):
    from carescope.operators import split, tune
    enc, names = Q.model_inputs(spark, SF)
    trials = tune.run_trials(spark, enc.where(F.col("split") == "train"), enc.where(F.col("split") == "val"),
                             names, n_trials=5, parallelism=3, patience=5, most=40)
    rows = trials.collect()
    best = tune.best_trial(trials).first()
    assert best.val_auroc == max(r.val_auroc for r in rows) and 1 <= best.best_iteration <= 40
    assert {r.state for r in rows} <= {"running", "stopped", "pruned"} and all(r.rounds >= r.best_iteration for r in rows)
    assert sum(r.rounds > 25 for r in rows) <= 2                     # the better third of five goes on
    model = tune.refit(split.union_splits(enc), names, tune.parse_params(best.params), best.best_iteration)
    assert len(model.trees) == best.best_iteration                   # the frozen number of rounds


def test_search_outlives_a_failing_trial(spark, monkeypatch):
    from carescope.operators import boosting, tune
    enc, names = Q.model_inputs(spark, SF)
    real, seen = boosting.run_rounds, []

    def run(data, params, patience, **more):
        seen.append((params.rounds, spark.sparkContext.getLocalProperty("spark.scheduler.pool"),
                     spark.sparkContext.getLocalProperty("spark.jobGroup.id")))
        if params.learning_rate == tune.sample_trials(4)[1]["learning_rate"]:
            raise RuntimeError("lost")
        return real(data, params, patience, **more)
    monkeypatch.setattr(boosting, "run_rounds", run)
    trials = tune.search(spark, enc.where("split = 'train'"), enc.where("split = 'val'"), names, n_trials=4, parallelism=2, patience=3, most=6)
    assert [t.state for t in trials].count("failed") == 1 and trials[1].state == "failed"
    assert all(t.history for t in trials if t.state != "failed")
    assert len({pool for _, pool, _ in seen}) == 4 and all(pool == group for _, pool, group in seen)     # a pool and a job group a trial
    assert tune.best_trial(tune.trial_table(spark, trials)).first().trial != 1


def test_rungs_and_ranges():
    from carescope.operators import tune
    assert tune.rungs() == [25, 75, 225, 675, 2000]
    for p in tune.sample_trials(200):
        assert all(low <= p[k] <= high for k, (_, low, high) in tune.SPACE.items())
        assert tune.parse_params({k: str(v) for k, v in p.items()}) == p


def test_best_iteration_patience(spark):
    rows = [(1, 0.60), (2, 0.62), (3, 0.61), (4, 0.615), (5, 0.63)]
    df = spark.createDataFrame(rows, "iteration int, auroc double")
    assert models.best_iteration(df, patience=2) == 2      # stops at 4: two rounds without improvement
    assert models.best_iteration(df, patience=5) == 5


def test_registered_fits_are_the_whole_job(spark, monkeypatch):
    """Queries share one published fit at the operators' defaults."""
    from carescope.operators import boosting, tune
    asked, boosted, logreg = [], boosting.fit_boosted, models.fit_logreg

    def fit(train, names, **params):
        asked.append(("gbt", sorted(params)))
        return boosted(train, names, params=boosting.BoostParams(rounds=3), **params)

    def logistic(train, names, **params):
        asked.append(("logreg", sorted(params)))
        return logreg(train, names, max_iter=2)

    def search(spark_, train, valid, names, **params):
        asked.append(("search", sorted(params.items())))
        return spark.createDataFrame([(0, {}, 0.5, 1, 1, "stopped")], tune.TRIALS)
    monkeypatch.setattr(boosting, "fit_boosted", fit)
    monkeypatch.setattr(models, "fit_logreg", logistic)
    monkeypatch.setattr(tune, "run_trials", search)
    monkeypatch.setattr(Q, "_PUBLISHED", {})
    for name in ("gbt_scores", "early_stop", "platt_fit", "tree_attribution", "tree_importance", "published_scoring", "logreg_scores",
                 "logreg_attribution", "trained_model_compare", "tune_trials"):
        assert Q.REGISTRY[name](spark, SF).columns
    assert asked == [("gbt", ["valid"])] + [("logreg", [])] * 3 + [("search", [("n_trials", 50)])]


def test_trained_queries_agree(spark):
    from carescope.operators import boosting
    d = SF
    Q._PUBLISHED.pop((spark.sparkContext.applicationId, d), None)
    scores = {r.encounter_id: r for r in Q.REGISTRY["gbt_scores"](spark, d).collect()}
    rounds = {r.iteration: r for r in Q.REGISTRY["early_stop"](spark, d).collect()}
    best = rounds[1].best_iteration
    assert boosting.stop_at([(i, r.auroc) for i, r in rounds.items()], 50)[0] == best
    attributed = Q.REGISTRY["tree_attribution"](spark, d).collect()
    assert attributed and all(r.additivity_error < 1e-9 and len(r.top_features) == 5 for r in attributed)
    for r in attributed:
        assert r.log_odds == pytest.approx(-__import__("math").log(1 / scores[r.encounter_id].probability_1 - 1), abs=1e-9)
    compared = {(r.model, r.split): r for r in Q.REGISTRY["trained_model_compare"](spark, d).collect()}
    assert compared["gbt", "test"].auroc == pytest.approx(compared["gbt_platt", "test"].auroc, abs=1e-9)
    importance = Q.REGISTRY["tree_importance"](spark, d).collect()
    assert len(importance) > 10 and all(r.mean_abs_contribution >= 0 for r in importance)


def test_kept_encounters_are_the_encounters_and_hold_no_window(spark):
    from carescope.sources.fixtures import encounters
    sf = "/root/testdata/sf0.001"
    kept = encounters(spark, sf, keep=True)
    assert "Window" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, kept.collect())) == sorted(map(str, encounters(spark, sf).collect()))
    assert kept.columns == encounters(spark, sf).columns
    enc, _ = Q.encoded_cohort(spark, sf)
    assert "Window" not in enc._jdf.queryExecution().executedPlan().toString()      # several passes, one computation
