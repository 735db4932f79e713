"""User aggregates in two phases (D1): against built-in metrics, the bootstrap's replicates, awkward groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from carescope.operators import bootstrap, metrics
from carescope.operators import user_aggregate as U


def user_auroc():
    # defined inside, so that tasks get the functions themselves
    def counts(rows):
        out = {}
        for s, y in zip(rows["score"], rows["label"]):
            p, n = out.get(s, (0, 0))
            out[s] = (p + y, n + 1 - y)
        return out

    def joined(a, b):
        return {s: tuple(np.add(a.get(s, (0, 0)), b.get(s, (0, 0)))) for s in {*a, *b}}

    def auroc(state):
        tp = up = P = N = 0
        for s in sorted(state, reverse=True):
            p, n = state[s]
            up, tp, P, N = up + n * tp + 0.5 * n * p, tp + p, P + p, N + n
        return {"auroc": up / (P * N) if P * N else None, "n": int(P + N)}
    return U.UserAggregate(counts, joined, auroc)


AUROC = user_auroc()


@pytest.mark.parametrize("held", [10_000, 1])
def test_auroc_as_a_user_metric(spark, monkeypatch, held):
    monkeypatch.setattr(U, "HELD", held)
    df = spark.range(2000).selectExpr("case when id % 4 = 3 then null else cast(id % 4 as string) end as g", "cast(id * 7919 % 3 = 0 as int) as label",
                                      "cast(id * 104729 % 50 as double) / 50 as score").repartition(9)
    got = {r.g: (r.auroc, r.n) for r in U.aggregate_by(df, ["g"], ["score", "label"], AUROC, "auroc double, n bigint").collect()}
    want = {r.g: r.auroc for r in metrics.ranking_metrics(df, group_cols=["g"]).collect()}
    assert set(got) == {"0", "1", "2", None} and all(n == 500 for _, n in got.values())
    assert all(got[g][0] == pytest.approx(want[g], abs=1e-12) for g in want)
    (whole,) = U.aggregate_by(df, [], ["score", "label"], AUROC, "auroc double, n bigint").collect()
    assert whole.auroc == pytest.approx(metrics.ranking_metrics(df).first().auroc, abs=1e-12) and whole.n == 2000
    assert U.aggregate_by(df.where("false"), ["g"], ["score", "label"], AUROC, "auroc double, n bigint").collect() == []


def test_bootstrap_states_are_the_replicates_of_the_column_form(spark):
    df = spark.range(700).selectExpr("id as encounter_id", "cast(id % 5 = 0 as int) as label", "cast(id * 31 % 97 as double) / 97 as score",
                                     "cast(id % 2 as string) as g").repartition(5)

    def reduce(y, p, w):
        return np.stack([w.T @ ((p - y) ** 2), w.sum(axis=0)], axis=1)
    got = {(r.g, r.replicate): r.value for r in U.bootstrap_states(df, reduce, lambda s: s[:, 0] / s[:, 1], group_cols=["g"], n_iterations=30).collect()}
    brier = bootstrap.bootstrap_metric_columns(df, lambda y, p, w: F.sum(w * (p - y) * (p - y)) / F.sum(w), group_cols=["g"], n_iterations=30)
    want = {(r.g, r.replicate): r.value for r in brier.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
