"""Leaf-wise boosting (M4, M5): trees against brute force, early stop in one run, going on, saving."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from carescope.operators import boosting as B
from carescope.operators import metrics

P = B.BoostParams(rounds=6, learning_rate=0.3, num_leaves=6, min_child_samples=5, l1=0.1, l2=0.1)


def data(seed=0, n=600):
    rng = np.random.default_rng(seed)
    X = np.stack([rng.normal(size=n), rng.integers(0, 5, n), rng.integers(0, 2, n), rng.exponential(size=n).round(1)], axis=1)
    y = (rng.random(n) < 1 / (1 + np.exp(-(X[:, 0] + (X[:, 1] > 2) * X[:, 2] - 0.5)))).astype(int)
    return pd.DataFrame({**{f"f{j}": X[:, j] for j in range(4)}, "label": y, "weight": 1.0 + y, "part": rng.random(n)})


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(data()).repartition(5)


NAMES = ["f0", "f1", "f2", "f3"]


def brute_tree(X, g, h, edges, p):
    """Best leaf first, every split of every leaf tried directly."""
    def best(idx, depth):
        found = None
        if 0 <= p.max_depth <= depth:
            return None
        gain0 = float(B.soft(g[idx].sum(), p.l1) ** 2 / (h[idx].sum() + p.l2))
        for f, e in enumerate(edges):
            for cut in e:
                left, right = idx[X[idx, f] <= cut], idx[X[idx, f] > cut]
                if min(len(left), len(right)) < p.min_child_samples or min(h[left].sum(), h[right].sum()) < p.min_child_weight:
                    continue
                gain = sum(float(B.soft(g[s].sum(), p.l1) ** 2 / (h[s].sum() + p.l2)) for s in (left, right)) - gain0
                if gain > 0 and (found is None or gain > found[0] + 1e-12):
                    found = (gain, f, cut, left, right)
        return found
    leaves = [(np.arange(len(X)), 0)]
    splits = [best(*leaves[0])]
    used = []
    while len(leaves) < p.num_leaves and any(splits):
        k = max((i for i, s in enumerate(splits) if s), key=lambda i: splits[i][0])
        gain, f, cut, left, right = splits[k]
        used.append((f, round(cut, 12), len(left), len(right)))
        d = leaves[k][1] + 1
        leaves[k:k + 1] = [(left, d), (right, d)]
        splits[k:k + 1] = [best(left, d), best(right, d)]
    return used, [(i, B.leaf_value(g[i].sum(), h[i].sum(), p)) for i, _ in leaves]


@pytest.mark.parametrize("local_rows", [0, 90, 10_000])
@pytest.mark.parametrize("params", [P, B.replace(P, max_depth=2, l2=3.0), B.replace(P, num_leaves=31, min_child_samples=20, l1=1.0)])
def test_trees_equal_brute_force(rows, params, local_rows, monkeypatch):
    monkeypatch.setattr(B, "PART_BYTES", 8_000)          # several partitions
    model, history = B.fit_boosted(rows, NAMES, params=params, refresh=4, local_rows=local_rows)
    pdf = rows.toPandas()
    X, y, w = pdf[NAMES].to_numpy(float), pdf["label"].to_numpy(float), pdf["weight"].to_numpy()
    assert history == [] and len(model.trees) == params.rounds
    assert model.init == pytest.approx(np.log((w * y).sum() / (w * (1 - y)).sum()))
    margin = np.full(len(X), model.init)
    for tree in model.trees:
        used, leaves = brute_tree(X, *B.gradients(y, w, margin), model.edges, params)
        inner = [i for i in range(len(tree.left)) if tree.left[i] >= 0]
        got = sorted((int(tree.feature[i]), round(float(tree.threshold[i]), 12), int(tree.cover[tree.left[i]]), int(tree.cover[tree.right[i]])) for i in inner)
        assert got == sorted(used)
        want = np.empty(len(X))
        for idx, value in leaves:
            want[idx] = value
        step = B.tree_predict(X, tree)
        assert np.allclose(step, want, atol=1e-12)
        margin = margin + step


def test_same_trees_for_any_partitioning(rows):
    a, _ = B.fit_boosted(rows, NAMES, params=B.replace(P, bagging_fraction=0.7, bagging_freq=2, feature_fraction=0.5))
    b, _ = B.fit_boosted(rows.repartition(2), NAMES, params=B.replace(P, bagging_fraction=0.7, bagging_freq=2, feature_fraction=0.5))
    for x, y in zip(a.trees, b.trees):
        assert all(np.array_equal(getattr(x, n), getattr(y, n)) for n in ("left", "feature", "threshold", "value", "cover"))


def test_bags_hold_their_share(rows):
    model, _ = B.fit_boosted(rows, NAMES, params=B.replace(P, bagging_fraction=0.5, bagging_freq=1))
    shares = [t.cover[0] / 600 for t in model.trees]
    assert all(0.4 < s < 0.6 for s in shares) and len(set(shares)) > 1


def test_early_stop_fires_in_one_run(rows):
    train, valid = rows.where("part < 0.7"), rows.where("part >= 0.7")
    model, history = B.fit_boosted(train, NAMES, params=B.replace(P, rounds=200, num_leaves=31, min_child_samples=2), valid=valid, patience=4, refresh=3)
    by = dict(history)
    best = len(model.trees)
    assert best < 200 and max(by) < best + 4 + 3                       # ended within a block of the rule
    assert round(by[best], 12) == max(round(a, 12) for i, a in by.items() if i <= best + 4)
    exact = metrics.ranking_metrics(model.score(valid), "probability_1").first().auroc
    assert by[best] == pytest.approx(exact, abs=1e-12)                 # no grid


def test_fit_goes_on_from_an_ensemble(rows, tmp_path):
    whole, _ = B.fit_boosted(rows, NAMES, params=B.replace(P, rounds=7), refresh=2)
    half, _ = B.fit_boosted(rows, NAMES, params=B.replace(P, rounds=3), refresh=2)
    half.save(str(tmp_path / "m"))
    on, _ = B.fit_boosted(rows, NAMES, params=B.replace(P, rounds=7), start=B.BoostedTrees.load(str(tmp_path / "m")))
    assert len(on.trees) == 7
    for x, y in zip(whole.trees, on.trees):
        assert np.array_equal(x.feature, y.feature) and np.allclose(x.value, y.value, atol=1e-12)
    with pytest.raises(ValueError):
        B.fit_boosted(rows, NAMES[:2], start=half)


def test_pruning_callback_ends_the_run(rows):
    seen = []
    model, _ = B.fit_boosted(rows.where("part < 0.7"), NAMES, params=B.replace(P, rounds=50), valid=rows.where("part >= 0.7"), refresh=5,
                             on_block=lambda n, h: seen.append(n) or n < 10)
    assert seen == [5, 10] and len(model.trees) <= 10


def test_scores_attributions_and_saved_form(spark, rows, tmp_path):
    model, _ = B.fit_boosted(rows, NAMES, params=P)
    X = rows.select(*NAMES).toPandas().to_numpy(float)
    got = model.score(rows.select(*NAMES)).toPandas()
    assert np.allclose(got["probability_1"], 1 / (1 + np.exp(-model.margins(got[NAMES].to_numpy(float)))), atol=1e-12)
    s = model.scorer((2.0, -1.0))
    wide = s.prepare(rows).select(s.margin().alias("m"), s.probability().alias("p"), "_tree.contributions", *NAMES).toPandas()
    margin = model.margins(wide[NAMES].to_numpy(float))
    assert np.allclose(wide["m"], margin) and np.allclose(wide["p"], 1 / (1 + np.exp(-(2 / (1 + np.exp(-margin)) - 1))))
    assert np.allclose(np.array(wide["contributions"].tolist()).sum(axis=1) + s.base_value(), margin)
    model.save(str(tmp_path / "m"))
    back = B.BoostedTrees.load(str(tmp_path / "m"))
    assert np.array_equal(back.margins(X), model.margins(X)) and back.params == model.params


def test_one_class_nulls_and_empty(spark, rows):
    one, _ = B.fit_boosted(rows.withColumn("label", F.lit(1)), NAMES, params=P)
    assert one.init == 0.0
    holes = rows.withColumn("f0", F.when(F.col("f1") > 1, F.col("f0")))
    model, _ = B.fit_boosted(holes, NAMES, params=P)
    filled, _ = B.fit_boosted(holes.fillna(0.0), NAMES, params=P)
    assert [t.value.tolist() for t in model.trees] == [t.value.tolist() for t in filled.trees]
    assert B.stop_at([(1, 0.5), (2, None), (3, 0.6), (4, 0.6), (5, 0.6)], 2) == (3, True)
    assert B.stop_at([(1, 0.5), (2, None), (3, 0.6)], 1) == (1, True)
    assert B.stop_at([], 3) == (None, False)


def test_rows_are_kept_and_routed_in_blocks(rows):
    train, valid = rows.where("part < 0.7"), rows.where("part >= 0.7")
    data = B.bin_rows(train.coalesce(1), NAMES, valid=valid.coalesce(1))
    kept = data.rows.toPandas()
    data.unpersist()
    assert len(kept) == 2 and kept.groupby("valid")["n"].sum().to_dict() == {False: train.count(), True: valid.count()}
    model, _ = B.fit_boosted(train, NAMES, params=P)
    X, bins = rows.select(*NAMES).toPandas().to_numpy(float), B.Bins(model.edges)
    for tree in model.trees:
        *binned, value = B._binned_tree(tree, bins)
        assert np.array_equal(value[B.nodes_of(bins.of(X), *binned)], B.tree_predict(X, tree))


def test_rounds_between_two_looks_take_one_pass_and_give_the_same_trees(rows, monkeypatch):
    train, valid = rows.where("part < 0.7"), rows.where("part >= 0.7")
    params = B.replace(P, rounds=5, bagging_fraction=0.6, bagging_freq=2, feature_fraction=0.7)
    spread, looks = B.fit_boosted(train, NAMES, params=params, valid=valid, refresh=3, local_rows=50)

    def no_step(self):
        raise AssertionError("rows that one task may hold are brought together once, not tree by tree")
    monkeypatch.setattr(B.Booster, "step", no_step)
    here, looks_here = B.fit_boosted(train, NAMES, params=params, valid=valid, refresh=3)
    assert sorted(looks) == looks_here and len(here.trees) == len(spread.trees)
    for x, y in zip(here.trees, spread.trees):
        assert all(np.array_equal(getattr(x, c), getattr(y, c)) for c in B.TREE_COLUMNS)
