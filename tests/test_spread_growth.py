"""Trees grown by tasks that hold the rows together, and packed columns."""

import numpy as np
import pandas as pd
import pytest

from carescope.operators import boosting as B

NAMES = ["f0", "f1", "a", "b", "c", "d"]
P = B.BoostParams(rounds=5, learning_rate=0.3, num_leaves=9, min_child_samples=5, l1=0.1, l2=0.1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 1500
    kind = rng.integers(0, 4, n)
    X = pd.DataFrame({"f0": rng.normal(size=n).round(2), "f1": rng.integers(0, 7, n), **{c: (kind == k).astype(int) for k, c in enumerate("abc")},
                      "d": rng.integers(0, 2, n)})
    y = rng.random(n) < 1 / (1 + np.exp(-(X["f0"] + X["a"] * X["d"] - 0.3)))
    return spark.createDataFrame(X.assign(label=y.astype(int), part=rng.random(n))).repartition(6)


def same(a, b):
    return len(a.trees) == len(b.trees) and all(np.array_equal(getattr(x, c), getattr(y, c)) for x, y in zip(a.trees, b.trees) for c in B.TREE_COLUMNS)


@pytest.mark.parametrize("params", [P, B.replace(P, bagging_fraction=0.6, bagging_freq=2, feature_fraction=0.7, num_leaves=31)])
def test_tasks_that_hold_the_rows_grow_the_same_trees(rows, monkeypatch, params):
    train, valid = rows.where("part < 0.7"), rows.where("part >= 0.7")
    passes, looks = B.fit_boosted(train, NAMES, params=params, valid=valid, refresh=3, local_rows=100)
    alone, looks_alone = B.fit_boosted(train, NAMES, params=params, valid=valid, refresh=3)

    def no_step(self):
        raise AssertionError("rows beyond LOCAL_BYTES are not gone over a tree and level at a time")
    monkeypatch.setattr(B.Booster, "step", no_step)
    monkeypatch.setattr(B, "LOCAL_BYTES", 4_000)
    monkeypatch.setattr(B, "ALONE_ROWS", 300, raising=False)
    spread, looks_spread = B.fit_boosted(train, NAMES, params=params, valid=valid, refresh=3)
    assert same(passes, alone) and same(passes, spread) and sorted(looks) == looks_alone == looks_spread


def test_tasks_go_on_from_an_ensemble(rows, monkeypatch):
    monkeypatch.setattr(B, "ALONE_ROWS", 300)
    train, valid = rows.where("part < 0.7"), rows.where("part >= 0.7")
    data = B.bin_rows(train, NAMES, valid=valid)
    whole, looks, _ = B.run_rounds(data, P, refresh=2)
    half, first, _ = B.run_rounds(data, B.replace(P, rounds=2), refresh=2)
    on, both, _ = B.run_rounds(data, P, start=half, history=first, refresh=2)
    data.unpersist()
    assert same(whole, on) and both == looks and looks[:2] == first


def test_rows_too_many_for_the_tasks_take_passes(rows, monkeypatch):
    whole, _ = B.fit_boosted(rows, NAMES, params=P)
    monkeypatch.setattr(B, "TASK_BYTES", 1_000)
    data = B.bin_rows(rows, NAMES)
    assert B.Booster(data, P).tasks == 0
    data.unpersist()
    assert same(whole, B.fit_boosted(rows, NAMES, params=P)[0])


def test_packed_columns_hold_every_bin():
    rng = np.random.default_rng(5)
    kind = rng.integers(0, 4, 3000)
    X = np.stack([rng.normal(size=3000), rng.integers(0, 40, 3000), *((kind == k) for k in range(3)), rng.integers(0, 2, 3000), np.zeros(3000)], axis=1)
    edges = [np.unique(np.quantile(X[:, j], np.linspace(0, 1, 200)))[:-1] for j in range(X.shape[1])]
    plain = B.Bins(edges)
    found = plain.of(X)
    bundles = B.exclusive(found, plain.two.tolist())
    assert bundles == [[2, 3, 4]]
    for bins in (plain, B.Bins(edges, bundles)):
        packed = bins.pack(found)
        assert packed.shape[0] < len(edges) and np.array_equal(bins.unpack(packed), found)
        g, h = (np.round(v * B.GRID) / B.GRID for v in (rng.normal(size=3000), rng.random(3000)))
        some = np.flatnonzero(rng.random(3000) < 0.3)
        assert np.array_equal(B.cell_sums(bins, packed, g, h), B.bin_sums(bins, found, g, h)[0])
        assert np.array_equal(B.cell_sums(bins, packed, g, h, some), B.bin_sums(bins, found[:, some], g[some], h[some])[0])


def test_indicators_wrongly_bundled_are_found(rows, monkeypatch):
    right, _ = B.fit_boosted(rows, NAMES, params=P)
    monkeypatch.setattr(B, "exclusive", lambda B_, indicators: [[2, 3], [4, 5]])        # c and d are set together
    data = B.bin_rows(rows, NAMES)
    assert data.bundles == [[2, 3]] and data.train_rows == 1500
    data.unpersist()
    assert same(right, B.fit_boosted(rows, NAMES, params=P)[0])


def test_no_sketch_of_indicators(rows, monkeypatch):
    asked, real = [], type(rows).approxQuantile
    monkeypatch.setattr(type(rows), "approxQuantile", lambda self, cols, *more: asked.extend(cols) or real(self, cols, *more))
    edges = B.bin_edges(rows, NAMES)
    assert asked == ["f0", "f1"]
    want = [np.unique(real(rows, n, np.linspace(0, 1, 256).tolist(), 1e-3))[:-1] for n in NAMES]
    assert [a.tolist() for a in edges[1:]] == [b.tolist() for b in want[1:]]


def test_the_last_trials_of_a_search_take_the_free_slots(spark, rows, monkeypatch):
    from carescope.operators import tune
    monkeypatch.setattr(B, "ALONE_ROWS", 100)
    asked, real = [], B.Booster._tasks
    monkeypatch.setattr(B.Booster, "_tasks", lambda self: asked.append(real(self)) or asked[-1])
    train, valid = rows.where("part < 0.7"), rows.where("part >= 0.7")
    found = tune.search(spark, train, valid, NAMES, n_trials=4, parallelism=4, most=30, patience=40)
    assert asked[0] == 1 and max(asked) > 1                      # four trials on four slots, then fewer
    monkeypatch.setattr(B, "ALONE_ROWS", 1 << 20)
    alone = tune.search(spark, train, valid, NAMES, n_trials=4, parallelism=4, most=30, patience=40)
    assert [(t.state, t.history) for t in found] == [(t.state, t.history) for t in alone]
