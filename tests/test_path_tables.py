"""Tree attributions by path tables: equal to the recursion, also for repeated features and long paths."""

import time

import numpy as np
import pytest

from carescope.operators import treeshap as T


def random_tree(rng, leaves, m):
    left, right, feature, threshold, value, cover, open_ = [-1], [-1], [-1], [0.0], [0.0], [1000.0], [0]
    while len(open_) < leaves:
        node = open_.pop(rng.integers(0, len(open_)))
        feature[node], threshold[node] = int(rng.integers(0, m)), float(rng.normal())
        share = rng.uniform(0.1, 0.9)
        for side, part in ((left, share), (right, 1 - share)):
            side[node] = len(left)
            for values, v in ((left, -1), (right, -1), (feature, -1), (threshold, 0.0), (value, float(rng.normal())), (cover, cover[node] * part)):
                values.append(v)
            open_.append(len(left) - 1)
    return T.Tree(*[np.array(x) for x in (left, right, feature, threshold, value, cover)])


@pytest.mark.parametrize("leaves,m,limit", [(1, 3, 10), (2, 3, 10), (8, 2, 10), (31, 6, 10), (31, 40, 10), (31, 40, 2)])
def test_equal_to_the_recursion(monkeypatch, leaves, m, limit):
    monkeypatch.setattr(T, "TABLE_FEATURES", limit)
    rng = np.random.default_rng(leaves + m)
    trees, weights = [random_tree(rng, leaves, m) for _ in range(4)], [0.5, 1.0, -0.3, 2.0]
    X = rng.normal(size=(200, m))
    X[0] = [t for t in trees[0].threshold if t][:1] * m if leaves > 1 else X[0]        # a value on the border goes left
    phi, margin = T.shap_and_margin(X, trees, weights)
    got, odds = T.shap_by_tables(X, [T.path_tables(t) for t in trees], trees, weights)
    assert np.allclose(got, phi, atol=1e-9) and np.array_equal(odds, margin)


def test_faster_than_the_recursion():
    rng = np.random.default_rng(0)
    tree, X = random_tree(rng, 31, 54), rng.normal(size=(5000, 54))
    tables = [T.path_tables(tree)]
    t0 = time.process_time()
    T.shap_and_margin(X, [tree], [1.0])
    t1 = time.process_time()
    T.shap_by_tables(X, tables, [tree], [1.0])
    assert time.process_time() - t1 < t1 - t0


def test_a_path_touches_whole_columns():
    """Rows lie feature by feature while the paths of a tree are added up."""
    rng = np.random.default_rng(11)
    tree = T.Tree(np.array([1, 3, -1, -1, -1]), np.array([2, 4, -1, -1, -1]), np.array([0, 2, -1, -1, -1]), np.array([0.1, -0.2, 0, 0, 0.0]),
                  np.array([0, 0, 0.7, -0.4, 0.2]), np.array([50, 30, 20, 18, 12.0]))
    X = rng.normal(size=(7, 3))
    phi = np.zeros((3, 7))
    for leaf in T.path_tables(tree):
        leaf.add_to(phi, np.ascontiguousarray(X.T), 1.0)
    assert np.allclose(phi.T, T.tree_shap(X, tree), atol=1e-12)
