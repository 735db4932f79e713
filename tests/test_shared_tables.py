"""Attributions by tables that the leaves of a subtree share."""

import numpy as np
import pytest

from carescope.operators import treeshap as T


@pytest.mark.parametrize("cells,known", [(1024, 4096), (8, 4096), (8, 12)])
def test_attributions_by_shared_tables(monkeypatch, cells, known):
    from test_path_tables import random_tree
    monkeypatch.setattr(T, "TABLE_CELLS", cells)
    monkeypatch.setattr(T, "TABLE_FEATURES", 4)
    monkeypatch.setattr(T, "KNOWN_SUBSETS", known)
    rng = np.random.default_rng(7)
    trees, weights = [random_tree(rng, leaves, 9) for leaves in (1, 2, 12, 31, 31)], [0.5, 1.0, -0.3, 2.0, 0.5]
    X = rng.normal(size=(300, 9))
    X[0, :] = float(trees[3].threshold[0])
    X[1, 2] = np.nan
    a = T.Attributor(trees, weights)
    assert any(c[0] for c in a.tables)
    a(X[150:])                                # long paths keep what they have met
    phi, odds = a(X)
    want, margin = T.shap_by_tables(X, [T.path_tables(t) for t in trees], trees, weights)
    whole = np.delete(np.arange(300), 1)
    assert np.allclose(phi, want, atol=1e-9) and np.allclose(odds, margin, atol=1e-12)
    assert np.allclose(phi[whole], T.shap_and_margin(X[whole], trees, weights)[0], atol=1e-9) and np.array_equal(odds[whole], margin[whole])
    assert a(X[:0])[0].shape == (0, 9)
