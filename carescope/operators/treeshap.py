"""Path-dependent tree attributions for Spark GBT models (E1 for tree ensembles, E3, E4).

Algorithm: TreeSHAP with path-dependent conditional expectations weighted by node cover
(Lundberg, Erion and Lee, "Consistent Individualized Feature Attribution for Tree Ensembles",
2018, Algorithm 2). The recursion visits every node for every row in the same order - only
the hot/cold direction differs per row - so it is evaluated for a whole Arrow batch of rows at
once with numpy arrays, inside ``mapInPandas``.

The node table (trees x nodes, bounded by iterations x 2^(depth+1)) is read from the saved model
and shipped with the task closure; its size depends on the ensemble's parameters alone. Output is in log-odds space:
Spark's GBT probability is sigmoid(2 * margin), so log-odds = 2 * sum_t weight_t * tree_t(x) and
base + sum(contributions) equals it (E3).
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, remove_folder
from .explain import explain_base_stage, platt_apply

@dataclass
class Tree:
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def expected_value(self) -> float:
        leaves = self.left < 0
        return float(np.sum(self.value[leaves] * self.cover[leaves]) / self.cover[0])


def gbt_trees(gbt_model, spark, path: str | None = None) -> tuple[list[Tree], list[float]]:
    """Read the node table of a fitted GBT (the model stage, not the pipeline) via its saved form."""
    path = path or os.path.join(checkpoint_dir(spark), f"gbt-{gbt_model.uid}-{uuid.uuid4().hex}")
    gbt_model.write().overwrite().save(path)
    nodes = spark.read.parquet(os.path.join(path, "data")).select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.split.numCategories")
    # the ensemble itself: at most iterations x 2^(depth + 1) rows, whatever the data's size
    rows = nodes.collect()
    remove_folder(spark, path)
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], []).append(r)
    trees = []
    for tid in sorted(by_tree):
        rs = sorted(by_tree[tid], key=lambda r: r["id"])
        n = len(rs)
        left = np.full(n, -1, dtype=np.int64)
        right = np.full(n, -1, dtype=np.int64)
        feat = np.full(n, -1, dtype=np.int64)
        thr = np.zeros(n)
        val = np.zeros(n)
        cov = np.zeros(n)
        for r in rs:
            i = r["id"]
            val[i] = r["prediction"]
            cov[i] = float(r["rawCount"])
            if r["leftChild"] >= 0:
                if r["numCategories"] is not None and r["numCategories"] >= 0:
                    raise NotImplementedError("categorical tree splits: assemble features as continuous values")
                left[i], right[i], feat[i] = r["leftChild"], r["rightChild"], r["featureIndex"]
                thr[i] = r["leftCategoriesOrThreshold"][0]
        trees.append(Tree(left, right, feat, thr, val, cov))
    return trees, list(gbt_model.treeWeights)


def _extend(d, z, o, w, pz, po, pi, n):
    lvl = len(d)
    d, z, o = d + [pi], z + [pz], o + [po]
    w = [x.copy() for x in w] + [np.ones(n) if lvl == 0 else np.zeros(n)]
    for i in range(lvl - 1, -1, -1):
        w[i + 1] = w[i + 1] + po * w[i] * (i + 1) / (lvl + 1)
        w[i] = pz * w[i] * (lvl - i) / (lvl + 1)
    return d, z, o, w


def _unwind(d, z, o, w, k):
    depth = len(d) - 1
    one, zero = o[k], z[k]
    nz = one != 0
    safe_one = np.where(nz, one, 1.0)
    w = [x.copy() for x in w]
    nxt = w[depth].copy()
    for i in range(depth - 1, -1, -1):
        a = nxt * (depth + 1) / ((i + 1) * safe_one)
        b = w[i] * (depth + 1) / (zero * (depth - i)) if zero != 0 else np.zeros_like(w[i])
        new_wi = np.where(nz, a, b)
        nxt = np.where(nz, w[i] - new_wi * zero * (depth - i) / (depth + 1), nxt)
        w[i] = new_wi
    return d[:k] + d[k + 1:], z[:k] + z[k + 1:], o[:k] + o[k + 1:], w[:depth]


def _unwound_sum(d, z, o, w, k):
    depth = len(d) - 1
    one, zero = o[k], z[k]
    nz = one != 0
    safe_one = np.where(nz, one, 1.0)
    nxt = w[depth]
    total = np.zeros_like(nxt)
    for i in range(depth - 1, -1, -1):
        tmp = nxt * (depth + 1) / ((i + 1) * safe_one)
        alt = (w[i] / zero) / ((depth - i) / (depth + 1)) if zero != 0 else np.zeros_like(tmp)
        total = total + np.where(nz, tmp, alt)
        nxt = np.where(nz, w[i] - tmp * zero * ((depth - i) / (depth + 1)), nxt)
    return total


def tree_shap(X: np.ndarray, tree: Tree) -> np.ndarray:
    """Attributions of one tree for every row of X (n x M), path-dependent, cover weighted."""
    n, m = X.shape
    phi = np.zeros((n, m))

    def rec(node, d, z, o, w, pz, po, pi):
        d, z, o, w = _extend(d, z, o, w, pz, po, pi, n)
        if tree.left[node] < 0:
            for i in range(1, len(d)):
                s = _unwound_sum(d, z, o, w, i)
                phi[:, d[i]] += s * (o[i] - z[i]) * tree.value[node]
            return
        f = int(tree.feature[node])
        go_left = X[:, f] <= tree.threshold[node]
        iz, io = 1.0, np.ones(n)
        if f in d:
            k = d.index(f)
            iz, io = z[k], o[k]
            d, z, o, w = _unwind(d, z, o, w, k)
        for child, cond in ((tree.left[node], go_left), (tree.right[node], ~go_left)):
            rec(int(child), d, z, o, w, tree.cover[child] / tree.cover[node] * iz, io * cond, f)

    rec(0, [], [], [], [], 1.0, np.ones(n), -1)
    return phi


def tree_predict(X: np.ndarray, tree: Tree) -> np.ndarray:
    node = np.zeros(X.shape[0], dtype=np.int64)
    for _ in range(64):
        internal = tree.left[node] >= 0
        if not internal.any():
            break
        f = tree.feature[node]
        go_left = X[np.arange(X.shape[0]), np.maximum(f, 0)] <= tree.threshold[node]
        nxt = np.where(go_left, tree.left[node], tree.right[node])
        node = np.where(internal, nxt, node)
    return tree.value[node]


TABLE_FEATURES = 10     # a path over more features is evaluated for the rows themselves


@dataclass
class PathTable:
    """One leaf: the interval of each feature on its path, and the attributions for every subset of met intervals."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    zero: np.ndarray              # shares of the cover that goes this way
    value: float
    table: np.ndarray | None      # (2 ** features) x features; None for a long path

    def add_to(self, phi: np.ndarray, X: np.ndarray, weight: float) -> None:
        """``phi`` and ``X`` hold one feature after the other (features x n), so that a path touches whole columns."""
        met = [(X[f] > low) & (X[f] <= high) for f, low, high in zip(self.features, self.low, self.high)]
        if self.table is None:
            found = weight * _path_shap(np.stack(met, axis=1), self.zero, self.value)
            for j, f in enumerate(self.features):
                phi[f] += found[:, j]
            return
        at = np.zeros(X.shape[1], np.intp)
        for j, here in enumerate(met):
            at += here.astype(np.intp) << j
        for j, f in enumerate(self.features):
            phi[f] += (weight * self.table[:, j])[at]


def _path_shap(met: np.ndarray, zero: np.ndarray, value: float) -> np.ndarray:
    """Attributions of one path's features for rows that meet the given intervals."""
    n, k = met.shape
    d, z, o, w = _extend([], [], [], [], 1.0, np.ones(n), -1, n)
    for j in range(k):
        d, z, o, w = _extend(d, z, o, w, float(zero[j]), met[:, j].astype(float), j, n)
    return np.stack([_unwound_sum(d, z, o, w, j + 1) * (o[j + 1] - z[j + 1]) * value for j in range(k)], axis=1)


def _path_weights(met: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """(features x n) attributions, for a leaf of value 1, of n rows of one path each: all paths as long, each with its own
    shares of the cover (features x n). As :func:`_path_shap`, whose steps it takes for all paths at once."""
    k, n = met.shape
    one, w = met.astype(float), [np.ones(n)]
    for j in range(k):
        w.append(np.zeros(n))
        lvl = j + 1
        for i in range(lvl - 1, -1, -1):
            w[i + 1] = w[i + 1] + one[j] * w[i] * (i + 1) / (lvl + 1)
            w[i] = zero[j] * w[i] * (lvl - i) / (lvl + 1)
    out = np.empty((k, n))
    with np.errstate(divide="ignore", invalid="ignore"):
        for j in range(k):
            nxt, total = w[k], np.zeros(n)
            for i in range(k - 1, -1, -1):
                tmp = nxt * (k + 1) / (i + 1)
                alt = np.where(zero[j] != 0, (w[i] / zero[j]) / ((k - i) / (k + 1)), 0.0)
                total = total + np.where(met[j], tmp, alt)
                nxt = np.where(met[j], w[i] - tmp * zero[j] * ((k - i) / (k + 1)), nxt)
            out[j] = total * (one[j] - zero[j])
    return out


def _paths(tree: Tree) -> list[PathTable]:
    """The leaves of a tree from left to right, without their tables; none for a tree of one leaf."""
    out = []

    def walk(node: int, path: dict) -> None:
        if tree.left[node] < 0:
            if path:
                low, high, zero = (np.array([p[j] for p in path.values()]) for j in range(3))
                out.append(PathTable(np.array(list(path), dtype=np.int64), low, high, zero, float(tree.value[node]), None))
            return
        f, cut = int(tree.feature[node]), float(tree.threshold[node])
        low, high, zero = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((tree.left[node], (low, min(high, cut))), (tree.right[node], (max(low, cut), high))):
            walk(int(child), {**path, f: (*bounds, zero * tree.cover[child] / tree.cover[node])})

    walk(0, {})
    return out


def _fill(leaves: Sequence[PathTable], rows: int = 1 << 15) -> None:
    """Tables of leaves, those of as many features at once; longer paths keep none."""
    for k in {len(leaf.features) for leaf in leaves if len(leaf.features) <= TABLE_FEATURES}:
        same, every = [leaf for leaf in leaves if len(leaf.features) == k], (np.arange(1 << k) >> np.arange(k)[:, None] & 1).astype(bool)
        step = max(1, rows >> k)
        for some in (same[i:i + step] for i in range(0, len(same), step)):
            zero = np.repeat(np.stack([leaf.zero for leaf in some], axis=1), 1 << k, axis=1)
            found = _path_weights(np.tile(every, len(some)), zero).reshape(k, len(some), 1 << k)
            for j, leaf in enumerate(some):
                leaf.table = np.ascontiguousarray(found[:, j].T) * leaf.value


def path_tables(tree: Tree) -> list[PathTable]:
    """A table for each leaf of a tree; subset weights are worked out once, not for every row."""
    out = _paths(tree)
    _fill(out)
    return out


def shap_by_tables(X: np.ndarray, tables: Sequence[Sequence[PathTable]], trees: Sequence[Tree], weights: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`shap_and_margin`, by table lookups."""
    columns = np.ascontiguousarray(X.T)
    phi, margin = np.zeros_like(columns), np.zeros(X.shape[0])
    for leaves, t, w in zip(tables, trees, weights):
        for leaf in leaves:
            leaf.add_to(phi, columns, w)
        margin += w * tree_predict(X, t)
    return np.ascontiguousarray(2.0 * phi.T), 2.0 * margin


TABLE_CELLS = 1024      # cells of a table that the leaves of a subtree share, at most
KNOWN_SUBSETS = 4096    # subsets of a long path of which a worker keeps the attributions


@dataclass
class CellTable:
    """The leaves of a subtree together: every feature on their paths is cut at all borders that they name, and a cell
    of these intervals has the sum of the leaves' attributions and the value of the leaf it lies in, if any."""

    features: list[int]
    cuts: list[Sequence[float]]
    table: np.ndarray             # (features + 1) x cells, the leaf's value last
    met: bool                     # of one leaf: two cells a feature, whether it lies in the interval (both its cuts)


class LongPath:
    """A leaf of a path too long for a table of all subsets: attributions of the subsets that rows have met so far."""

    def __init__(self, leaf: PathTable):
        self.leaf, self.known, self.table = leaf, np.empty(0, np.int64), np.empty((0, len(leaf.features)))

    def add_to(self, phi: np.ndarray, columns: np.ndarray, weight: float, value: np.ndarray) -> None:
        leaf, at = self.leaf, np.zeros(columns.shape[1], np.int64)
        met = [(columns[f] > low) & (columns[f] <= high) for f, low, high in zip(leaf.features.tolist(), leaf.low, leaf.high)]
        for j, here in enumerate(met):
            at += here * np.int64(1 << j)
        places = np.searchsorted(self.known, at)
        fresh = at[self.known[np.minimum(places, len(self.known) - 1)] != at] if len(self.known) else at
        if len(fresh):
            fresh = np.unique(fresh)
            found = _path_shap((fresh[:, None] >> np.arange(len(met)) & 1).astype(bool), leaf.zero, leaf.value)
            if len(self.known) + len(fresh) > KNOWN_SUBSETS:       # begun anew: a batch has its own subsets at least
                self.known, self.table, fresh = self.known[:0], self.table[:0], np.unique(at)
                found = _path_shap((fresh[:, None] >> np.arange(len(met)) & 1).astype(bool), leaf.zero, leaf.value)
            order = np.argsort(known := np.concatenate([self.known, fresh]))
            self.known, self.table = known[order], np.concatenate([self.table, found])[order]
            places = np.searchsorted(self.known, at)
        for j, f in enumerate(leaf.features.tolist()):
            phi[f] += weight * np.take(self.table[:, j], places)
        value += (at == (1 << len(met)) - 1) * leaf.value


def cell_tables(tree: Tree, leaves: Sequence[PathTable]) -> tuple[list[CellTable], list[PathTable]]:
    """Tables that cover a tree's leaves (as :func:`path_tables` gives them), and the leaves of long paths."""
    tables, alone, counts = [], [], {}

    def count(node: int) -> int:
        counts[node] = 1 if tree.left[node] < 0 else count(int(tree.left[node])) + count(int(tree.right[node]))
        return counts[node]

    def walk(node: int, first: int) -> None:
        some, borders = leaves[first:first + counts[node]], {}
        for leaf in some:
            for f, low, high in zip(leaf.features.tolist(), leaf.low.tolist(), leaf.high.tolist()):
                borders.setdefault(f, set()).update(v for v in (low, high) if np.isfinite(v))
        if math.prod(len(b) + 1 for b in borders.values()) <= TABLE_CELLS:
            tables.append(_cell_table(some, {f: sorted(b) for f, b in borders.items()}))
        elif counts[node] > 1:
            walk(int(tree.left[node]), first)
            walk(int(tree.right[node]), first + counts[int(tree.left[node])])
        else:                             # one leaf: in its intervals or not
            leaf, table = some[0], some[0].table
            if table is None:
                alone.append(leaf)
                return
            met = np.arange(len(table)) == len(table) - 1
            tables.append(CellTable(leaf.features.tolist(), list(zip(leaf.low.tolist(), leaf.high.tolist())),
                                    np.vstack([table.T, leaf.value * met]), True))

    if leaves:
        count(0)
        walk(0, 0)
    return tables, alone


def _cell_table(leaves: Sequence[PathTable], borders: dict[int, list[float]]) -> CellTable:
    features = sorted(borders)
    sizes = [len(borders[f]) + 1 for f in features]
    cells, bounds, stride = np.arange(math.prod(sizes)), {}, 1
    for f, size in zip(features, sizes):
        at = cells // stride % size
        bounds[f] = np.array([-np.inf, *borders[f]])[at], np.array([*borders[f], np.inf])[at]
        stride *= size
    table = np.zeros((len(features) + 1, len(cells)))
    for leaf in leaves:
        met = np.stack([(bounds[f][0] >= low) & (bounds[f][1] <= high) for f, low, high in zip(leaf.features.tolist(), leaf.low, leaf.high)], axis=1)
        found = _path_shap(met, leaf.zero, leaf.value) if leaf.table is None else leaf.table[met @ (1 << np.arange(met.shape[1]))]
        for j, f in enumerate(leaf.features.tolist()):
            table[features.index(f)] += found[:, j]
        table[-1] += leaf.value * met.all(axis=1)
    return CellTable(features, [borders[f] for f in features], table, False)


class Attributor:
    """Attributions and log-odds of an ensemble, as :func:`shap_and_margin` gives them, by the tables of its trees.

    A row's place among all cuts of a feature is found once; a table then costs a few comparisons of small
    integers and a lookup a feature, not one a leaf and feature.
    """

    def __init__(self, trees: Sequence[Tree], weights: Sequence[float]):
        self.trees, self.weights = list(trees), [float(w) for w in weights]
        inner = [t.left >= 0 for t in self.trees]
        features, cuts = (np.concatenate([x, *(v[here] for v, here in zip(xs, inner))]) for x, xs in (
            (np.empty(0, np.int64), [t.feature for t in self.trees]), (np.empty(0), [t.threshold for t in self.trees])))
        self.cuts = {f: np.unique(cuts[features == f]) for f in np.unique(features).tolist()}
        place = {f: {c: k for k, c in enumerate(v.tolist())} for f, v in self.cuts.items()}
        paths = [_paths(t) for t in self.trees]
        _fill([leaf for leaves in paths for leaf in leaves])
        # tree by tree: (table, whether its digits are intervals met, (feature, numbers of its cuts)), and the leaves of long paths
        self.tables = []
        for t, leaves, weight in zip(self.trees, paths, self.weights):
            shared, alone = cell_tables(t, leaves)
            for c in shared:
                c.table[:-1] *= weight
            self.tables.append(([(c.table, c.met, [(f, [place[f].get(v) for v in cuts]) for f, cuts in zip(c.features, c.cuts)])
                                 for c in shared], [LongPath(leaf) for leaf in alone]))

    def __call__(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(X)
        odd = np.isnan(X).any(axis=1)
        if odd.any():                     # a missing value lies in no interval
            phi, odds = np.empty(X.shape), np.empty(n)
            phi[~odd], odds[~odd] = self(X[~odd])
            phi[odd], odds[odd] = shap_by_tables(X[odd], [path_tables(t) for t in self.trees], self.trees, self.weights)
            return phi, odds
        columns = np.ascontiguousarray(X.T)
        place = {f: np.searchsorted(cuts, columns[f], side="left").astype(np.uint8 if len(cuts) < 256 else np.int32) for f, cuts in self.cuts.items()}
        phi, margin, value, found = np.zeros(columns.shape), np.zeros(n), np.empty(n), np.empty(n)
        for (shared, alone), tree, weight in zip(self.tables, self.trees, self.weights):
            value[:] = 0.0
            for table, met, features in shared:
                cell, stride = np.zeros(n, np.uint16), 1
                for f, cuts in features:
                    if met:
                        low, high = cuts
                        here = np.ones(n, bool) if low is None else place[f] > low
                        cell += (here if high is None else here & (place[f] <= high)) * np.uint16(stride)
                        stride *= 2
                        continue
                    for c in cuts:
                        cell += (place[f] > c) * np.uint16(stride)
                    stride *= len(cuts) + 1
                at = cell.astype(np.intp)
                for j, (f, _) in enumerate(features):
                    phi[f] += np.take(table[j], at, out=found, mode="clip")
                value += np.take(table[-1], at, out=found, mode="clip")
            for leaf in alone:
                leaf.add_to(phi, columns, weight, value)
            margin += weight * (value if shared or alone else tree.value[0])
        return np.ascontiguousarray(2.0 * phi.T), 2.0 * margin


_ATTRIBUTORS: dict[str, Attributor] = {}


def attributor(key: str, trees: Sequence[Tree], weights: Sequence[float]) -> Attributor:
    """The tables of one ensemble, kept by a worker for its later tasks."""
    if key not in _ATTRIBUTORS:
        _ATTRIBUTORS.clear()
        _ATTRIBUTORS[key] = Attributor(trees, weights)
    return _ATTRIBUTORS[key]


def shap_and_margin(X: np.ndarray, trees: Sequence[Tree], weights: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """(contributions, log-odds) of rows in log-odds space."""
    phi, margin = np.zeros_like(X), np.zeros(X.shape[0])
    for t, w in zip(trees, weights):
        phi += w * tree_shap(X, t)
        margin += w * tree_predict(X, t)
    return 2.0 * phi, 2.0 * margin


@dataclass
class TreeScorer:
    """A frozen tree-ensemble scorer for :func:`score.score_batch`: ordered features, trees, weights, optional Platt.

    ``prepare`` adds one column with log-odds and contributions (an Arrow-batched evaluation, no
    shuffle, so it runs on a stream too); the other methods are expressions over it.
    """

    features: list[str]
    trees: list[Tree]
    weights: list[float]
    platt: tuple[float, float] | None = None   # (a, b): calibrated = sigmoid(a * p + b)

    def _x(self, f: str) -> Column:
        return F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0))

    def attributed(self):
        """Function of rows (n x features) to (contributions, log-odds) for the workers; tables are made there."""
        trees, weights, key = list(self.trees), [float(w) for w in self.weights], uuid.uuid4().hex
        return lambda X: attributor(key, trees, weights)(X)

    def prepare(self, df: DataFrame) -> DataFrame:
        attributed, width = self.attributed(), len(self.features)

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for xs in batches:
                phi, odds = attributed(np.concatenate([np.empty(0), *xs]).reshape(len(xs), width))
                yield pd.DataFrame({"log_odds": odds, "contributions": list(phi)})
        # pandas_udf reads the kind of function from its annotations
        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        udf = F.pandas_udf(run, "log_odds double, contributions array<double>")
        return df.withColumn("_tree", udf(F.array(*[self._x(f) for f in self.features])))

    def margin(self) -> Column:
        return F.col("_tree.log_odds")

    def base_value(self) -> float:
        return 2.0 * float(sum(w * t.expected_value() for t, w in zip(self.trees, self.weights)))

    def probability(self) -> Column:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))
        return p if self.platt is None else platt_apply(p, *self.platt)

    def contributions(self) -> Column:
        """array<struct<position, feature, value, feature_value>> in feature order."""
        return F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"),
                                  F.col("_tree.contributions")[i].alias("value"), self._x(f).alias("feature_value"))
                         for i, f in enumerate(self.features)])


def tree_scorer(model, features: Sequence[str], spark, platt: tuple[float, float] | None = None) -> TreeScorer:
    """The scorer of a fitted pipeline (or a calibrated composite) whose predictor is a GBT."""
    if platt is None and hasattr(model, "a"):
        platt = (model.a, model.b)
    trees, weights = gbt_trees(explain_base_stage(model), spark)
    return TreeScorer(list(features), trees, [float(w) for w in weights], platt)


def attribute(df: DataFrame, features_col: str, trees: Sequence[Tree], weights: Sequence[float],
              key: str = "encounter_id") -> DataFrame:
    """E1 (trees): (key, base_value, log_odds, contributions array<double>) per row, in log-odds space."""
    base = 2.0 * sum(w * t.expected_value() for t, w in zip(trees, weights))
    trees, weights = list(trees), [float(w) for w in weights]
    src = df.select(key, vector_to_array(F.col(features_col)).alias("_x"))
    key_type = df.schema[key].dataType.simpleString()
    schema = (f"`{key}` {key_type}, base_value double, log_odds double, contributions array<double>, "
              "feature_values array<double>")

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.vstack(pdf["_x"].to_numpy()).astype(float)
            phi, odds = shap_and_margin(X, trees, weights)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "base_value": base, "log_odds": odds,
                                "contributions": list(phi), "feature_values": list(X)})

    return src.mapInPandas(run, schema)


def mean_contributions(df: DataFrame, scorer: TreeScorer) -> DataFrame:
    """A25 for trees: (feature, mean_abs_contribution). A task sends one row a feature, not one a row and feature."""
    features, attributed = list(scorer.features), scorer.attributed()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(features)), 0
        for batch in batches:
            X = np.concatenate([np.empty(0), *batch["x"]]).reshape(len(batch), len(features))
            total, n = total + np.abs(attributed(X)[0]).sum(axis=0), n + len(batch)
        if n:
            yield pd.DataFrame({"feature": features, "total": total, "n": n})

    parts = df.select(F.array(*[scorer._x(f) for f in features]).alias("x")).mapInPandas(run, "feature string, total double, n bigint")
    return parts.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("mean_abs_contribution"))


def named_contributions(attr: DataFrame, names: Sequence[str]) -> DataFrame:
    """Attach feature names, positions and values so :func:`explain.top_k` and the summaries apply."""
    arr = F.arrays_zip(F.col("contributions").alias("value"),
                       F.array(*[F.lit(n) for n in names]).alias("feature"),
                       F.sequence(F.lit(0), F.lit(len(names) - 1)).alias("position"),
                       F.col("feature_values").alias("feature_value"))
    return attr.withColumn("named", F.transform(arr, lambda c: F.struct(
        c["position"].alias("position"), c["feature"].alias("feature"), c["value"].alias("value"),
        c["feature_value"].alias("feature_value"))))
