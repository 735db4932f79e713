"""Gradient-boosted trees grown best leaf first (M4), stopped early in one run (M5), saved and loaded.

The rows are binned once and kept in blocks of up to ``BLOCK`` rows: a label and a weight, each a
byte as a rule, and the bin numbers of all features, several of them packed into one column of two
bytes (mixed radix, exact for any rows). The sums of gradients, hessians and counts over a packed
column's cells give those of all its features, so a pass costs a few sums a row, not one a feature.

The ``refresh`` rounds between two looks at the validation rows are grown by tasks that run at the
same time (a barrier stage; one task when the rows are few or the slots are taken by other fits).
A task keeps its part of the rows while these trees grow; what the tasks exchange, through small
files in the shared checkpoint folder, is one vector of sums a leaf: its size depends on features x
bins alone. All of them take the same decisions from the same totals. Of two children only the
smaller is summed; the other is the parent minus its sibling. Best-leaf-first order is exact: the
leaf of highest gain is split next; children are asked for ahead of that order, several leaves at once.

Where the rows of a task would not fit its memory, or tasks cannot run at the same time, a tree
takes passes over the rows: one a level, until a leaf's rows take at most ``LOCAL_BYTES`` and are
brought to one task that grows it to its end. All ways give the same trees.

Gradients are rounded to multiples of 2**-20, so sums do not depend on the order of tasks, and a
repeated task or another partitioning gives the same trees.

Margins are kept with the rows and brought up to date every ``refresh`` rounds; between, a task
adds the few trees grown since. The validation AUROC of each round is that of exact margins, so the
rule stops the one run that is going on, and a fit goes on from any fitted ensemble (``start``),
with the same bins.
"""

from __future__ import annotations

import json
import pickle
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, remove_folder, small_methods
from . import curves
from .treeshap import Tree, TreeScorer, tree_predict

GRID = 2.0 ** 20          # gradients are multiples of 1 / GRID
ROW_BYTES = 40            # of a row beside its bins
PART_BYTES = 16 << 20     # rows of a partition, about
LOCAL_BYTES = 64 << 20    # a leaf whose rows take at most so much is grown to its end in one task
CHUNK = 16                # features whose sums travel in one vector
BLOCK = 16_384            # rows of a block, about
CELLS = 1 << 14           # cells of a packed column at most
AT_ONCE = 65_536          # rows whose sums are added up in one go
ALONE_ROWS = 131_072      # training rows for which a further task is worth its exchanges
TASK_BYTES = 512 << 20    # what the rows of a task may take while trees grow
RANK_ROWS = 32_000_000    # validation rows of which half go to all tasks in a round, at most
WAIT_S = 3_600            # a task that hears nothing of the others for so long fails
BINNED = "valid boolean, n int, y binary, w binary, x binary, margin binary, draw binary"


@dataclass(frozen=True)
class BoostParams:
    """The defaults are the reference's baseline settings."""

    rounds: int = 500
    learning_rate: float = 0.05
    num_leaves: int = 31
    max_depth: int = -1                # no limit
    min_child_samples: int = 50
    min_child_weight: float = 1e-3     # least sum of hessians of a leaf
    l1: float = 0.1
    l2: float = 0.1
    feature_fraction: float = 1.0
    bagging_fraction: float = 1.0
    bagging_freq: int = 0
    max_bins: int = 255
    seed: int = 42


@dataclass
class BoostedTrees:
    """A fitted ensemble: margin = init + sum of tree values; probability = sigmoid(margin)."""

    features: list[str]
    init: float
    trees: list[Tree]
    edges: list[np.ndarray]
    params: BoostParams = field(default_factory=BoostParams)

    def margins(self, X: np.ndarray) -> np.ndarray:
        bins, out = Bins(self.edges), np.full(len(X), self.init)
        trees = [_binned_tree(t, bins) for t in self.trees]
        for a in range(0, len(X), BLOCK):
            B, here = bins.of(X[a:a + BLOCK]), out[a:a + BLOCK]
            for *tree, value in trees:
                here += value[nodes_of(B, *tree)]
        return out

    def first(self, rounds: int) -> BoostedTrees:
        """The ensemble of the first rounds: a prefix of a run is the run that stopped there."""
        return replace(self, trees=self.trees[:rounds])

    def scorer(self, platt: tuple[float, float] | None = None) -> TreeScorer:
        """For batch and stream scoring and attributions (whose log-odds are twice the weighted sum)."""
        flat = np.array([-1]), np.array([-1]), np.array([-1]), np.zeros(1), np.array([self.init]), np.array([1.0])
        return TreeScorer(list(self.features), [Tree(*flat), *self.trees], [0.5] * (len(self.trees) + 1), platt)

    def score(self, df: DataFrame, out: str = "probability_1") -> DataFrame:
        """M6: all columns and the probability of class 1 (Arrow batches, no shuffle)."""
        features, predict = self.features, self.margins

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for xs in batches:
                X = np.concatenate([np.empty(0), *xs]).reshape(len(xs), len(features))
                yield pd.Series(1.0 / (1.0 + np.exp(-predict(X))))
        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return df.withColumn(out, F.pandas_udf(run, "double")(_row(features)))

    def save(self, path: str) -> None:
        """A node table and a row of settings; both bounded by the ensemble."""
        spark = SparkSession.getActiveSession()
        rows = [(t, i, *(x[i].item() for x in (tree.left, tree.right, tree.feature, tree.threshold, tree.value, tree.cover)))
                for t, tree in enumerate(self.trees) for i in range(len(tree.left))]
        spark.createDataFrame(rows, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"features": self.features, "init": self.init, "edges": [e.tolist() for e in self.edges], "params": self.params.__dict__,
                "trees": len(self.trees)}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(path: str) -> BoostedTrees:
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        trees = _trees(spark.read.parquet(f"{path}/nodes").toPandas())
        if len(trees) != meta["trees"]:
            raise ValueError(f"{path}: {len(trees)} of {meta['trees']} trees")
        return BoostedTrees(meta["features"], meta["init"], trees, [np.array(e) for e in meta["edges"]], BoostParams(**meta["params"]))


SUBTREE = "node int, k int, left int, right int, gain double, at int, g double, h double, c double"
NODES = "tree int, node int, left bigint, right bigint, feature bigint, threshold double, value double, cover double"
TREE_COLUMNS = ("left", "right", "feature", "threshold", "value", "cover")


def _row(features: Sequence[str]):
    return F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features])


def bin_edges(train: DataFrame, features: Sequence[str], max_bins: int = 255, error: float = 1e-3) -> list[np.ndarray]:
    """Per feature the upper ends of all bins but the last: distinct quantiles, approximate to ``error``
    of the rows (one pass; nulls count as 0)."""
    filled = train.select(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f"f{k}") for k, f in enumerate(features)])
    at = np.linspace(0.0, 1.0, min(max_bins, 255) + 1).tolist()
    # of a feature that is 0 or 1 the quantiles are its least and greatest value: no sketch for it
    ends = filled.agg(*[f(f"f{k}").alias(f"{n}{k}") for k in range(len(features)) for n, f in (("l", F.min), ("h", F.max))],
                      *[F.max(~F.col(f"f{k}").isin(0.0, 1.0)).alias(f"o{k}") for k in range(len(features))]).first()
    asked = [k for k in range(len(features)) if ends[f"o{k}"] is not False]
    found = {k: [ends[f"l{k}"], ends[f"h{k}"]] for k in range(len(features))}
    found |= dict(zip(asked, filled.approxQuantile([f"f{k}" for k in asked], at, error))) if asked else {}
    return [np.unique(np.array(found[k], float))[:-1] for k in range(len(features))]


def exclusive(B: np.ndarray, indicators: Sequence[int]) -> list[list[int]]:
    """Bundles of indicators of which no row (of features x n) has two set, neighbours first."""
    bundles: list[list[int]] = []
    seen: list[np.ndarray] = []
    for f in indicators:
        here = B[f] > 0
        for k in range(len(bundles) - 1, -1, -1):
            if len(bundles[k]) < 254 and not (seen[k] & here).any():
                bundles[k].append(f)
                seen[k] |= here
                break
        else:
            bundles.append([f])
            seen.append(here)
    return [b for b in bundles if len(b) > 1]


def soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_value(g: float, h: float, p: BoostParams) -> float:
    return float(-p.learning_rate * soft(g, p.l1) / (h + p.l2))


def _gain(g, h, p: BoostParams):
    return soft(g, p.l1) ** 2 / (h + p.l2)


class Bins:
    """Where each feature's bins lie in one long vector."""

    def __init__(self, edges: Sequence[np.ndarray], bundles: Sequence[Sequence[int]] = ()):
        self.edges = list(edges)
        sizes = np.array([len(e) + 1 for e in self.edges], np.int64)
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        self.n = int(self.start[-1])
        self.feature = np.repeat(np.arange(len(sizes)), sizes)
        last = np.zeros(self.n, bool)
        last[self.start[1:] - 1] = True
        self.can_split = ~last

        self.sizes = sizes
        self.two = np.flatnonzero(sizes == 2)           # features of two bins: indicators, as a rule
        # the digits of the packed columns: a feature each, or indicators of which no row has two set
        alone = set(np.flatnonzero(sizes > 1).tolist()) - {f for bundle in bundles for f in bundle}
        units = [*((tuple(b), len(b) + 1) for b in bundles), *(((f,), int(sizes[f])) for f in sorted(alone))]
        self.packed: list[list[tuple[tuple[int, ...], int]]] = []     # (features, radix), the fastest digit last
        self.cells: list[int] = []
        for unit in sorted(units, key=lambda u: -u[1]):
            k = next((k for k, c in enumerate(self.cells) if c * unit[1] <= CELLS), None)
            if k is None:
                self.packed.append([unit])
                self.cells.append(unit[1])
            else:
                self.packed[k].append(unit)
                self.cells[k] *= unit[1]
        # feature -> (packed column, stride of its digit, radix, what the digit is when an indicator is set; 0: its bin)
        self.place: dict[int, tuple[int, int, int, int]] = {}
        for k, digits in enumerate(self.packed):
            stride = self.cells[k]
            for fs_, radix in digits:
                stride //= radix
                self.place |= {f: (k, stride, radix, 0 if len(fs_) == 1 else j + 1) for j, f in enumerate(fs_)}

    def of(self, X: np.ndarray) -> np.ndarray:
        """Bin numbers (features x n, one byte): bin b holds values up to edge b."""
        out = np.empty((len(self.edges), len(X)), np.uint8)
        for j, e in enumerate(self.edges):
            out[j] = np.searchsorted(e, X[:, j], side="left") if len(e) != 1 else ~(X[:, j] <= e[0])
        return out

    def pack(self, B: np.ndarray) -> np.ndarray:
        """Packed columns (columns x n, two bytes) of bin numbers."""
        out = np.zeros((len(self.packed), B.shape[1]), np.uint16)
        for f, (k, stride, _, code) in self.place.items():
            out[k] += B[f] * np.uint16(stride * (code or 1))
        return out

    def digit(self, f: int) -> np.ndarray:
        """The bin number of a feature in every cell of its packed column."""
        k, stride, radix, code = self.place[f]
        found = np.arange(self.cells[k]) // stride % radix
        return (found == code if code else found).astype(np.uint8)

    def unpack(self, P: np.ndarray, features: Sequence[int] | None = None) -> np.ndarray:
        """Bin numbers (features x n) of packed columns; with ``features`` the others are left zero."""
        out = np.zeros((len(self.edges), P.shape[1]), np.uint8)
        for f in self.place if features is None else features:
            np.take(self.digit(f), P[self.place[f][0]], out=out[f])
        return out

    def spread(self, k: int, sums: np.ndarray, out: np.ndarray) -> None:
        """Sums over a packed column's cells (3 x cells) into the places of its features in ``out`` (3 x bins)."""
        def fold(part: np.ndarray, digits: list) -> None:
            if len(digits) > 1:
                half, shape = len(digits) // 2, int(np.prod([r for _, r in digits[:len(digits) // 2]]))
                part = part.reshape(len(part), shape, -1)
                fold(part.sum(axis=2), digits[:half])
                fold(part.sum(axis=1), digits[half:])
            elif len(digits[0][0]) == 1:
                f = digits[0][0][0]
                out[:, self.start[f]:self.start[f + 1]] = part
            else:
                at = self.start[list(digits[0][0])]
                out[:, at], out[:, at + 1] = part.sum(axis=1, keepdims=True) - part[:, 1:], part[:, 1:]
        fold(sums, self.packed[k])
    def best_split(self, sums: np.ndarray, p: BoostParams, allowed: np.ndarray) -> tuple[float, int] | None:
        """(gain, place in the vector) of the best split of a leaf with sums (3 x bins), ties to the first place."""
        total = sums[:, self.start[0]:self.start[1]].sum(axis=1)
        run = np.cumsum(sums, axis=1)
        left = run - np.concatenate((np.zeros((3, 1)), run), axis=1)[:, self.start[self.feature]]
        right = total[:, None] - left
        ok = (self.can_split & allowed[self.feature] & (np.minimum(left[2], right[2]) >= p.min_child_samples)
              & (np.minimum(left[1], right[1]) >= p.min_child_weight))
        if not ok.any():
            return None
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, _gain(left[0], left[1], p) + _gain(right[0], right[1], p) - _gain(total[0], total[1], p), -np.inf)
        at = int(np.argmax(gain))
        return (float(gain[at]), at) if gain[at] > 0 else None


@dataclass
class _Leaf:
    total: np.ndarray                               # sums of gradient, hessian and rows
    depth: int
    path: str                                       # from the root, L or R a step: orders equal gains
    split: tuple[float, int] | None = None          # (gain, place in the vector)
    sums: np.ndarray | None = None                  # (3 x bins), while its children may be asked for
    children: tuple[int, int] | None = None
    done: bool = False                              # all of its subtree that can be needed is known


class Growth:
    """One tree under construction: leaves, their sums and the splits applied so far.

    ``wanted`` names the leaves whose children's sums the next pass must bring; ``receive`` takes
    them in, ``graft`` takes in a subtree grown elsewhere; then leaves are split, best first, as
    far as what is known decides.
    """

    def __init__(self, bins: Bins, p: BoostParams, allowed: np.ndarray, depth: int = 0, path: str = ""):
        self.bins, self.p, self.allowed, self.depth, self.path = bins, p, allowed, depth, path
        self.leaves: dict[int, _Leaf] = {}
        self.applied: dict[int, None] = {}
        self.open: set[int] = set()

    def _add(self, sums: np.ndarray, depth: int, path: str) -> int:
        node, deep = len(self.leaves), 0 <= self.p.max_depth <= depth
        total = sums[:, :int(self.bins.start[1])].sum(axis=1)
        self.leaves[node] = _Leaf(total, depth, path, None if deep else self.bins.best_split(sums, self.p, self.allowed), sums)
        return node

    def begin(self, sums: np.ndarray) -> None:
        self.open = {self._add(sums, self.depth, self.path)}

    def begin_unseen(self, total: np.ndarray) -> None:
        """A root whose subtree is to be grown elsewhere."""
        self.leaves[0], self.open = _Leaf(total, self.depth, self.path, (np.inf, -1)), {0}

    def _candidates(self) -> list[int]:
        return sorted((n for n in self.open if self.leaves[n].split), key=lambda n: (-self.leaves[n].split[0], self.leaves[n].path))

    def wanted(self) -> list[int]:
        """Leaves without known children that may still be split, best first; none when the tree is done."""
        left = self.p.num_leaves - len(self.open)
        return [n for n in self._candidates()[:max(left, 0)] if self.leaves[n].children is None and not self.leaves[n].done]

    def tables(self) -> list[list[int]]:
        """(left, right, feature, bin) per node of the tree with all known children, for routing rows."""
        out = [[-1] * len(self.leaves) for _ in range(4)]
        for n, leaf in self.leaves.items():
            if leaf.children:
                f = int(self.bins.feature[leaf.split[1]])
                out[0][n], out[1][n], out[2][n], out[3][n] = *leaf.children, f, leaf.split[1] - int(self.bins.start[f])
        return out

    def smaller_left(self, node: int) -> bool:
        """Whether the left child has at most half of the node's rows."""
        leaf = self.leaves[node]
        first = int(self.bins.start[self.bins.feature[leaf.split[1]]])
        return bool(2 * leaf.sums[2, first:leaf.split[1] + 1].sum() <= leaf.total[2])

    def receive(self, found: dict[int, np.ndarray]) -> None:
        """``found``: sums of the smaller child by node."""
        for n, sums in sorted(found.items()):
            leaf = self.leaves[n]
            pair = (sums, leaf.sums - sums) if self.smaller_left(n) else (leaf.sums - sums, sums)
            leaf.children = (self._add(pair[0], leaf.depth + 1, leaf.path + "L"), self._add(pair[1], leaf.depth + 1, leaf.path + "R"))
            leaf.sums = None
        self._apply()

    def graft(self, node: int, rows: Sequence[tuple]) -> None:
        """A subtree as :meth:`as_rows` gives it, in place of a leaf."""
        number = {0: node}
        for k, (left, right, gain, at, g, h, c) in enumerate(rows):
            leaf = self.leaves[number[k]]
            leaf.split, leaf.done, leaf.sums = None if at < 0 else (gain, int(at)), True, None
            leaf.total = np.array([g, h, c])
            if left >= 0:
                leaf.children = (len(self.leaves), len(self.leaves) + 1)
                for child, side in zip((int(left), int(right)), "LR"):
                    number[child] = len(self.leaves)
                    self.leaves[number[child]] = _Leaf(np.zeros(3), leaf.depth + 1, leaf.path + side)
        self._apply()

    def as_rows(self) -> list[tuple]:
        """(left, right, gain, place, sums) per node; children come after their parent."""
        out = []
        for leaf in self.leaves.values():
            out.append((*(leaf.children or (-1, -1)), *(leaf.split or (0.0, -1)), *leaf.total.tolist()))
        return out

    def _apply(self) -> None:
        while len(self.open) < self.p.num_leaves:
            ranked = self._candidates()
            if not ranked or self.leaves[ranked[0]].children is None:
                break
            self.applied[ranked[0]] = None
            self.open = (self.open - {ranked[0]}) | set(self.leaves[ranked[0]].children)

    def tree(self) -> Tree:
        """The splits applied, nodes numbered from the root in the order in which they were split."""
        number, order = {0: 0}, [0]
        for n in self.applied:
            for child in self.leaves[n].children:
                number[child] = len(order)
                order.append(child)
        k = len(order)
        left, right, feature = (np.full(k, -1, np.int64) for _ in range(3))
        threshold, value, cover = np.zeros(k), np.zeros(k), np.zeros(k)
        for n in order:
            i, leaf = number[n], self.leaves[n]
            value[i], cover[i] = leaf_value(leaf.total[0], leaf.total[1], self.p), leaf.total[2]
            if n in self.applied:
                f = int(self.bins.feature[leaf.split[1]])
                left[i], right[i], feature[i] = number[leaf.children[0]], number[leaf.children[1]], f
                threshold[i] = self.bins.edges[f][leaf.split[1] - int(self.bins.start[f])]
        return Tree(left, right, feature, threshold, value, cover)


def bin_sums(bins: Bins, B: np.ndarray, g: np.ndarray, h: np.ndarray, ends: Sequence[int] | None = None) -> np.ndarray:
    """(groups x 3 x bins): sums of rows (features x n) that lie group after group, each up to its end.

    All terms are multiples of 1 / GRID, so the sums are exact in any order.
    """
    ends = [len(g)] if ends is None else list(ends)
    starts, k = [0, *ends[:-1]], len(ends)
    out, totals = np.zeros((k, 3, bins.n)), np.zeros((k, 3))
    indicators = np.zeros((k, 3, len(bins.two)))
    for i, (a, b) in enumerate(zip(starts, ends)):
        for c in range(a, b, BLOCK):
            d = min(b, c + BLOCK)
            V = np.stack([g[c:d], h[c:d], np.ones(d - c)])
            totals[i] += V.sum(axis=1)
            if len(bins.two):
                indicators[i] += V @ B[bins.two, c:d].astype(float).T
    out[:, :, bins.start[bins.two]], out[:, :, bins.start[bins.two] + 1] = totals[:, :, None] - indicators, indicators
    group = np.repeat(np.arange(k), np.diff([0, *ends]))
    for f, size in enumerate(bins.sizes):
        at = slice(bins.start[f], bins.start[f + 1])
        if size == 1:
            out[:, :, at] = totals[:, :, None]
        elif size > 2:
            place = B[f].astype(np.int64) if k == 1 else group * size + B[f]
            for j, v in enumerate((g, h, None)):
                out[:, j, at] = np.bincount(place, v, k * size).reshape(k, size)
    return out


def grow_here(growth: Growth, B: np.ndarray, g: np.ndarray, h: np.ndarray, rows: dict[int, np.ndarray] | None = None) -> Growth:
    """A whole subtree from the rows of its root (features x n), one split at a time; ``rows`` receives the
    rows of each leaf."""
    bins, rows = growth.bins, {} if rows is None else rows
    rows[0] = np.arange(len(g))
    growth.begin(bin_sums(bins, B, g, h)[0])
    while todo := growth.wanted():
        n = todo[0]
        at, small_left = growth.leaves[n].split[1], growth.smaller_left(n)
        f = int(bins.feature[at])
        goes = B[f][rows[n]] <= at - bins.start[f]
        pair = rows[n][goes], rows[n][~goes]
        small = pair[0 if small_left else 1]
        growth.receive({n: bin_sums(bins, np.take(B, small, axis=1), g[small], h[small])[0]})
        rows.update(zip(growth.leaves[n].children, pair))
        del rows[n]
    return growth


def cell_sums(bins: Bins, P: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """(3 x bins): as :func:`bin_sums` of all rows (packed columns x n) or of those named, by the columns' cells."""
    out, n = np.zeros((3, bins.n)), len(g) if rows is None else len(rows)
    totals, sums = np.zeros(3), [np.zeros((3, c)) for c in bins.cells]
    for a in range(0, n, AT_ONCE):
        at = slice(a, a + AT_ONCE) if rows is None else rows[a:a + AT_ONCE]
        gs, hs = g[at], h[at]
        totals += gs.sum(), hs.sum(), len(gs)
        for column, cells, total in zip(P, bins.cells, sums):
            place = column[at].astype(np.intp)
            total[0] += np.bincount(place, gs, cells)
            total[1] += np.bincount(place, hs, cells)
            total[2] += np.bincount(place, None, cells)
    out[:, bins.start[:-1][bins.sizes == 1]] = totals[:, None]
    for k, total in enumerate(sums):
        bins.spread(k, total, out)
    return out


class Exchange:
    """Sums of vectors over tasks that run at the same time, through small files in a shared folder."""

    def __init__(self, uri: str, rank: int, size: int):
        self.fs, self.root = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.root, recursive=True)
        self.rank, self.size, self.number = rank, size, 0

    def _name(self, number: int, rank: int) -> str:
        return f"{self.root}/{number}-{rank}"

    def _read(self, name: str) -> np.ndarray:
        pause, until = 0.0002, time.monotonic() + WAIT_S
        while True:
            try:
                with self.fs.open_input_stream(name) as f:
                    found = f.read()
                return np.frombuffer(found)
            except FileNotFoundError:
                if time.monotonic() > until:
                    raise TimeoutError(f"{name} was not written in {WAIT_S} s") from None
                time.sleep(pause)
                pause = min(pause * 1.1, 0.02)

    def each(self, own: np.ndarray) -> Iterator[np.ndarray]:
        """All tasks' vectors, task after task; every task calls it in the same order and goes through all of them."""
        mine = self._name(self.number, self.rank)
        with self.fs.open_output_stream(f"{mine}.new") as f:
            f.write(np.ascontiguousarray(own, float).tobytes())
        self.fs.move(f"{mine}.new", mine)            # seen whole or not at all
        for rank in range(self.size):
            yield own if rank == self.rank else self._read(self._name(self.number, rank))
        if self.number:                              # all have read the one before
            self.fs.delete_file(self._name(self.number - 1, self.rank))
        self.number += 1

    def total(self, own: np.ndarray) -> np.ndarray:
        """The sum of all tasks' vectors, the same in each."""
        out = np.zeros(own.shape)
        for found in self.each(own):
            out += found.reshape(own.shape)
        return out


class Alone:
    """The exchange of one task."""

    size = 1

    def each(self, own: np.ndarray) -> Iterator[np.ndarray]:
        yield own

    def total(self, own: np.ndarray) -> np.ndarray:
        return own


class Ranker:
    """A task's part of the validation rows: pairs of a positive and a negative row that a round's margins rank."""

    def __init__(self, y: np.ndarray, exchange: Exchange | Alone):
        self.sides, self.exchange = (np.flatnonzero(y == 1), np.flatnonzero(y != 1)), exchange
        self.counts = exchange.total(np.array([float(len(v)) for v in self.sides]))
        self.won: list[int] = []

    def rank(self, margin: np.ndarray) -> None:
        """Add a round: the rows of the rarer class go to all tasks, those of the other are sorted where they lie."""
        pos, neg = (np.sort(margin[v]) for v in self.sides)
        rare, here = (pos, neg) if self.counts[0] <= self.counts[1] else (neg, pos)
        below = many = 0                             # pairs whose row here is lower, and those of equal rows counted half, twice over
        for some in self.exchange.each(rare):
            below += int(np.searchsorted(here, some, "left").sum()) + int(np.searchsorted(here, some, "right").sum())
            many += 2 * len(here) * len(some)
        self.won.append(below if rare is pos else many - below)

    def aurocs(self) -> list[float | None]:
        """Of all rounds, ties counted half; the counts of pairs are whole numbers."""
        won, pairs = self.exchange.total(np.array(self.won, float)), self.counts[0] * self.counts[1]
        return [0.5 * float(v) / float(pairs) if pairs else None for v in won]


class Grower:
    """A task's part of some rows, of which trees grow together with the other tasks' parts."""

    def __init__(self, bins: Bins, p: BoostParams, P: np.ndarray, y: np.ndarray, w: np.ndarray, margin: np.ndarray,
                 draw: np.ndarray | None, exchange: Exchange | Alone):
        self.bins, self.p, self.P, self.y, self.w, self.margin, self.draw, self.exchange = bins, p, P, y, w, margin, draw, exchange

    def add(self, tree: tuple) -> None:
        """Bring the margins up to date with a tree over bin numbers."""
        *routes, value = tree
        used = sorted({f for f in routes[2] if f >= 0})
        for a in range(0, len(self.y), BLOCK):
            self.margin[a:a + BLOCK] += value[nodes_of(self.bins.unpack(self.P[:, a:a + BLOCK], used), *routes)]

    def grow(self, number: int) -> Tree | None:
        """The next tree, with the margins brought up to date; None if no split improves anything."""
        bins, p, P, n = self.bins, self.p, self.P, len(self.y)
        kept = _bagged(p, number, self.draw) if self.draw is not None else None
        g, h = np.empty(n), np.empty(n)
        for a in range(0, n, BLOCK):
            at = slice(a, a + BLOCK)
            g[at], h[at] = gradients(self.y[at], self.w[at], self.margin[at])
        rows: dict[int, np.ndarray | None] = {0: None if kept is None else np.flatnonzero(kept)}
        growth = Growth(bins, p, _allowed(p, number, len(bins.edges)))
        growth.begin(self.exchange.total(cell_sums(bins, P, g, h, rows[0])))
        while todo := growth.wanted():
            # with others to wait for, several leaves at once: some of them will not be split
            todo, found = todo[:1 if self.exchange.size == 1 else -(-len(todo) // 2)], []
            pairs = {}
            for node in todo:
                at = growth.leaves[node].split[1]
                f = int(bins.feature[at])
                goes = np.take(bins.digit(f) <= at - bins.start[f], P[bins.place[f][0]] if rows[node] is None else np.take(P[bins.place[f][0]], rows[node]))
                left, right = np.flatnonzero(goes), np.flatnonzero(~goes)
                pairs[node] = (left, right) if rows[node] is None else (rows[node][left], rows[node][right])
                rows[node] = np.empty(0, np.intp)
                found.append(cell_sums(bins, P, g, h, pairs[node][0 if growth.smaller_left(node) else 1]))
            growth.receive(dict(zip(todo, self.exchange.total(np.stack(found)))))
            for node in todo:
                rows.update(zip(growth.leaves[node].children, pairs[node]))
        if not growth.applied:
            return None
        tree = growth.tree()
        if kept is not None:
            self.add(_binned_tree(tree, bins))
            return tree
        for leaf in growth.open:
            value, below = leaf_value(growth.leaves[leaf].total[0], growth.leaves[leaf].total[1], p), [leaf]
            while below:                             # a leaf's rows may have been divided ahead of the order
                node = below.pop()
                self.margin[rows[node]] += value
                below += growth.leaves[node].children or ()
        return tree


def nodes_of(B: np.ndarray, left: Sequence[int], right: Sequence[int], feature: Sequence[int], at: Sequence[int]) -> np.ndarray:
    """The leaf that each row (of features x n bin numbers) reaches; a node's children come after it."""
    here = {0: np.ones(B.shape[1], bool)}
    node = np.zeros(B.shape[1], np.uint8 if len(left) <= 256 else np.int32)
    for n in range(len(left)):
        rows = here.pop(n)
        if left[n] >= 0:
            goes = rows & (B[feature[n]] <= at[n])
            here[left[n]], here[right[n]] = goes, rows ^ goes
        elif n:
            node += rows * node.dtype.type(n)
    return node


def gradients(y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic loss, in multiples of 1 / GRID."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.round(w * (p - y) * GRID) / GRID, np.round(w * p * (1.0 - p) * GRID) / GRID


def _allowed(p: BoostParams, number: int, width: int) -> np.ndarray:
    """The features that a round may split on."""
    allowed = np.ones(width, bool)
    if p.feature_fraction < 1:
        allowed[:] = False
        allowed[np.random.default_rng([p.seed, number]).permutation(width)[:max(1, round(p.feature_fraction * width))]] = True
    return allowed


def _bagged(p: BoostParams, number: int, draw: np.ndarray) -> np.ndarray | None:
    """Which rows a round's bag holds; None: all."""
    if p.bagging_fraction >= 1 or p.bagging_freq <= 0:
        return None
    rng = np.random.default_rng([p.seed, number // p.bagging_freq])
    factor, salt = 2 * int(rng.integers(1 << 10, 1 << 20)) + 1, rng.random()
    return (draw * factor + salt) % 1.0 < p.bagging_fraction


def _trees(nodes: pd.DataFrame) -> list[Tree]:
    """Trees of a node table."""
    return [Tree(*[part[c].to_numpy() for c in TREE_COLUMNS]) for _, part in nodes.sort_values(["tree", "node"]).groupby("tree", sort=True)]


def _binned_tree(tree: Tree, bins: Bins) -> tuple[list[int], list[int], list[int], list[int], np.ndarray]:
    """The tree over bin numbers: arguments of :func:`nodes_of`, and the nodes' values."""
    at = [int(np.searchsorted(bins.edges[f], t, side="left")) if f >= 0 else 0 for f, t in zip(tree.feature, tree.threshold)]
    return tree.left.tolist(), tree.right.tolist(), tree.feature.tolist(), at, np.asarray(tree.value, float)


def _coded(v: np.ndarray) -> bytes:
    """Doubles as a byte each into a table of few distinct values, where there are few."""
    values, at = np.unique(v, return_inverse=True)
    if len(values) > 255 or len(v) < 2 * len(values):
        return b"\0" + v.tobytes()
    return bytes([len(values)]) + values.tobytes() + at.astype(np.uint8).tobytes()


def _decoded(data: bytes) -> np.ndarray:
    k = data[0]
    return np.frombuffer(data, offset=1).copy() if not k else np.frombuffer(data, count=k, offset=1)[np.frombuffer(data, np.uint8, offset=1 + 8 * k)]


def _packed_block(row, bins: Bins) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(packed columns, labels, weights, margins, draws) of a block of rows."""
    return (np.frombuffer(row.x, np.uint16).reshape(len(bins.packed), row.n), np.frombuffer(row.y, np.uint8), _decoded(row.w),
            np.frombuffer(row.margin), None if row.draw is None else np.frombuffer(row.draw))


def _block(row, bins: Bins) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(bin numbers, labels, weights, margins, draws) of a block of rows."""
    P, *rest = _packed_block(row, bins)
    return bins.unpack(P), *rest


def _written(spark: SparkSession, df: DataFrame, schema: str, parts: int) -> tuple[DataFrame, str]:
    """Blocks that several passes read, as files beside the checkpoints, and their folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    df.write.option("compression", "none").parquet(path)
    return spark.read.schema(schema).parquet(path).coalesce(parts), path


def slots(spark: SparkSession) -> int:
    """Tasks that can run at the same time and meet in the shared folder; 1 if that cannot be relied on."""
    try:
        sc = spark.sparkContext
        if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
            return 1
        fs.FileSystem.from_uri(checkpoint_dir(spark))
        scala = sc._jsc.sc()
        return max(1, int(scala.maxNumConcurrentTasks(scala.resourceProfileManager().defaultResourceProfile())))
    except Exception:  # a remote session, or a folder that tasks cannot open: one task, or passes
        return 1


@dataclass
class Binned:
    """Training and validation rows, binned once; any number of fits read them."""

    rows: DataFrame
    features: list[str]
    edges: list[np.ndarray]
    init: float
    parts: int
    train_rows: int
    valid_rows: int
    folder: str
    bundles: list[list[int]]

    def bins(self) -> Bins:
        return Bins(self.edges, self.bundles)

    def unpersist(self) -> None:
        self.rows.unpersist()
        remove_folder(self.rows.sparkSession, self.folder)


def bin_rows(train: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = "weight",
             valid: DataFrame | None = None, max_bins: int = 255, start: BoostedTrees | None = None) -> Binned:
    """Bin the rows (with the bins of ``start``, if given) and keep them; rows without a label are left out.

    With ``weight`` absent from the rows, classes are balanced.
    """
    from . import models
    if start is not None and start.features != list(features):
        raise ValueError("a fit goes on only with the features it began with")
    if weight and weight not in train.columns:
        train = models.with_class_weights(train, label, weight)

    def narrow(df: DataFrame, w, is_valid: bool) -> DataFrame:
        x = _row(features)
        # what a row draws for bagging depends on its values alone, never on where it lies
        draw = F.shiftrightunsigned(F.xxhash64(x, F.col(label)), 11).cast("double") / float(1 << 53)
        return df.where(F.col(label).isNotNull()).select(F.lit(is_valid).alias("valid"), F.when(F.col(label) == 1, 1.0).otherwise(0.0).alias("y"),
                                                         w.alias("w"), x.alias("x"), draw.alias("draw"))

    own = narrow(train, F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0), False)
    edges, init = (start.edges, start.init) if start else (bin_edges(train, features, max_bins), 0.0)
    if start is None:
        totals = own.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("p")).first()
        if totals["w"] and 0 < totals["p"] < totals["w"]:     # else one class alone: no first guess
            init = float(np.log(totals["p"] / (totals["w"] - totals["p"])))
    both = own if valid is None else own.unionByName(narrow(valid, F.lit(1.0), True))
    width, plain = len(features), Bins(edges)
    # how indicators are bundled is guessed from some rows and checked on all of them as they are packed
    some = both.select("x").limit(BLOCK).toArrow()["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    bundles = exclusive(plain.of(some), plain.two.tolist())
    spark = both.sparkSession
    while True:
        with small_methods(spark):
            binned, folder = _written(spark, both.mapInArrow(_packing(Bins(edges, bundles), bundles, init), BINNED), BINNED, 1 << 20)
        train_rows, count, wrong = binned.agg(F.coalesce(F.sum(F.when(~F.col("valid"), F.col("n"))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)),
                                              F.collect_set(F.when(F.col("n") == 0, F.col("y")))).first()
        if not wrong:
            break
        remove_folder(spark, folder)
        wrong = {k for found in wrong for k in json.loads(bytes(found))}
        bundles = [b for k, b in enumerate(bundles) if k not in wrong]
    # a row is small: hundreds of passes over them pay for full partitions
    parts = max(1, -(-count * (width + ROW_BYTES) // PART_BYTES))
    return Binned(binned.coalesce(parts), list(features), edges, init, parts, train_rows, count - train_rows, folder, bundles)


def _packing(bins: Bins, bundles: Sequence[Sequence[int]], init: float):
    """Function of Arrow batches of rows to blocks; a row of n = 0 names the bundles of which a row has two indicators set."""
    width = len(bins.edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong: set[int] = set()
        held: dict[bool, list] = {False: [], True: []}
        types = pa.schema([("valid", pa.bool_()), ("n", pa.int32()), *((c, pa.binary()) for c in ("y", "w", "x", "margin", "draw"))])

        def block(valid: bool) -> pa.RecordBatch:
            P, y, w, draw = (np.concatenate(v, axis=-1) for v in zip(*held[valid]))
            held[valid] = []
            return pa.RecordBatch.from_pylist([{"valid": valid, "n": len(y), "y": y.astype(np.uint8).tobytes(), "w": _coded(w), "x": P.tobytes(),
                                                "margin": np.full(len(y), init).tobytes(), "draw": draw.tobytes()}], types)
        for batch in batches:
            X = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            is_valid = batch.column("valid").to_numpy(zero_copy_only=False)
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "draw")]
            for valid in (False, True):
                some = np.flatnonzero(is_valid == valid)
                for k in range(0, len(some), BLOCK):
                    at = some[k:k + BLOCK]
                    B = bins.of(X[at])
                    wrong |= {j for j, b in enumerate(bundles) if B[b].sum(axis=0, dtype=np.uint16).max() > 1}
                    held[valid].append((bins.pack(B), *(v[at] for v in values)))
                    if sum(len(v[1]) for v in held[valid]) >= BLOCK:
                        yield block(valid)
        for valid in (False, True):
            if held[valid]:
                yield block(valid)
        if wrong:
            yield pa.RecordBatch.from_pylist([{"valid": None, "n": 0, "y": json.dumps(sorted(wrong)).encode()}], types)
    return run


class Booster:
    """A run of boosting over binned rows; ``steps`` grows trees. ``share``: how many fits share the slots at present."""

    def __init__(self, data: Binned, params: BoostParams, start: BoostedTrees | None = None, local_rows: int | None = None,
                 share: Callable[[], int] = lambda: 1):
        self.params, self.parts, self.train_rows, self.valid_rows = params, data.parts, data.train_rows, data.valid_rows
        self.spark = data.rows.sparkSession
        self.local_rows = LOCAL_BYTES // (len(data.edges) + 16) if local_rows is None else local_rows
        self.model = BoostedTrees(data.features, data.init, list(start.trees) if start else [], data.edges, params)
        self.bins = data.bins()
        self.share, self.rows, self.need = share, data.rows, 1
        if local_rows is None:
            self.need = max(1, -(-(self.train_rows + self.valid_rows) * (2 * len(self.bins.packed) + 72) // TASK_BYTES))
            fits = self.need <= slots(self.spark) and self.valid_rows <= RANK_ROWS
        else:
            fits = self.train_rows <= self.local_rows
        self.most = None if local_rows is None else 1
        self.tasks = self._tasks() if fits else 0
        self.train, self.valid = data.rows.where("not valid"), data.rows.where("valid")
        if not fits:
            self.train = self.train.persist(StorageLevel.MEMORY_AND_DISK)
        self.train_pending, self.pending = list(self.model.trees), list(self.model.trees)
        self.looked: list[tuple[int, float | None]] = []
        self.folders: dict[str, str] = {}
        self.settle()

    def _tasks(self) -> int:
        """Tasks that hold all rows while trees grow; 0 in their place: the rows are gone over in passes."""
        most = slots(self.spark) // max(1, self.share()) if self.most is None else self.most
        return max(self.need, min(most, -(-self.train_rows // ALONE_ROWS)))

    def close(self) -> None:
        self.train.unpersist()
        for folder in self.folders.values():
            remove_folder(self.spark, folder)

    def _keep(self, kind: str, df: DataFrame, schema: str = BINNED) -> DataFrame:
        """Write the rows of a kind anew and drop what was written of them before."""
        out, folder = _written(self.spark, df, schema, self.parts)
        if kind in self.folders:
            remove_folder(self.spark, self.folders[kind])
        self.folders[kind] = folder
        return out

    def _brought_up(self, pending: Sequence[Tree]):
        """Function of (bin numbers, kept margins) to present margins; a closure over few small trees."""
        trees = [_binned_tree(t, self.bins) for t in pending]

        def margins(B: np.ndarray, margin: np.ndarray) -> np.ndarray:
            for *tree, value in trees:
                margin = margin + value[nodes_of(B, *tree)]
            return margin
        return margins

    def settle(self) -> None:
        """Bring the kept margins up to date (tasks that hold all rows do so themselves)."""
        if self.pending and not self.tasks:
            old = self.train
            self.valid = self._keep("valid", self._settled(self.valid, self.pending))
            self.train = self._keep("train", self._settled(old, self.pending)).persist(StorageLevel.MEMORY_AND_DISK)
            old.unpersist()
        if not self.tasks:
            self.train_pending = []
        self.pending = []

    def _settled(self, rows: DataFrame, pending: Sequence[Tree]) -> DataFrame:
        margins, bins = self._brought_up(pending), self.bins

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [margins(B, margin).tobytes() for B, _, _, margin, _ in (_block(row, bins) for row in batch.itertuples(index=False))]
                yield batch.assign(margin=found)
        return rows.mapInPandas(run, BINNED)

    def _pass(self, growth: Growth, nodes: Sequence[int], number: int, whole: bool) -> pd.DataFrame:
        """One pass over the training rows: sums of the smaller children of ``nodes`` (of the root, if it
        has no split yet), or, with ``whole``, the rows of ``nodes`` brought together and their subtrees grown."""
        bins, margins, width, p, allowed = self.bins, self._brought_up(self.train_pending), len(self.bins.edges), self.params, growth.allowed
        tables = growth.tables()
        root = not growth.leaves or whole
        sides = {n: None if root else (growth.leaves[n].split[1], growth.smaller_left(n)) for n in nodes}

        def routed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
            """(ends, bins, gradients, hessians) of a block's rows that belong to the targets, target after target."""
            for row in (row for batch in batches for row in batch.itertuples(index=False)):
                B, y, w, margin, draw = _block(row, bins)
                node = nodes_of(B, *tables) if len(tables[0]) else np.zeros(row.n, np.uint8)
                kept = _bagged(p, number, draw)
                found = []
                for n in nodes:
                    here = node == n if kept is None else (node == n) & kept
                    if sides[n]:
                        at, is_left = sides[n]
                        here &= (B[bins.feature[at]] <= at - bins.start[bins.feature[at]]) == is_left
                    found.append(np.flatnonzero(here))
                used = np.concatenate(found)
                if len(used):
                    B = B if len(used) == row.n and len(nodes) == 1 else np.take(B, used, axis=1)
                    g, h = gradients(y[used], w[used], margins(B, margin[used]))
                    yield np.cumsum([len(v) for v in found]), B, g, h

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(nodes), 3, bins.n))
            for ends, B, g, h in routed(batches):
                total += bin_sums(bins, B, g, h, ends)
            out = [(n, c, total[k, :, bins.start[c]:bins.start[min(width, c + CHUNK)]].ravel())
                   for k, n in enumerate(nodes) if total[k, 2].any() for c in range(0, width, CHUNK)]
            yield pd.DataFrame(out, columns=["node", "chunk", "sums"])

        def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for ends, B, g, h in routed(batches):
                parts = [(n, slice(a, b)) for n, a, b in zip(nodes, [0, *ends[:-1]], ends) if b > a]
                yield pd.DataFrame({"node": [n for n, _ in parts], "x": [B[:, s].tobytes() for _, s in parts],
                                    "g": [g[s].tobytes() for _, s in parts], "h": [h[s].tobytes() for _, s in parts]})

        places = {n: (growth.leaves[n].depth, growth.leaves[n].path) for n in nodes if n in growth.leaves}

        def grown(rows: pd.DataFrame) -> pd.DataFrame:
            n = int(rows["node"].iloc[0])
            B = np.concatenate([np.frombuffer(x, np.uint8).reshape(width, len(g) // 8) for x, g in zip(rows["x"], rows["g"])], axis=1)
            got = grow_here(Growth(bins, p, allowed, *places[n]), B, np.frombuffer(b"".join(rows["g"])), np.frombuffer(b"".join(rows["h"])))
            out = pd.DataFrame(got.as_rows(), columns=["left", "right", "gain", "at", "g", "h", "c"])
            return out.assign(node=n, k=np.arange(len(out)))[["node", "k", "left", "right", "gain", "at", "g", "h", "c"]]

        if whole:
            moved = self.train.mapInPandas(rows_of, "node int, x binary, g binary, h binary").groupBy("node")
            return moved.applyInPandas(grown, SUBTREE).toPandas()
        parts = self.train.mapInPandas(sums, "node int, chunk int, sums array<double>")
        if self.parts > 1:
            parts = parts.groupBy("node", "chunk").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        return parts.toPandas()

    def _known(self, growth: Growth, nodes: Sequence[int], number: int) -> dict[int, np.ndarray]:
        found, width, bins = self._pass(growth, nodes, number, whole=False), len(self.bins.edges), self.bins
        out = {n: np.zeros((3, bins.n)) for n in nodes}
        for n, c, sums in zip(found["node"], found["chunk"], found["sums"]):
            out[n][:, bins.start[c]:bins.start[min(width, c + CHUNK)]] = np.asarray(sums).reshape(3, -1)
        return out

    def steps(self, count: int) -> bool:
        """Grow up to ``count`` trees; False if no split improves anything before that. Tasks that hold all training
        rows grow these trees together, with the same result as tree by tree."""
        if not self.tasks:
            return all(self.step() for _ in range(count))
        self.tasks = self._tasks()
        bins, p, begun, size = self.bins, self.params, len(self.model.trees), self.tasks
        pending = [_binned_tree(t, bins) for t in self.train_pending]
        bagging = p.bagging_fraction < 1 and p.bagging_freq > 0
        meeting = f"{checkpoint_dir(self.spark).rstrip('/')}/meeting-{uuid.uuid4().hex}"

        def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            blocks: dict[bool, list] = {False: [], True: []}
            held: dict[bool, list] = {False: [], True: []}
            for row in (row for batch in batches for row in batch.itertuples(index=False)):
                held[row.valid].append(_packed_block(row, bins))
                blocks[row.valid].append((row.n, row.y, row.w, row.x, row.draw))
            rank, exchange = 0, Alone()
            if size > 1:
                context = BarrierTaskContext.get()
                rank = context.partitionId()
                # a stage that is run again meets elsewhere; Spark's own exchange takes a second a time
                exchange = Exchange(f"{meeting}/{context.allGather(uuid.uuid4().hex)[0]}", rank, size)

            def part(valid: bool) -> Grower:
                none = np.empty((len(bins.packed), 0), np.uint16), np.empty(0, np.uint8), *[np.empty(0)] * 3
                P, y, w, margin, draw = (np.concatenate(v, axis=-1) if v[-1] is not None else None for v in zip(none, *held[valid]))
                held[valid] = []
                return Grower(bins, p, P, y, w, margin, draw if bagging else None, exchange)
            train, valid = part(False), part(True)
            for tree in pending:
                train.add(tree)
                valid.add(tree)
            trees, ranker = [], Ranker(valid.y, exchange) if look else None
            while len(trees) < count and (tree := train.grow(begun + len(trees))) is not None:
                trees.append([getattr(tree, c) for c in TREE_COLUMNS])
                if ranker:
                    valid.add(_binned_tree(tree, bins))
                    ranker.rank(valid.margin)
            aurocs = ranker.aurocs() if ranker else []
            for is_valid, of in ((False, train), (True, valid)):
                a = 0
                for n, *kept, draws in blocks[is_valid]:
                    yield pd.DataFrame({"valid": [is_valid], "n": [n], **{c: [v] for c, v in zip("ywx", kept)},
                                        "margin": [of.margin[a:a + n].tobytes()], "draw": [draws], "found": [None]})
                    a += n
            if not rank:
                yield pd.DataFrame({"valid": [None], "n": [0], **{c: [None] for c in ("y", "w", "x", "margin", "draw")},
                                    "found": [pickle.dumps((trees, aurocs))]})

        look, state = self.valid_rows > 0, f"{BINNED}, found binary"
        kept = self._keep("rows", self.rows.repartition(size).mapInPandas(grown, state, barrier=size > 1), state)
        if size > 1:
            remove_folder(self.spark, meeting)
        trees, aurocs = pickle.loads(kept.where("found is not null").first()["found"])
        new = [Tree(*t) for t in trees]
        self.rows, self.train_pending = kept.where("found is null").drop("found"), []
        self.looked = [(begun + k + 1, a) for k, a in enumerate(aurocs)]
        self.model.trees += new
        self.pending += new
        return len(new) == count

    def step(self) -> bool:
        """Grow one tree; False if no split improves anything."""
        p, number = self.params, len(self.model.trees)
        growth = Growth(self.bins, p, _allowed(p, number, len(self.bins.edges)))
        if self.train_rows <= self.local_rows:
            growth.begin_unseen(np.array([0.0, 0.0, float(self.train_rows)]))
        else:
            growth.begin(self._known(growth, [0], number)[0])
        while todo := growth.wanted():
            # a leaf of few rows is grown to its end in one task, all others a level a pass
            small = [n for n in todo if growth.leaves[n].total[2] <= self.local_rows]
            large = [n for n in todo if growth.leaves[n].total[2] > self.local_rows]
            if large:
                growth.receive(self._known(growth, large, number))
            if small:
                subtrees = self._pass(growth, small, number, whole=True).sort_values(["node", "k"])
                for n in small:
                    growth.graft(n, subtrees[subtrees["node"] == n][["left", "right", "gain", "at", "g", "h", "c"]].to_numpy().tolist())
                    growth.leaves[n].done = True
                    if growth.leaves[n].split == (np.inf, -1):      # a bag without rows
                        growth.leaves[n].split = None
        if not growth.applied:
            return False
        tree = growth.tree()
        self.model.trees.append(tree)
        self.pending.append(tree)
        self.train_pending.append(tree)
        return True

    def recent_auroc(self) -> list[tuple[int, float | None]]:
        """(round, validation AUROC) of the rounds since the margins were kept, by exact margins."""
        if self.tasks:
            return self.looked
        trees, done, bins = [_binned_tree(t, self.bins) for t in self.pending], len(self.model.trees) - len(self.pending), self.bins

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row in (row for batch in batches for row in batch.itertuples(index=False)):
                B, y, _, margin, _ = _block(row, bins)
                for k, (*tree, value) in enumerate(trees):
                    margin = margin + value[nodes_of(B, *tree)]
                    scores, at = np.unique(margin, return_inverse=True)
                    pos = np.bincount(at, y, len(scores))
                    yield pd.DataFrame({"iteration": done + k + 1, "score": scores, "pos": pos.astype(np.int64),
                                        "neg": (np.bincount(at, minlength=len(scores)) - pos).astype(np.int64)})

        cells = self.valid.mapInPandas(run, "iteration int, score double, pos bigint, neg bigint")
        return [(r["iteration"], r["auroc"]) for r in auroc_by(cells, ["iteration"]).collect()]


def auroc_by(cells: DataFrame, g: Sequence[str]) -> DataFrame:
    """(group, auroc) of partial (group, score, pos, neg) counts, ties counted half; blocked at every size."""
    hist = cells.groupBy(*g, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pos, neg, tp = (F.col(c).cast("double") for c in ("pos", "neg", "tp"))
    P, N = F.sum(pos), F.sum(neg)
    return curves.running_totals(hist, g).groupBy(*g).agg(
        F.when((P > 0) & (N > 0), (F.sum(neg * (tp - pos)) + F.lit(0.5) * F.sum(neg * pos)) / (P * N)).alias("auroc"))


def stop_at(history: Sequence[tuple[int, float | None]], patience: int) -> tuple[int | None, bool]:
    """(best round so far, whether ``patience`` rounds have passed without a better AUROC), at 12 decimals."""
    best_i, best = None, None
    for i, a in sorted(history):
        a = None if a is None else round(a, 12)
        if a is not None and (best is None or a > best):
            best_i, best = i, a
        if best_i is not None and i - best_i >= patience:
            return best_i, True
    return best_i, False


def run_rounds(data: Binned, params: BoostParams, patience: int = 50, start: BoostedTrees | None = None, refresh: int = 25,
               local_rows: int | None = None, has_valid: bool = True, history: Sequence[tuple[int, float | None]] = (),
               on_block=None, share: Callable[[], int] = lambda: 1) -> tuple[BoostedTrees, list[tuple[int, float | None]], bool]:
    """Boost over binned rows up to ``params.rounds`` trees: (all trees grown, AUROC by round, whether the run
    is over: the patience rule fired or no split improves anything). ``history`` is that of ``start``.
    ``on_block(round, history)`` is called after each ``refresh`` rounds; if it returns False the run ends there."""
    run, history, over = Booster(data, params, start, local_rows, share), list(history), False
    try:
        while len(run.model.trees) < params.rounds and not over:
            over = not run.steps(min(refresh, params.rounds - len(run.model.trees)))
            if run.pending and has_valid:
                history += run.recent_auroc()
                over = over or stop_at(history, patience)[1]
            if not over and on_block is not None and on_block(len(run.model.trees), history) is False:
                break
            if not over:
                run.settle()
    finally:
        run.close()
    return run.model, history, over


def fit_boosted(train: DataFrame, features: Sequence[str], label: str = "label", params: BoostParams = BoostParams(),
                weight: str | None = "weight", valid: DataFrame | None = None, patience: int = 50, start: BoostedTrees | None = None,
                refresh: int = 25, local_rows: int | None = None, on_block=None) -> tuple[BoostedTrees, list[tuple[int, float | None]]]:
    """M4 + M5: at most ``params.rounds`` trees in all, kept up to the best validation AUROC when the patience
    rule fires or the rounds are done. Returns the model and the AUROC by round ([] without ``valid``).
    ``start`` goes on from a fitted ensemble."""
    data = bin_rows(train, features, label, weight, valid, params.max_bins, start)
    try:
        model, history, _ = run_rounds(data, params, patience, start, refresh, local_rows, valid is not None, on_block=on_block)
    finally:
        data.unpersist()
    best = stop_at(history, patience)[0]
    return (model if best is None else model.first(best)), history
