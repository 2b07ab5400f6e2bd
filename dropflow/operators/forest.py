"""Random forests on binned rows, as Spark jobs (L1, L4).

Features are cut into at most 32 bins (every value of a feature with fewer), so a
training row is a byte per feature; the blocks of rows are those of the booster.
Every tree sees each row as often as a Poisson draw of mean 1 says, a function of
(seed, tree, block), so a retried task sees the same rows. Splits are exact over
the bins: Gini impurity of the weighted classes, or variance.

* Nodes whose rows fit in one task (``LOCAL_CELLS``) are finished there, all nodes
  of a level at a time: no sums of small nodes are shuffled. If the whole table is
  that small, a task reads its blocks and grows some trees.
* In a larger table, ``WAVE`` trees at a time, the nodes that are too large for a
  task are split by jobs, a level a job: tasks sum their rows per node, sampled
  feature and bin, the sums of a node meet in a task that finds its best split.
  The rows of the smaller nodes then go to a task each.

What reaches the driver is the fitted trees: 8 bytes a node and the values of leaves.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, workers_import
from .boosting import Block, bin_rows, blocks, cut_points
from .saved import SavedState

#: Cut points of a feature; features of fewer values are looked for among so many quantiles.
MAX_CUTS = 31
FINE_CUTS = 254
#: A node with at most this many cells (rows x features) is finished inside one task.
LOCAL_CELLS = 64_000_000
#: Cells that make another task worth while when blocks are read by jobs, and cells of sums held at once.
TASK_CELLS = 4_000_000
SUM_CELLS = 1_000_000
#: Vectors of more features are not spread out if a node considers few of them (``wide_forest``).
WIDE = 1_000
#: Trees that a task grows on a small table, and trees of a large table that grow at a time.
TASK_TREES = 5
WAVE = 20


@dataclass(frozen=True)
class ForestSpec:
    """``classes`` is the number of label values of a classifier, 0 asks for a regression."""

    trees: int = 100
    classes: int = 0
    max_depth: int = 30
    min_rows: int = 1                 # least rows (as often as drawn) of a leaf
    sqrt_features: bool = False       # else a node considers all features
    bagging: bool = True
    seed: int = 42

    def sampled(self, features: int) -> int:
        return math.ceil(math.sqrt(features)) if self.sqrt_features else features

    def draws(self, tree: int, block: Block) -> np.ndarray:
        """How often a tree sees each row of a block."""
        if not self.bagging:
            return np.ones(len(block.y))
        return np.random.default_rng([self.seed, tree, *block.key]).poisson(1.0, len(block.y)).astype(float)


class Cuts:
    """Cut points of all features in a row: a split is told by the place of its cut."""

    def __init__(self, cuts: list[np.ndarray]) -> None:
        self.cuts = cuts
        sizes = np.array([len(c) for c in cuts], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.feature = np.repeat(np.arange(len(cuts)), sizes)
        self.cut = np.arange(int(sizes.sum())) - np.repeat(self.first, sizes)
        self.bins = int(sizes.max(initial=0)) + 1


@dataclass
class Tree:
    """Nodes by level: place of the cut, -1 for a leaf; the left child (the right one follows), or the leaf's row of values."""

    code: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaves(self, binned: np.ndarray, cuts: Cuts) -> np.ndarray:
        """The node of each row of binned columns (feature x row)."""
        node = np.zeros(binned.shape[1], np.int64)
        rows = np.arange(binned.shape[1]) if self.code[0] >= 0 else np.zeros(0, np.int64)
        while len(rows):
            code = self.code[node[rows]]
            below = self.left[node[rows]] + (binned[cuts.feature[code], rows] > cuts.cut[code])
            node[rows] = below
            rows = rows[self.code[below] >= 0]
        return node


# --- sums and splits -----------------------------------------------------------------------------

def weights_of(y: np.ndarray, w: np.ndarray, classes: int) -> tuple[np.ndarray, ...]:
    """What a node sums of its rows: (class, weight) or (label, weight)."""
    return (y.astype(np.int64), w) if classes else (y, w)


def sums(at: np.ndarray, size: int, y: np.ndarray, w: np.ndarray, c: np.ndarray, classes: int) -> np.ndarray:
    """(sums x size) of rows at places: the weight of each class (or weighted labels and weight), then the rows."""
    found = np.empty(((classes or 2) + 1, size))
    found[-1] = np.bincount(at, c, size)
    if classes:
        found[:-1] = np.bincount(y * size + at, w, size * classes).reshape(classes, size)
    else:
        found[0] = np.bincount(at, y * w, size)
        found[1] = found[-1] if w is c else np.bincount(at, w, size)
    return found


def weight(s: np.ndarray, classes: int) -> np.ndarray:
    return s[:-1].sum(0) if classes else s[1]


def purity(s: np.ndarray, classes: int) -> np.ndarray:
    """Weight x (1 - impurity) of sums, up to a constant: a split's gain is what its sides have more than their parent."""
    if not classes:
        return s[0] * s[0] / np.maximum(s[1], 1e-300)
    return np.einsum("kn,kn->n", s[:-1], s[:-1]) / np.maximum(weight(s, classes), 1e-300)


def best_cuts(hist: np.ndarray, node: np.ndarray, total: np.ndarray, spec: ForestSpec) -> tuple[np.ndarray, np.ndarray]:
    """(gain, place) of the best cut of each node, -inf if none is allowed.

    ``hist`` (sums x place) has the places of the first node's bins, then the next one's, and so on; places without
    rows may be left out. ``node`` is the node of each place (every node has one), ``total`` (sums x node) its sums.
    """
    left = np.cumsum(hist, 1)
    first = np.flatnonzero(np.diff(node, prepend=-1))
    left -= (left[:, first] - hist[:, first])[:, node]
    right = total[:, node] - left
    least = max(spec.min_rows, 1) - 0.5
    gain = purity(left, spec.classes) + purity(right, spec.classes)
    gain[(left[-1] < least) | (right[-1] < least)] = -np.inf
    best = np.maximum.reduceat(gain, first)
    at = np.flatnonzero(gain == best[node])
    return best - purity(total, spec.classes), at[np.flatnonzero(np.diff(node[at], prepend=-1))]


def may_split(total: np.ndarray, depth: int, spec: ForestSpec) -> np.ndarray:
    """Of nodes by their sums (sums x node), those whose rows may be parted."""
    w = weight(total, spec.classes)
    mixed = purity(total, spec.classes) < w * (1 - 1e-9) if spec.classes else w > 0
    return (total[-1] > 2 * max(spec.min_rows, 1) - 0.5) & mixed & (depth < spec.max_depth)


def gains_enough(gain: np.ndarray, total: np.ndarray, spec: ForestSpec) -> np.ndarray:
    return gain > 1e-9 * weight(total, spec.classes)          # labels of a regression have variance 1


def features_of(spec: ForestSpec, features: int, nodes: int, key: tuple) -> np.ndarray | None:
    """The features that each node considers (node x feature); None for all."""
    take = spec.sampled(features)
    if take >= features:
        return None
    return np.random.default_rng([spec.seed, *key]).random((nodes, features)).argpartition(take, 1)[:, :take]


def grown_here(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: np.ndarray, cuts: Cuts, spec: ForestSpec,
               key: tuple, depth: int = 0) -> tuple[Tree, np.ndarray]:
    """The subtree of a node's rows (feature x row; labels, weights and draws of each) and the gains by feature."""
    d, n = x.shape
    flat, classes = x.reshape(-1), spec.classes
    order, nodes, count = np.flatnonzero(c > 0), 1, 0
    slot = np.zeros(len(order), np.int64)
    codes, lefts, totals, gains, level = [], [], [], np.zeros(d), 0
    w = c if (w == 1).all() else w * c
    while nodes:
        total = sums(slot, nodes, y[order], w[order], c[order], classes)
        code, left = np.full(nodes, -1, np.int32), np.zeros(nodes, np.int32)
        codes.append(code), lefts.append(left), totals.append(total)
        count += nodes
        open_ = np.flatnonzero(may_split(total, depth + level, spec))
        if len(open_) < nodes:
            number = np.full(nodes, -1)
            number[open_] = np.arange(len(open_))
            slot = number[slot]
            order, slot = order[slot >= 0], slot[slot >= 0]
        total = total[:, open_]
        gain, feature, cut = _best_of_level(flat, n, d, order, slot, total, y, w, c, cuts, spec, (*key, level))
        split = gains_enough(gain, total, spec)
        np.add.at(gains, feature[split], gain[split])
        code[open_[split]] = cuts.first[feature[split]] + cut[split]
        left[open_[split]] = count + 2 * np.arange(split.sum())
        keep = split[slot]
        order, slot = order[keep], slot[keep]
        right = flat[feature[slot] * n + order] > cut[slot]
        slot = 2 * (np.cumsum(split) - 1)[slot] + right
        by = np.argsort(slot, kind="stable")
        order, slot, nodes, level = order[by], slot[by], 2 * int(split.sum()), level + 1
    return made_tree(np.concatenate(codes), np.concatenate(lefts), np.concatenate(totals, 1), spec), gains


def _best_of_level(flat, n, d, order, slot, total, y, w, c, cuts: Cuts, spec: ForestSpec, key: tuple):
    """(gain, feature, cut) of each node of a level by its sums (sums x node); rows are in order of their nodes."""
    nodes = total.shape[1]
    best, feature, cut = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    sampled = features_of(spec, d, nodes, key) if nodes else None
    step = max(1, SUM_CELLS // cuts.bins)
    for a in range(0, nodes, step):
        some = slice(a, min(a + step, nodes))
        size = (some.stop - a) * cuts.bins
        here = slice(*np.searchsorted(slot, [a, some.stop]))
        rows, own = order[here], slot[here] - a
        y_, c_, place = y.take(rows), c.take(rows), own * cuts.bins
        w_ = c_ if w is c else w.take(rows)
        number = np.empty(size, np.int64) if size > len(rows) else None
        for j in range(d if sampled is None else sampled.shape[1]):
            f = np.full(some.stop - a, j) if sampled is None else sampled[some, j]
            bins = flat[j * n:(j + 1) * n].take(rows) if sampled is None else flat.take(f[own] * n + rows)
            at = place + np.minimum(bins, cuts.bins - 1)
            if number is None:
                hist = sums(at, size, y_, w_, c_, spec.classes)
                found = np.flatnonzero(hist[-1])
                hist = hist[:, found]
            else:                                             # of deep nodes' bins, most have no row
                found = np.flatnonzero(np.bincount(at, minlength=size))
                number[found] = np.arange(len(found))
                hist = sums(number[at], len(found), y_, w_, c_, spec.classes)
            gain, place_ = best_cuts(hist, found // cuts.bins, total[:, some], spec)
            better = gain > best[some]
            best[some] = np.where(better, gain, best[some])
            feature[some] = np.where(better, f, feature[some])
            cut[some] = np.where(better, found[place_] % cuts.bins, cut[some])
    return best, feature, cut


def made_tree(code: np.ndarray, left: np.ndarray, total: np.ndarray, spec: ForestSpec) -> Tree:
    leaf = code < 0
    left[leaf] = np.arange(leaf.sum())
    return Tree(code.astype(np.int32), left.astype(np.int32), leaf_values(total[:, leaf], spec))


def leaf_values(total: np.ndarray, spec: ForestSpec) -> np.ndarray:
    """Shares of the classes, or the mean label, of each leaf."""
    if spec.classes:
        return (total[:-1] / np.maximum(weight(total, spec.classes), 1e-300)).T.astype(np.float32)
    return (total[0] / np.maximum(total[1], 1e-300))[:, None]


# --- trees of a small and of a large table -------------------------------------------------------

def _forest_here(made: DataFrame, cuts: Cuts, spec: ForestSpec, scale: tuple[float, float]) -> list[tuple[Tree, np.ndarray]]:
    """All trees of a table that fits in a task: each task reads the blocks and grows a few."""
    sc = made.sparkSession.sparkContext
    shared = sc.broadcast(cuts)
    shares = [list(range(t, min(t + TASK_TREES, spec.trees))) for t in range(0, spec.trees, TASK_TREES)]

    def run(pairs):
        own, held = None, []
        for own, row in pairs:
            held.append(_block(row, scale))
        if own is None:
            return
        held.sort(key=lambda b: b.key)
        x, y, w = (np.concatenate([getattr(b, f) for b in held], axis=-1) for f in ("x", "y", "w"))
        y, w = weights_of(y, w, spec.classes)
        for t in own:
            c = np.concatenate([spec.draws(t, b) for b in held])
            yield t, grown_here(x, y, w, c, shared.value, spec, (t, 0))

    # one task for each share of the trees; the blocks' partitions are read one after the other, without a shuffle
    pairs = sc.parallelize(shares, len(shares)).cartesian(made.rdd.coalesce(1))
    return [grown for _, grown in sorted(pairs.mapPartitions(run).collect(), key=lambda g: g[0])]


def _block(row, scale: tuple[float, float]) -> Block:
    block = Block.of(row, 1)
    return replace(block, y=(block.y - scale[0]) / scale[1])


class Growing:
    """A tree of a large table while its large nodes are split by jobs."""

    def __init__(self, features: int) -> None:
        self.code, self.left, self.depth, self.total, self.gains = [-1], [0], [0], [None], np.zeros(features)
        self.below: dict[int, Tree] = {}                      # subtrees that tasks finished

    def sketch(self) -> Tree:
        return Tree(np.array(self.code), np.array(self.left), np.zeros((0, 1)))

    def split(self, i: int, code: int, sides: list[np.ndarray]) -> list[int]:
        self.code[i], self.left[i] = code, len(self.code)
        for total in sides:
            self.code.append(-1), self.left.append(0), self.depth.append(self.depth[i] + 1), self.total.append(total)
        return [self.left[i], self.left[i] + 1]

    def tree(self, spec: ForestSpec) -> Tree:
        """The whole tree, finished subtrees in place of their nodes."""
        code, left, values, at, leaves = [np.array(self.code)], [np.array(self.left)], [], len(self.code), 0
        for i, own in enumerate(self.code):
            if own >= 0:
                continue
            sub = self.below.get(i)
            if sub is None:                                   # a large node without a split
                values.append(leaf_values(self.total[i][:, None], spec))
                left[0][i], leaves = leaves, leaves + 1
                continue
            inner = sub.code >= 0
            moved = np.where(inner, sub.left + (at - 1), sub.left + leaves)
            code[0][i], left[0][i] = sub.code[0], moved[0]    # its root takes the node's place, the others follow
            code.append(sub.code[1:]), left.append(moved[1:]), values.append(sub.value)
            at, leaves = at + len(sub.code) - 1, leaves + len(sub.value)
        return Tree(np.concatenate(code).astype(np.int32), np.concatenate(left).astype(np.int32), np.concatenate(values))


def _forest_by_jobs(made: DataFrame, partitions: int, features: int, rows: int, cuts: Cuts, spec: ForestSpec, scale: tuple[float, float]):
    sc = made.sparkSession.sparkContext
    shared, small = sc.broadcast(cuts), LOCAL_CELLS // max(1, features)
    state = made.rdd.map(lambda row: _block(row, scale))
    for start in range(0, spec.trees, WAVE):
        growing = {t: Growing(features) for t in range(start, min(start + WAVE, spec.trees))}
        due = {t: [0] for t in growing}
        near: dict[int, list[int]] = {t: [] for t in growing}
        while any(due.values()):
            sketches = {t: (growing[t].sketch(), ids) for t, ids in due.items() if ids}
            found = _split_large(state, partitions, sketches, shared, spec)
            due = {t: [] for t in growing}
            for (t, i), (total, gain, feature, cut, left) in sorted(found.items()):
                tree = growing[t]
                if tree.total[i] is None:
                    tree.total[i] = total
                if not gains_enough(gain, total, spec):
                    continue
                tree.gains[feature] += gain
                for j in tree.split(i, int(cuts.first[feature] + cut), [left, total - left]):
                    if may_split(tree.total[j][:, None], tree.depth[j], spec)[0]:
                        (near if tree.total[j][-1] <= small else due)[t].append(j)
        sketches = {t: (growing[t].sketch(), {i: growing[t].depth[i] for i in ids}) for t, ids in near.items() if ids}
        for (t, i), (sub, gains) in _finished(state, partitions, sketches, shared, spec) if sketches else []:
            growing[t].below[i] = sub
            growing[t].gains += gains
        for t in sorted(growing):
            yield growing[t].tree(spec), growing[t].gains


def _split_large(state, partitions: int, sketches: dict, shared, spec: ForestSpec) -> dict:
    """By (tree, node): sums, and gain, feature, cut and the left side's sums of the best split."""
    def run(blocks_):
        held: dict = {}
        cuts = shared.value
        for b in blocks_:
            d = len(b.x)
            y, w = weights_of(b.y, b.w, spec.classes)
            for t, (sketch, ids) in sketches.items():
                c = spec.draws(t, b)
                leaf = sketch.leaves(b.x, cuts)
                for i in ids:
                    rows = np.flatnonzero((leaf == i) & (c > 0))
                    if not len(rows):
                        continue
                    sampled = features_of(spec, d, 1, (t, i, 1))
                    hist = np.stack([sums(np.minimum(b.x[f][rows], cuts.bins - 1).astype(np.int64), cuts.bins, y[rows],
                                          w[rows] * c[rows], c[rows], spec.classes)
                                     for f in (range(d) if sampled is None else sampled[0])])
                    held[t, i] = held[t, i] + hist if (t, i) in held else hist
        return held.items()

    def best(item):
        (t, i), hist = item
        d = len(shared.value.cuts)
        sampled = features_of(spec, d, 1, (t, i, 1))
        bins = hist.shape[-1]
        total = hist[0].sum(1)
        gain, place = best_cuts(np.concatenate(hist, 1), np.repeat(np.arange(len(hist)), bins), np.repeat(total[:, None], len(hist), 1), spec)
        j = int(gain.argmax())
        cut = int(place[j]) % bins
        return (t, i), (total, float(gain[j]), j if sampled is None else int(sampled[0, j]), cut, hist[j][:, :cut + 1].sum(1))

    nodes = sum(len(ids) for _, ids in sketches.values())
    return dict(state.mapPartitions(run).reduceByKey(operator.add, min(nodes, 4 * partitions)).map(best).collect())


def _finished(state, partitions: int, sketches: dict, shared, spec: ForestSpec) -> list:
    """((tree, node), (its subtree, gains)) of nodes whose rows fit in a task."""
    def rows_of(b):
        y, w = weights_of(b.y, b.w, spec.classes)
        for t, (sketch, ids) in sketches.items():
            c = spec.draws(t, b)
            leaf = sketch.leaves(b.x, shared.value)
            for i in ids:
                rows = np.flatnonzero((leaf == i) & (c > 0))
                if len(rows):
                    yield (t, i), (b.key, b.x[:, rows], y[rows], w[rows], c[rows])

    def grow(item):
        (t, i), parts = item
        parts = sorted(parts, key=lambda p: p[0])
        x, y, w, c = (np.concatenate([p[k] for p in parts], axis=-1) for k in (1, 2, 3, 4))
        return (t, i), grown_here(x, y, w, c, shared.value, spec, (t, i), sketches[t][1][i])

    nodes = sum(len(ids) for _, ids in sketches.values())
    return state.flatMap(rows_of).groupByKey(max(partitions, min(nodes, 8 * partitions))).map(grow).collect()


# --- estimator and model -------------------------------------------------------------------------

class HistogramForest(Estimator):
    """Fits (features vector, label[, weight])."""

    def __init__(self, spec: ForestSpec, features: str = "features", label: str = "label", weight: str | None = None) -> None:
        super().__init__()
        self.spec, self.features, self.label, self.weight = spec, features, label, weight

    def _fit(self, df: DataFrame) -> "ForestModel":
        spec = self.spec
        ensure_checkpoint_dir(df.sparkSession)
        workers_import(df.sparkSession)
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        y = F.col(self.label).cast("double")
        head = df.select(self.features).first()
        if head is None:
            raise ValueError("no rows to fit")
        d = head[0].size
        if spec.sqrt_features and d > WIDE:
            from . import wide_forest
            trees, cuts, scale, gains, valued = wide_forest.fit(df, self.features, y, w, d, spec)
            return wide_forest.WideForestModel(trees, cuts, spec.classes, scale, gains, self.features, d, valued)
        data = df.select(vector_to_array(self.features).alias("x"), y.alias("y"), w.alias("w"))
        rows, mean, spread = data.agg(F.count("*"), F.avg("y"), F.stddev_pop("y")).first()
        scale = (0.0, 1.0) if spec.classes else (mean, spread or 1.0)
        fine, coarse = cut_points(data, d, FINE_CUTS, MAX_CUTS)
        cuts = Cuts([f if len(f) <= MAX_CUTS else c for f, c in zip(fine, coarse)])
        partitions = max(1, min(data.rdd.getNumPartitions(), math.ceil(rows * d / TASK_CELLS)))
        made = blocks(data.coalesce(partitions), cuts.cuts, np.zeros(1)).checkpoint()
        if rows * d <= LOCAL_CELLS:
            found = _forest_here(made, cuts, spec, scale)
        else:
            found = list(_forest_by_jobs(made, partitions, d, rows, cuts, spec, scale))
        shares = sum(g / g.sum() if g.sum() > 0 else g for _, g in found)
        return ForestModel([t for t, _ in found], cuts.cuts, spec.classes, scale, shares, self.features)


def mean_values(x: np.ndarray, trees: list[Tree], cuts: Cuts) -> np.ndarray:
    """The mean of the trees' leaves (row x value) for rows of raw features."""
    binned = np.ascontiguousarray(bin_rows(x, cuts.cuts).T)
    out = np.zeros((len(x), trees[0].value.shape[1]))
    for tree in trees:
        out += tree.value[tree.left[tree.leaves(binned, cuts)]]
    return out / len(trees)


class ForestModel(Model, SavedState):
    """Fitted trees: ``transform`` adds rawPrediction, probability (classifiers) and prediction."""

    def __init__(self, trees=None, cuts=None, classes=0, scale=(0.0, 1.0), gains=None, features="features") -> None:
        super().__init__()
        self.trees: list[Tree] = trees or []
        self.cuts, self.classes, self.scale, self.gains, self.features = cuts, classes, scale, gains, features

    @property
    def importances(self) -> np.ndarray:
        """Mean over the trees of each feature's share of the gain (zeros if no tree split)."""
        total = self.gains.sum()
        return self.gains / total if total > 0 else self.gains

    @property
    def getNumTrees(self) -> int:
        """Named as in Spark's forests."""
        return len(self.trees)

    def _values(self, df: DataFrame) -> Column:
        """The mean of the trees' leaves."""
        shared = df.sparkSession.sparkContext.broadcast((self.trees, Cuts(self.cuts)))

        @F.pandas_udf("array<double>")
        def values(x: pd.Series) -> pd.Series:
            return pd.Series(list(mean_values(np.stack(x.to_numpy()), *shared.value)) if len(x) else [])

        return values(vector_to_array(self.features))

    def _transform(self, df: DataFrame) -> DataFrame:
        workers_import(df.sparkSession)
        out = df.withColumn("__value", self._values(df))
        v = F.col("__value")
        if not self.classes:
            return out.withColumn("prediction", v[0] * self.scale[1] + self.scale[0]).drop("__value")
        trees = float(len(self.trees))
        total = F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
        return (out.withColumns({"rawPrediction": array_to_vector(F.transform(v, lambda p: p * trees)),
                                 "probability": array_to_vector(F.transform(v, lambda p: p / total)),
                                 "prediction": (F.array_position(v, F.array_max(v)) - 1).cast("double")}).drop("__value"))

    def state(self) -> dict:
        return {"classes": self.classes, "features": self.features, "scale": list(self.scale), "gains": self.gains.tolist(),
                "cuts": [c.tolist() for c in self.cuts], "trees": [{k: v.tolist() for k, v in vars(t).items()} for t in self.trees]}

    def restore(self, state: dict) -> None:
        self.classes, self.features, self.scale = state["classes"], state["features"], tuple(state["scale"])
        self.gains, self.cuts = np.array(state["gains"]), [np.array(c, float) for c in state["cuts"]]
        kind = np.float32 if self.classes else float
        self.trees = [Tree(np.array(t["code"], np.int32), np.array(t["left"], np.int32), np.array(t["value"], kind))
                      for t in state["trees"]]
