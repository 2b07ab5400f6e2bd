"""Boosted trees on second-order histograms, as Spark jobs.

Features are cut into at most 255 bins at approximate quantiles, so a training
row is a byte per feature. A round fits one tree per output (one, or one per
class under a softmax) to the gradients and Hessians of the loss:

* a job sums, in every task, gradient, Hessian and row counts per node, feature
  and bin of its rows; the tasks' sums meet by ranges of features, where the best
  splits are searched, so a few numbers a node reach the driver;
* children that cannot be split again are not summed at all; inside a task only the
  smaller child of a split is summed, its sibling is the difference;
* one job serves all nodes (and all classes) that are due. Depth-wise growth
  splits a level at a time. Leaf-wise growth takes the best leaf first; the job
  looks ahead at as many open nodes as splits are left, the best-first order is
  then followed through the children that are known, and look-ahead that is not
  taken is dropped: the tree is the same as with a job per split;
* a node whose rows fit in one task (``LOCAL_CELLS``) is not
  split a job at a time: its rows are grouped into a task, which grows the rest of
  its subtree with the same code. Small nodes wait until no large node is due, so one
  job finishes all of them, the largest spread over the tasks first. The tree is the
  same wherever a node is finished;
* a table of at most ``CORE_SHARE`` times ``LOCAL_CELLS`` a core of an executor is
  boosted ``REFRESH`` rounds a job by one task, whose helpers (``crew``) share the
  features: a job a level costs more than its sums there.

Blocks of binned rows are a reliably checkpointed table; every ``REFRESH`` rounds
they are written again with their margins. In between a round's margins are those
of the round before and its trees; a lost block is recomputed from the last table
and the trees since. Row sampling is a function
of (seed, round, block), so a retried task sees the same rows.

A missing value (NaN) has a bin of its own and goes to the side with more gain.
"""

from __future__ import annotations

import heapq
import math
import operator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, executor_cores, workers_import
from .crew import Crew, shared
from .saved import SavedState

MAX_CUTS = 254
MISSING = 255
#: Rows of a block, and cells (rows x features) that make another task worth while.
BLOCK_ROWS = 50_000
TASK_CELLS = 4_000_000
#: A node with at most this many cells is finished inside one task; a table is boosted inside one task if it has at most
#: so many times as many cells for each core that the task's helpers can use.
LOCAL_CELLS = 14_000_000
CORE_SHARE = 2.25
#: Rows that are summed at once (their places fit in a core's cache).
CHUNK_ROWS = 16_384
#: Cells that make it worth while to share sums among helpers, and nodes that they sum at once.
CREW_CELLS = 400_000
SHARED_SLOTS = 256
#: Rows whose margins move at once.
MOVED_ROWS = 65_536
#: Nodes whose best splits are searched at once (their sums fit in a core's cache).
NODES_AT_ONCE = 4
#: Ranges of features whose best splits are searched by a task each.
RANGES = 8
#: Rounds between two written states of the margins.
REFRESH = 25
#: Summaries of a feature's values that are merged into one.
MERGED = 8


@dataclass(frozen=True)
class BoostSpec:
    """``objective`` is 'binary', 'multiclass' or 'regression'; ``max_leaves`` asks for leaf-wise growth."""

    objective: str = "binary"
    rounds: int = 300
    learning_rate: float = 0.05
    max_depth: int | None = 8
    max_leaves: int | None = None
    subsample: float = 1.0
    colsample: float = 1.0
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    min_child_rows: int = 1
    start_at_mean: bool = False       # else a classifier starts at even odds
    hessian_scale: float = 1.0        # factor of p (1 - p) under a softmax
    max_cuts: int = MAX_CUTS
    seed: int = 42


#: The settings of the two booster families of the study.
XGB = dict(rounds=300, learning_rate=0.05, max_depth=8, subsample=0.8, colsample=0.8, reg_lambda=1.0, min_child_weight=1.0)
LGB = dict(rounds=300, learning_rate=0.05, max_depth=None, max_leaves=31, colsample=0.8, reg_lambda=0.0,
           min_child_weight=1e-3, min_child_rows=20, start_at_mean=True)


@dataclass
class Tree:
    """Nodes as arrays; feature -1 marks a leaf. A row goes left if its bin <= ``cut`` (its value <= ``threshold``)."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def leaves(self, binned: np.ndarray) -> np.ndarray:
        """The node of each row of binned columns (feature x row)."""
        found = np.zeros(binned.shape[1], np.int64)
        due = [(0, np.arange(binned.shape[1]))]
        while due:
            k, rows = due.pop()
            if self.feature[k] < 0:
                found[rows] = k
            elif len(rows):
                left, right = parted(binned, rows, self.feature[k], int(self.cut[k]), self.missing_left[k])
                due += [(self.left[k], left), (self.right[k], right)]
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Values for rows of raw features."""
        node = np.zeros(len(x), np.int64)
        row = np.arange(len(x))
        for _ in range(self.depth):
            feature = self.feature[node]
            v = x[row, np.maximum(feature, 0)]
            go_left = np.where(np.isnan(v), self.missing_left[node], v <= self.threshold[node])
            node = np.where(feature < 0, node, np.where(go_left, self.left[node], self.right[node]))
        return self.value[node]


def parted(binned: np.ndarray, rows: np.ndarray, feature: int, cut: int, missing_left: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows on the left and on the right of a split."""
    bins = binned[feature].take(rows)
    go_left = bins <= cut
    if missing_left:
        go_left |= bins == MISSING
    return rows.take(np.flatnonzero(go_left)), rows.take(np.flatnonzero(~go_left))


# --- cut points and blocks -----------------------------------------------------------------------

class Summary:
    """Sorted values of a feature with the number of rows up to each, at most about ``points`` of them.

    A value's number of rows is exact where it is kept, and between two kept values that are no neighbours lies at most
    one of ``points`` equal parts of the rows, once for each level of merging (``MERGED`` summaries make one of the next).
    """

    def __init__(self, points: int) -> None:
        self.points, self.levels = points, []

    def add(self, values: np.ndarray, counts: np.ndarray, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(self._shortened(values, counts))
        if len(self.levels[level]) == MERGED:
            merged, self.levels[level] = self._merged(self.levels[level]), []
            self.add(*merged, level + 1)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return self._merged([held for level in self.levels for held in level])

    @staticmethod
    def _merged(held: list) -> tuple[np.ndarray, np.ndarray]:
        if not held:
            return np.zeros(0), np.zeros(0, np.int64)
        values, at = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
        return values, np.bincount(at, np.concatenate([n for _, n in held]), len(values)).astype(np.int64)

    def _shortened(self, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(values) <= self.points:
            return values, counts
        upto = np.cumsum(counts)
        last = np.flatnonzero(np.diff((upto - 1) * self.points // upto[-1], append=-1))
        return values[last], np.diff(upto[last], prepend=0)


def cut_points(data: DataFrame, features: int, *max_cuts: int) -> list:
    """Sorted values of each feature that bins end at (all but the largest bin), as near as ``Summary`` tells to quantiles.

    Of several numbers of cuts, the cut points of each.
    """
    points, at_once = 40 * max(max_cuts), max(1, min(BLOCK_ROWS, TASK_CELLS // max(1, features)))
    schema = "feature int, v binary, n binary"

    def summed(batches):
        found, held = [Summary(points) for _ in range(features)], []

        def flush():
            for x, summary in zip(np.concatenate(held).T, found):
                summary.add(*np.unique(x[~np.isnan(x)], return_counts=True))
            held.clear()

        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, -1)
            for a in range(0, len(x), at_once):
                held.append(x[a:a + at_once])
                if sum(map(len, held)) >= at_once:
                    flush()
        if held:
            flush()
        for f, summary in enumerate(found):
            v, n = summary.all()
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (v, n))],
                                                 names=["feature", "v", "n"])

    def cut(table):
        summary = Summary(points)
        for v, n in sorted(zip(*(table.column(c).to_pylist() for c in ("v", "n")))):
            summary.add(np.frombuffer(v), np.frombuffer(n, np.int64))
        values, counts = summary.all()
        upto = np.cumsum(counts)
        ends = [np.unique(values[np.searchsorted(upto, np.arange(1, n + 1) / (n + 1) * upto[-1])]) for n in max_cuts]
        return pa.table({"feature": pa.array([table.column("feature")[0].as_py()] * len(ends), pa.int32()), "n": pa.array(max_cuts, pa.int32()),
                         "cuts": pa.array([e[e < values[-1]].tobytes() for e in ends], pa.binary())})

    rows = data.select("x").mapInArrow(summed, schema).groupBy("feature").applyInArrow(cut, "feature int, n int, cuts binary").collect()
    found = {(r["n"], r["feature"]): np.frombuffer(r["cuts"]) for r in rows}
    cuts = [[found.get((n, f), np.zeros(0)) for f in range(features)] for n in max_cuts]
    return cuts if len(cuts) > 1 else cuts[0]


def bin_rows(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], side="left")
    out[np.isnan(x)] = MISSING
    return out


def blocks(data: DataFrame, cuts: list[np.ndarray], start: np.ndarray) -> DataFrame:
    """Rows (x array, y, w) as binary blocks: binned features (a column after the other), label, weight, margins."""
    shared = data.sparkSession.sparkContext.broadcast(cuts)

    def run(batches):
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush():
            nonlocal number, held
            x, y, w = (np.concatenate(c) for c in zip(*held))
            margin = np.tile(start, (len(y), 1))
            held, number = [], number + 1
            cols = [pa.array([v], pa.int64()) for v in (part, number, len(y))] + [
                pa.array([a.tobytes()], pa.binary()) for a in (x.T, y, w, margin)]
            return pa.RecordBatch.from_arrays(cols, names=["part", "number", "n", "x", "y", "w", "margin"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                x = np.asarray(piece.column(0).flatten(), np.float64).reshape(piece.num_rows, -1)
                held.append((bin_rows(x, shared.value), np.asarray(piece.column(1), np.float64),
                             np.asarray(piece.column(2), np.float64)))
                if sum(len(h[1]) for h in held) >= BLOCK_ROWS:
                    yield flush()
        if held:
            yield flush()

    schema = "part long, number long, n long, x binary, y binary, w binary, margin binary"
    return data.mapInArrow(run, schema)


@dataclass
class Block:
    key: tuple[int, int]
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    margin: np.ndarray
    chosen: np.ndarray | None = None      # rows of the round's sample
    g: np.ndarray | None = None
    h: np.ndarray | None = None

    def sample(self, number: int, spec: BoostSpec) -> np.ndarray:
        return sampled(self.key, len(self.y), number, spec)

    def at_round(self, number: int, spec: BoostSpec, trees: list[Tree]) -> "Block":
        """The block with its margins moved by trees, and with the sample, gradients and Hessians of a round."""
        margin = moved(self, [trees])
        return replace(self, margin=margin, chosen=self.sample(number, spec), **dict(zip("gh", gradients(self.y, self.w, margin, spec))))

    @classmethod
    def of(cls, row, outputs: int) -> "Block":
        n = row["n"]
        return cls((row["part"], row["number"]), np.frombuffer(row["x"], np.uint8).reshape(-1, n),
                   np.frombuffer(row["y"]), np.frombuffer(row["w"]), np.frombuffer(row["margin"]).reshape(n, outputs))


def sampled(key: tuple[int, int], rows: int, number: int, spec: BoostSpec) -> np.ndarray:
    """Which rows of a block a round's sample has."""
    if spec.subsample >= 1:
        return np.ones(rows, bool)
    return np.random.default_rng([spec.seed, number, *key]).random(rows) < spec.subsample


def moved(block: Block, rounds: list[list[Tree]]) -> np.ndarray:
    margin = block.margin.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            margin[:, k] += tree.value[tree.leaves(block.x)]
    return margin


def gradients(y: np.ndarray, w: np.ndarray, margin: np.ndarray, spec: BoostSpec) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, Hessian) of the loss by margin, row x output."""
    if spec.objective == "regression":
        return (margin - y[:, None]) * w[:, None], np.repeat(w[:, None], margin.shape[1], 1)
    if spec.objective == "binary":
        p = 1.0 / (1.0 + np.exp(-margin))
        return (p - y[:, None]) * w[:, None], np.maximum(p * (1 - p), 1e-16) * w[:, None]
    e = np.exp(margin - margin.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    hit = y[:, None] == np.arange(margin.shape[1])
    return (p - hit) * w[:, None], np.maximum(spec.hessian_scale * p * (1 - p), 1e-16) * w[:, None]


# --- growing -------------------------------------------------------------------------------------

class Bins:
    """The bins of a round's sampled features, one feature after the other, the missing bin of each last."""

    def __init__(self, features: np.ndarray, sizes: np.ndarray, spec: BoostSpec) -> None:
        self.features, self.sizes, self.spec = features, sizes, spec
        self.begin = np.cumsum(sizes) - sizes
        self.last = self.begin + sizes - 1
        self.size = int(sizes.sum())
        self.feature = np.repeat(features, sizes)
        self.segment = np.repeat(np.arange(len(features)), sizes)
        self.bin = np.arange(self.size) - self.begin[self.segment]

    def __reduce__(self):
        return Bins, (self.features, self.sizes, self.spec)

    def ranges(self, most: int) -> list[tuple["Bins", int, int]]:
        """At most so many ranges of features as bins of their own, with the first and the last + 1 of their places."""
        parts = [p for p in np.array_split(np.arange(len(self.features)), most) if len(p)]
        return [(Bins(self.features[p], self.sizes[p], self.spec), int(self.begin[p[0]]), int(self.last[p[-1]]) + 1) for p in parts]

    def sums(self, binned: np.ndarray, rows: np.ndarray | None, slot: np.ndarray | None, slots: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """([gradient, Hessian, rows] x slot x bin) sums of the rows (None: all); g and h (and slot, unless all are 0) are theirs."""
        found = np.empty((3, slots, self.size))
        ones = bool((h == 1.0).all())                     # the Hessians count the rows
        self.add_up(found, range(len(self.features)), binned, rows, slot, slots, len(g), lambda some: (g[some], h[some]), ones)
        return found

    def add_up(self, found: np.ndarray, places, binned: np.ndarray, rows, slot, slots: int, n: int, of, ones: bool) -> None:
        """Write the sums of some features (by place) of n rows; ``of`` has gradients and Hessians of a slice of them."""
        width = MISSING + 1
        size, step = slots * width, max(CHUNK_ROWS, 1024 * slots)
        held = np.zeros((len(places), 3, size))
        for a in range(0, n, step):
            some = slice(a, min(a + step, n))
            g, h = of(some)
            first = None if slot is None else slot[some] * width
            for j, own in zip(places, held):
                column = binned[self.features[j]]
                at = column[some] if rows is None else column.take(rows[some])
                at = at.astype(np.intp) if first is None else at + first
                own[0] += np.bincount(at, g, size)
                own[2] += np.bincount(at, minlength=size)
                if not ones:
                    own[1] += np.bincount(at, h, size)
        if ones:
            held[:, 1] = held[:, 2]
        for j, own in zip(places, held.reshape(-1, 3, slots, width)):
            found[:, :, self.begin[j]:self.last[j]] = own[:, :, :self.sizes[j] - 1]
            found[:, :, self.last[j]] = own[:, :, MISSING]

    def total(self, hist: np.ndarray) -> np.ndarray:
        return hist[..., :self.last[0] + 1].sum(-1)

    def best_splits(self, hists: np.ndarray) -> list[tuple[np.ndarray, tuple]]:
        """Per node of (3 x node x bin) its sums and the best (gain, place, missing left, sums of the left side).

        The gain is -inf where no split is allowed.
        """
        at_once = range(0, hists.shape[1], NODES_AT_ONCE)
        return [found for n in at_once for found in self._best_splits(hists[:, n:n + NODES_AT_ONCE])]

    def _best_splits(self, hists: np.ndarray) -> list[tuple[np.ndarray, tuple]]:
        total = self.total(hists)
        left = np.cumsum(hists, -1)
        before = np.concatenate((np.zeros((*hists.shape[:2], 1)), left[..., self.last[:-1]]), -1)
        left -= np.repeat(before, np.diff(np.concatenate(([-1], self.last))), -1)
        missing = hists[..., self.last]
        nodes = np.arange(hists.shape[1])
        best, place, side = np.full(len(nodes), -np.inf), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), bool)
        taken = np.zeros((3, len(nodes)))
        for missing_left in (False, True):
            if missing_left:
                if not missing[2].any():
                    break
                left += missing[..., self.segment]
            gain = self._gain(left, total)
            gain[:, self.last] = -np.inf
            at = gain.argmax(1)
            found = gain[nodes, at]
            better = found > best
            best, place, side = np.where(better, found, best), np.where(better, at, place), np.where(better, missing_left, side)
            taken = np.where(better, left[:, nodes, at], taken)
        best[best <= 1e-9] = -np.inf
        return [(total[:, n], (float(best[n]), int(place[n]), bool(side[n]), taken[:, n])) for n in nodes]

    def _gain(self, left: np.ndarray, total: np.ndarray) -> np.ndarray:
        spec, reg = self.spec, self.spec.reg_lambda + 1e-12
        (g, h, rows), (all_g, all_h, all_rows) = left, total
        least = max(spec.min_child_rows, 1) - 0.5
        n, b = np.nonzero((h >= spec.min_child_weight) & (all_h[:, None] - h >= spec.min_child_weight)
                          & (rows >= least) & (all_rows[:, None] - rows >= least))
        gain = np.full(g.shape, -np.inf)
        g, h = g[n, b], h[n, b]
        whole = all_g ** 2 / (all_h + reg)
        gain[n, b] = g * g / (h + reg) + (all_g[n] - g) ** 2 / (all_h[n] - h + reg) - whole[n]
        return gain


NO_SPLIT = (-math.inf, 0, False, np.zeros(3))


class Growing:
    """A tree while it grows: sums and best splits of its nodes, and the nodes looked ahead at."""

    def __init__(self, bins: Bins, spec: BoostSpec) -> None:
        self.bins, self.spec = bins, spec
        self.sums: list[np.ndarray] = []                  # gradient, Hessian and rows of each node
        self.depth: list[int] = []
        self.best: list[tuple] = []                       # (gain, place of the split, missing left, sums of the left side)
        self.children: list[tuple[int, int] | None] = []
        self.hist: dict[int, np.ndarray] = {}
        self.taken: set[int] = set()

    def grow(self, depth: int, sums: np.ndarray | None = None) -> int:
        """A further node; without a known split until its sums are filled in."""
        self.sums.append(np.zeros(3) if sums is None else sums)
        self.depth.append(depth)
        self.best.append(NO_SPLIT)
        self.children.append(None)
        return len(self.sums) - 1

    def fill(self, ids: list[int], found: list[tuple[np.ndarray, tuple]], hists: np.ndarray | None = None) -> None:
        """The sums and best splits of nodes; their bins' sums (3 x node x bin) are kept if given."""
        for n, (i, (sums, best)) in enumerate(zip(ids, found)):
            self.sums[i] = sums
            if best[0] > 0 and self.may_split(i):
                self.best[i] = best
                if hists is not None:
                    self.hist[i] = hists[:, n]

    def may_split(self, i: int) -> bool:
        spec, (_, h, rows) = self.spec, self.sums[i]
        return ((spec.max_depth is None or self.depth[i] < spec.max_depth) and h >= 2 * spec.min_child_weight
                and rows > 2 * spec.min_child_rows - 0.5)

    def leaves_left(self) -> int:
        return self.spec.max_leaves - len(self.taken) - 1

    def wanted(self, ahead: bool = True) -> list[int]:
        """Open nodes to split, by leaves ``ahead`` of the next; as a side effect the splits that the tree takes so far."""
        open_ = [i for i, c in enumerate(self.children) if c is None and self.best[i][0] > 0]
        if self.spec.max_leaves is None:
            self.taken = {i for i, c in enumerate(self.children) if c}
            return open_
        self.taken = set()
        heap = [(-self.best[0][0], 0)]
        while heap and self.leaves_left() > 0:
            gain, i = heap[0]
            if gain >= 0:
                return []
            if self.children[i] is None:
                if not ahead:
                    return [i]
                # of all open nodes, also below splits only looked at, as many as splits are left
                wanted = sorted(open_, key=lambda j: (-self.best[j][0], j))[:self.leaves_left()]
                return wanted if i in wanted else [i, *wanted[:-1]]
            heapq.heappop(heap)
            self.taken.add(i)
            for j in self.children[i]:
                heapq.heappush(heap, (-self.best[j][0], j))
        return []

    def split(self, i: int) -> list[int]:
        """Open the children of a node with their sums; those that may be split again."""
        left = self.best[i][3]
        self.children[i] = pair = (self.grow(self.depth[i] + 1, left), self.grow(self.depth[i] + 1, self.sums[i] - left))
        return [j for j in pair if self.may_split(j)]

    def lighter(self, i: int) -> int:
        a, b = self.children[i]
        return a if self.sums[a][2] <= self.sums[b][2] else b

    def fill_children(self, parents: list[int], hists: np.ndarray, best_splits=None) -> None:
        """The sums of the lighter children (3 x parent x bin); the others' are the rest of their parents."""
        ids, found = [], []
        for n, i in enumerate(parents):
            pair = [hists[:, n], self.hist.pop(i) - hists[:, n]]
            ids += self.children[i]
            found += pair if self.lighter(i) == self.children[i][0] else pair[::-1]
        hists = np.stack(found, 1)
        self.fill(ids, (best_splits or self.bins.best_splits)(hists), hists)

    def graft(self, i: int, grown: "Growing") -> None:
        """Continue node i with the subtree that was grown from its rows."""
        number = {0: i}
        for n in range(1, len(grown.sums)):
            number[n] = self.grow(self.depth[i] + grown.depth[n], grown.sums[n])
            self.best[number[n]] = grown.best[n]
        for n, c in enumerate(grown.children):
            self.children[number[n]] = c and (number[c[0]], number[c[1]])
        self.hist.pop(i, None)
        # of splits with equal gains, sums in another order may take another, or allow none after all
        self.best[i] = grown.best[0] if grown.children[0] else NO_SPLIT

    def arrays(self, through: bool) -> tuple[Tree, dict[int, int]]:
        """The tree as it is, with all look-ahead (``through``) or with the splits taken, and its nodes' numbers in it."""
        number, order = {0: 0}, [0]
        for i in order:
            if self.children[i] and (through or i in self.taken):
                for j in self.children[i]:
                    number[j] = len(order)
                    order.append(j)
        n = len(order)
        feature, cut, value = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
        missing_left, left, right = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k, i in enumerate(order):
            g, h, _ = self.sums[i]
            value[k] = -self.spec.learning_rate * g / (h + self.spec.reg_lambda) if h + self.spec.reg_lambda > 0 else 0.0
            if self.children[i] and (through or i in self.taken):
                _, at, missing_left[k], _ = self.best[i]
                feature[k], cut[k] = self.bins.feature[at], self.bins.bin[at]
                left[k], right[k] = (number[j] for j in self.children[i])
        return Tree(feature, cut, np.zeros(n), missing_left, left, right, value, max(self.depth[i] for i in order)), number

    def gains(self, into: np.ndarray) -> None:
        for i in self.taken:
            into[self.bins.feature[self.best[i][1]]] += self.best[i][0]


def grown_here(x: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, bins: Bins, spec: BoostSpec) -> Growing:
    """The subtree of some rows (all of one node's), grown in this process; g and h belong to all rows of x."""
    tree = Growing(bins, spec)
    own = {tree.grow(0): rows}
    hists = bins.sums(x, rows, None, 1, g[rows], h[rows])
    tree.fill([0], bins.best_splits(hists), hists)
    while due := tree.wanted(ahead=False):                # there is no job to save
        parents, parts = [], []
        for i in due:
            rows = own.pop(i)
            if not tree.split(i):                         # nobody asks for its children's rows
                tree.hist.pop(i)
                continue
            _, at, missing_left, _ = tree.best[i]
            own.update(zip(tree.children[i], parted(x, rows, bins.feature[at], int(bins.bin[at]), missing_left)))
            parents.append(i)
            parts.append(own[tree.lighter(i)])
        if parents:
            used = np.concatenate(parts)
            slot = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            tree.fill_children(parents, bins.sums(x, used, slot, len(parts), g[used], h[used]))
    tree.hist.clear()
    return tree


def _best_splits(state, partitions: int, trees: list[Tree], slot_of: list[np.ndarray], slots: int, bins: Bins) -> list[tuple]:
    """Sums and best splits of the wanted nodes over all rows; node n of tree k has slot ``slot_of[k][n]`` (-1: none)."""
    ranges = bins.ranges(min(partitions, RANGES))

    def run(blocks):
        found = None
        for b in blocks:
            for k, tree in enumerate(trees):
                slot = slot_of[k][tree.leaves(b.x)]
                used = np.flatnonzero((slot >= 0) & b.chosen)
                if len(used):
                    part = bins.sums(b.x, used, slot[used], slots, b.g[used, k], b.h[used, k])
                    found = part if found is None else found + part
        return [] if found is None else [(r, found[..., first:end]) for r, (_, first, end) in enumerate(ranges)]

    def best(item):
        own, first, _ = ranges[item[0]]
        return item[0], [(sums, (gain, first + at, side, left)) for sums, (gain, at, side, left) in own.best_splits(item[1])]

    parts = dict(state.mapPartitions(run).reduceByKey(operator.add, len(ranges)).map(best).collect())
    if not parts:                                         # no row in any of the nodes
        return [(np.zeros(3), NO_SPLIT)] * slots
    # the first range's sums, and of equal gains the first place
    return [(parts[0][n][0], max((parts[r][n][1] for r in sorted(parts)), key=lambda b: (b[0], not b[2]))) for n in range(slots)]


def spread(sizes: dict, tasks: int) -> dict:
    """A task for each key: the largest first, each to the task with the least so far."""
    loads, task_of = [(0, t) for t in range(tasks)], {}
    for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
        load, task_of[key] = heapq.heappop(loads)
        heapq.heappush(loads, (load + sizes[key], task_of[key]))
    return task_of


def _finished(state, partitions: int, trees: list[Tree], node_of: list[dict[int, int]], specs: dict, sizes: dict, bins: Bins) -> list:
    """((tree, node), its subtree) of small nodes of some sizes; ``node_of`` maps numbers in the trees to nodes."""
    tasks = min(partitions, len(sizes))
    task_of = spread(sizes, tasks)

    def rows_of(b):
        for k, tree in enumerate(trees):
            if node_of[k]:
                leaf = tree.leaves(b.x)
                for number, i in node_of[k].items():
                    used = np.flatnonzero((leaf == number) & b.chosen)
                    if len(used):
                        yield (k, i), (b.x[:, used], b.g[used, k], b.h[used, k])

    def grow(item):
        key, parts = item
        x, g, h = (np.concatenate(c, axis=-1) for c in zip(*parts))
        grown = grown_here(x, np.arange(len(g)), g, h, bins, specs[key])
        grown.bins = None                                 # the driver has them
        return key, grown

    return state.flatMap(rows_of).groupByKey(tasks, task_of.__getitem__).map(grow).collect()


def _round(state, partitions: int, rows: int, bins: Bins, spec: BoostSpec, outputs: int, gains: np.ndarray) -> list[Tree]:
    growing = [Growing(bins, spec) for _ in range(outputs)]
    width = max(1, len(bins.features))
    small = LOCAL_CELLS // width
    root = Tree(np.array([-1]), *(np.zeros(1, t) for t in (np.int64, float, bool, np.int64, np.int64, float)), 0)
    for tree in growing:
        tree.grow(0)
    if rows > small:
        found = _best_splits(state, partitions, [root] * outputs, [np.array([k]) for k in range(outputs)], outputs, bins)
        for k, tree in enumerate(growing):
            tree.fill([0], found[k:k + 1])
        due = [tree.wanted() for tree in growing]
    else:
        due = [[0]] * outputs
    first = rows <= small                                 # the roots' sums are not known yet
    while any(due):
        here = [[i for i in ids if first or tree.sums[i][2] <= small] for tree, ids in zip(growing, due)]
        large = [[i for i in ids if i not in set(near)] for ids, near in zip(due, here)]
        if not any(large):                                # small nodes wait for each other
            known, numbers = zip(*[tree.arrays(through=True) for tree in growing])
            specs = {(k, i): replace(spec, max_depth=spec.max_depth and spec.max_depth - tree.depth[i],
                                     max_leaves=spec.max_leaves and tree.leaves_left() + 1)
                     for k, (tree, ids) in enumerate(zip(growing, here)) for i in ids}
            sizes = {(k, i): rows if first else int(growing[k].sums[i][2]) for k, i in specs}
            node_of = [{number[i]: i for i in ids} for number, ids in zip(numbers, here)]
            for (k, i), grown in _finished(state, partitions, list(known), node_of, specs, sizes, bins):
                growing[k].graft(i, grown)
                if i == 0:
                    growing[k].sums[0] = grown.sums[0]
        else:
            again = [[j for i in ids for j in tree.split(i)] for tree, ids in zip(growing, large)]
            if any(again):
                known, slot_of, slots = [], [], 0
                for tree, ids in zip(growing, again):
                    arrays, number = tree.arrays(through=True)
                    slot = np.full(len(arrays.feature), -1)
                    slot[[number[j] for j in ids]] = slots + np.arange(len(ids))
                    known.append(arrays)
                    slot_of.append(slot)
                    slots += len(ids)
                found = _best_splits(state, partitions, known, slot_of, slots, bins)
                for tree, ids in zip(growing, again):
                    tree.fill(ids, found[:len(ids)])
                    found = found[len(ids):]
        due, first = [tree.wanted() for tree in growing], False
    for tree in growing:
        tree.gains(gains)
    return [tree.arrays(through=False)[0] for tree in growing]


class Table:
    """A whole table in one task: its blocks one after the other, in memory that the helpers of a ``Crew`` see.

    The rows of the nodes of a growing tree are segments of ``order``, (begin, end). The methods that a helper runs
    have its number and the number of helpers as first arguments.
    """

    def __init__(self, blocks_, width: int, outputs: int, spec: BoostSpec) -> None:
        held = sorted(blocks_, key=lambda b: b.key, reverse=True)
        self.keys, n, self.spec = [(b.key, len(b.y)) for b in reversed(held)], sum(len(b.y) for b in held), spec
        self.x, self.y, self.w, self.margin = np.empty((width, n), np.uint8), np.empty(n), np.empty(n), shared((n, outputs))
        at = 0
        while held:                                       # a block is dropped once it is copied
            b = held.pop()
            own = slice(at, at := at + len(b.y))
            self.x[:, own], self.y[own], self.w[own], self.margin[own] = b.x, b.y, b.w, b.margin
        self.g, self.h, self.order = shared((outputs, n)), shared((outputs, n)), shared(n, np.intp)
        self.found, self.both = (shared(3 * slots * width * (MISSING + 1)) for slots in (SHARED_SLOTS, 2 * SHARED_SLOTS))
        self.ones = spec.objective == "regression" and bool((self.w == 1.0).all())
        self.varies = np.array([bool((column != column[0]).any()) for column in self.x])  # other features have no split

    def slices(self, own: int, all_: int) -> list[slice]:
        n = len(self.y)
        first, end = n * own // all_, n * (own + 1) // all_
        return [slice(a, min(a + MOVED_ROWS, end)) for a in range(first, end, MOVED_ROWS)]

    def fill(self, own: int, all_: int) -> None:
        """Gradients and Hessians of all rows."""
        for some in self.slices(own, all_):
            self.g[:, some], self.h[:, some] = (a.T for a in gradients(self.y[some], self.w[some], self.margin[some], self.spec))

    def move(self, own: int, all_: int, trees: list[Tree]) -> None:
        """The margins of all rows after some trees."""
        for some in self.slices(own, all_):
            for k, tree in enumerate(trees):
                self.margin[some, k] += tree.value[tree.leaves(self.x[:, some])]

    def sum(self, own: int, all_: int, bins: Bins, k: int, segments: list[tuple[int, int]]) -> None:
        """Sums of segments (a slot each) by a share of the features, into ``found``."""
        found, g, h = self._shaped(self.found, bins, len(segments)), self.g[k], self.h[k]
        places = range(own, len(bins.features), all_)
        for n, (a, b) in enumerate(segments):
            rows = self.order[a:b]
            if b - a == len(self.y):                      # all rows as they are
                bins.add_up(found[:, n:n + 1], places, self.x, None, None, 1, b - a, lambda some: (g[some], h[some]), self.ones)
            else:
                of = lambda some: (g.take(rows[some]), h.take(rows[some]))  # noqa: B023, E731
                bins.add_up(found[:, n:n + 1], places, self.x, rows, None, 1, b - a, of, self.ones)

    def best(self, own: int, all_: int, bins: Bins, nodes: int) -> list:
        """Best splits of a share of the nodes whose sums are in ``both``."""
        return bins.best_splits(self._shaped(self.both, bins, nodes)[:, nodes * own // all_:nodes * (own + 1) // all_])

    def part(self, own: int, all_: int, pieces: list[tuple]) -> list[int]:
        """Part a share of the pieces (helper, begin, end, split); keeps the sides and returns the rows on the left of each."""
        self.sides = [parted(self.x, self.order[a:b], *split) for who, a, b, split in pieces if who % all_ == own]
        return [len(left) for left, _ in self.sides]

    def put(self, own: int, all_: int, pieces: list[tuple], begins: list[tuple[int, int]]) -> None:
        """Write the sides that ``part`` kept to where they begin."""
        kept = iter(self.sides)
        for (who, *_), firsts in zip(pieces, begins):
            if who % all_ == own:
                for rows, first in zip(next(kept), firsts):
                    self.order[first:first + len(rows)] = rows
        del self.sides

    @staticmethod
    def _shaped(memory: np.ndarray, bins: Bins, slots: int) -> np.ndarray:
        return memory[:3 * slots * bins.size].reshape(3, slots, bins.size)

    def grown(self, crew: Crew, bins: Bins, k: int, used: np.ndarray) -> Growing:
        """The tree of output k on some rows, as ``grown_here`` grows it."""
        tree = Growing(bins, self.spec)
        self.order[:len(used)] = used
        own = {tree.grow(0): (0, len(used))}
        tree.fill([0], bins.best_splits(hists := self._sums(crew, bins, k, [own[0]])), hists)
        while due := tree.wanted(ahead=False):
            parents = []
            for i in due:
                if tree.split(i):
                    parents.append(i)
                else:
                    tree.hist.pop(i)
            self._part(crew, tree, parents, own)
            for a in range(0, len(parents), SHARED_SLOTS):
                some = parents[a:a + SHARED_SLOTS]
                hists = self._sums(crew, bins, k, [own[tree.lighter(i)] for i in some])
                tree.fill_children(some, hists, lambda both: self._best_splits(crew, bins, both))
        tree.hist.clear()
        return tree

    def _sums(self, crew: Crew, bins: Bins, k: int, segments: list[tuple[int, int]]) -> np.ndarray:
        crew.work("sum", bins, k, segments, alone=sum(b - a for a, b in segments) * len(bins.features) < CREW_CELLS)
        return self._shaped(self.found, bins, len(segments)).copy()

    def _best_splits(self, crew: Crew, bins: Bins, hists: np.ndarray) -> list:
        if hists.size < CREW_CELLS:
            return bins.best_splits(hists)
        self._shaped(self.both, bins, hists.shape[1])[:] = hists
        return [found for part in crew.work("best", bins, hists.shape[1]) for found in part]

    def _part(self, crew: Crew, tree: Growing, parents: list[int], own: dict) -> None:
        """Part the rows of nodes; their children's segments come in place of theirs."""
        total = sum(own[i][1] - own[i][0] for i in parents)
        step, pieces, at = max(CHUNK_ROWS, -(-total // (2 * crew.number))), [], []
        for i in parents:
            _, place, missing_left, _ = tree.best[i]
            split = tree.bins.feature[place], int(tree.bins.bin[place]), missing_left
            a, b = own[i]
            for first in range(a, max(b, a + 1), step):
                pieces.append((len(pieces), first, min(first + step, b), split))
                at.append(i)
        alone = total < CREW_CELLS // 4
        counts = crew.work("part", pieces, alone=alone)
        left, many = [0] * len(pieces), 1 if alone else crew.number
        for helper, found in enumerate(counts):
            left[helper::many] = found
        lefts = dict.fromkeys(parents, 0)
        for i, n in zip(at, left):
            lefts[i] += n
        begins, next_ = [], {i: [own[i][0], own[i][0] + lefts[i]] for i in parents}
        for (_, a, b, _), i, n in zip(pieces, at, left):
            begins.append(tuple(next_[i]))
            next_[i][0] += n
            next_[i][1] += b - a - n
        crew.work("put", pieces, begins, alone=alone)
        for i in parents:
            (a, b), (one, other) = own.pop(i), tree.children[i]
            own[one], own[other] = (a, a + lefts[i]), (a + lefts[i], b)


def _rounds_here(made: DataFrame, first: int, features: list[np.ndarray], sizes: np.ndarray, spec: BoostSpec, outputs: int,
                 cores: int = 1) -> list:
    """(trees, gains) of further rounds on a table of one task; ``features`` has the sampled features of each round."""
    def run(rows):
        table = Table((Block.of(row, outputs) for row in rows), len(sizes), outputs, spec)
        with Crew(cores if table.x.size >= CREW_CELLS else 1, table) as crew:
            for number, chosen in enumerate(features, first):
                chosen = chosen[table.varies[chosen]] if table.varies[chosen].any() else chosen[:1]
                bins, gains, trees = Bins(chosen, sizes[chosen], spec), np.zeros(len(sizes)), []
                crew.work("fill")
                used = np.flatnonzero(np.concatenate([sampled(key, size, number, spec) for key, size in table.keys]))
                for k in range(outputs):
                    grown = table.grown(crew, bins, k, used)
                    grown.gains(gains)
                    trees.append(grown.arrays(through=False)[0])
                crew.work("move", trees)
                yield trees, gains

    return made.rdd.coalesce(1).mapPartitions(run).collect()


def with_thresholds(tree: Tree, cuts: list[np.ndarray]) -> Tree:
    """The same tree with raw values at its splits."""
    for k in np.flatnonzero(tree.feature >= 0):
        values = cuts[tree.feature[k]]
        tree.threshold[k] = values[tree.cut[k]] if tree.cut[k] < len(values) else math.inf
    return tree


class HistogramBooster(Estimator):
    """Fits (features vector, label[, weight]); ``classes`` is the number of label values of a classifier."""

    def __init__(self, spec: BoostSpec, classes: int = 2, features: str = "features", label: str = "label",
                 weight: str | None = None) -> None:
        super().__init__()
        self.spec, self.classes = spec, classes
        self.features, self.label, self.weight = features, label, weight

    def _fit(self, df: DataFrame) -> "BoostedTrees":
        spec = self.spec
        ensure_checkpoint_dir(df.sparkSession)
        workers_import(df.sparkSession)
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        data = df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y"), w.alias("w"))
        outputs = self.classes if spec.objective == "multiclass" else 1
        head = data.first()
        if head is None:
            raise ValueError("no rows to fit")
        d = len(head["x"])
        rows, start = self._start(data, outputs)
        cuts = cut_points(data, d, spec.max_cuts)
        cores = executor_cores(df.sparkSession)
        here = rows * d <= LOCAL_CELLS * max(1, CORE_SHARE * cores)
        partitions = max(1, min(data.rdd.getNumPartitions(), math.ceil(rows * d / TASK_CELLS)))
        made = blocks(data.coalesce(partitions), cuts, start).checkpoint()
        rng = np.random.default_rng(spec.seed)
        sizes = np.array([len(c) + 2 for c in cuts])
        fitted: list[list[Tree]] = []
        gains = np.zeros(d)
        while len(fitted) < spec.rounds:
            features = [np.sort(rng.choice(d, max(1, int(spec.colsample * d + 1e-9)), replace=False))
                        for _ in range(min(REFRESH, spec.rounds - len(fitted)))]
            since: list[list[Tree]] = []
            if here:
                found = _rounds_here(made, len(fitted), features, sizes, spec, outputs, cores)
            else:
                found = self._rounds(made, partitions, rows, len(fitted), features, sizes, outputs)
            for trees, gained in found:
                since.append([with_thresholds(t, cuts) for t in trees])
                gains += gained
                if all(len(t.feature) == 1 for t in trees) and spec.subsample >= 1 and spec.colsample >= 1:
                    return BoostedTrees(fitted + since, start, spec.objective, gains, self.features)
            fitted += since                               # nothing left to split above, nor would there be
            if len(fitted) < spec.rounds:
                made = self._refreshed(made, since, outputs)
        return BoostedTrees(fitted, start, spec.objective, gains, self.features)

    def _rounds(self, made: DataFrame, partitions: int, rows: int, first: int, features: list[np.ndarray], sizes: np.ndarray,
                outputs: int):
        """(trees, gains) of further rounds, by jobs."""
        spec, trees, before = self.spec, [], None
        for number, chosen in enumerate(features, first):
            state = self._state(made, before, trees, number, outputs)
            state.persist(StorageLevel.MEMORY_AND_DISK)
            gains = np.zeros(len(sizes))
            trees = _round(state, partitions, rows, Bins(chosen, sizes[chosen], spec), spec, outputs, gains)
            if before is not None:
                before.unpersist()
            before = state
            yield trees, gains
        before.unpersist()

    def _start(self, data: DataFrame, outputs: int) -> tuple[int, np.ndarray]:
        """(rows, first margin of each output)."""
        spec = self.spec
        sums = [F.sum(F.when(F.col("y") == float(k), F.col("w")).otherwise(0.0)) for k in range(outputs)]
        found = data.agg(F.count("*"), F.sum("w"), F.sum(F.col("w") * F.col("y")), *sums).first()
        rows, total, mean = found[0], found[1], found[2] / found[1]
        if spec.objective == "regression":
            return rows, np.array([mean])
        if not spec.start_at_mean:
            return rows, np.zeros(outputs)
        if spec.objective == "binary":
            p = min(max(mean, 1e-15), 1 - 1e-15)
            return rows, np.array([math.log(p / (1 - p))])
        return rows, np.log(np.maximum(np.array(found[3:]) / total, 1e-15))

    def _state(self, made: DataFrame, before, trees: list[Tree], number: int, outputs: int):
        """The blocks of a round: from the table, or from the round before and its trees."""
        spec = self.spec
        if before is None:
            return made.rdd.map(lambda row: Block.of(row, outputs).at_round(number, spec, []))
        return before.map(lambda block: block.at_round(number, spec, trees))

    @staticmethod
    def _refreshed(made: DataFrame, since: list, outputs: int) -> DataFrame:
        shared = made.sparkSession.sparkContext.broadcast(since)

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    margin = moved(Block.of(row, outputs), shared.value)
                    yield pa.RecordBatch.from_pylist([row | {"margin": margin.tobytes()}], schema=batch.schema)

        return made.mapInArrow(run, made.schema).checkpoint()


def raw_margins(x: np.ndarray, rounds: list[list[Tree]], start: np.ndarray) -> np.ndarray:
    """Margins (row x output) of raw features."""
    out = np.tile(start, (len(x), 1))
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += tree.predict(x)
    return out


class BoostedTrees(Model, SavedState):
    """Fitted trees: ``transform`` adds rawPrediction, probability (classifiers) and prediction."""

    def __init__(self, rounds=None, start=None, objective="binary", gains=None, features="features") -> None:
        super().__init__()
        self.rounds: list[list[Tree]] = rounds or []
        self.start, self.objective, self.gains, self.features = start, objective, gains, features

    @property
    def importances(self) -> np.ndarray:
        """Share of the total gain of each feature (zeros if no tree split)."""
        total = self.gains.sum()
        return self.gains / total if total > 0 else self.gains

    def _transform(self, df: DataFrame) -> DataFrame:
        workers_import(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast((self.rounds, self.start))

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            return pd.Series(list(raw_margins(np.stack(x.to_numpy()), *shared.value)) if len(x) else [])

        out = df.withColumn("__margin", margins(vector_to_array(self.features)))
        m = F.col("__margin")
        if self.objective == "regression":
            return out.withColumn("prediction", m[0]).drop("__margin")
        if self.objective == "binary":
            p = 1.0 / (1.0 + F.exp(-m[0]))
            raw, prob = F.array(-m[0], m[0]), F.array(1.0 - p, p)
            best = F.when(m[0] > 0, 1.0).otherwise(0.0)
        else:
            shifted = F.transform(m, lambda v: F.exp(v - F.array_max(m)))
            total = F.aggregate(shifted, F.lit(0.0), lambda a, v: a + v)
            raw, prob = m, F.transform(shifted, lambda v: v / total)
            best = (F.array_position(m, F.array_max(m)) - 1).cast("double")
        return (out.withColumns({"rawPrediction": array_to_vector(raw), "probability": array_to_vector(prob), "prediction": best})
                .drop("__margin"))

    def state(self) -> dict:
        trees = [t for r in self.rounds for t in r]
        return {"objective": self.objective, "features": self.features, "outputs": len(self.start),
                "start": self.start.tolist(), "gains": self.gains.tolist(),
                "trees": [{k: v if isinstance(v, int) else v.tolist() for k, v in vars(t).items()} for t in trees]}

    def restore(self, state: dict) -> None:
        kinds = dict(feature=np.int64, cut=np.int64, threshold=float, missing_left=bool, left=np.int64, right=np.int64, value=float)
        trees = [Tree(**{k: np.array(t[k], kind) for k, kind in kinds.items()}, depth=t["depth"]) for t in state["trees"]]
        n = state["outputs"]
        self.rounds = [trees[i:i + n] for i in range(0, len(trees), n)]
        self.objective, self.features = state["objective"], state["features"]
        self.start, self.gains = np.array(state["start"]), np.array(state["gains"])
