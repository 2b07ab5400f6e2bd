"""Random forests on wide, mostly empty vectors (one-hot features), as Spark jobs.

A vector as wide as a table has ids is never spread out. Features that hold other
values than 0 and 1 (the numeric columns) are binned as in ``forest``; every other
feature is an indicator, told by the rows that have it. A node draws ``ceil(sqrt)``
of all features, as often as its rows and the forest's seed say, and the sums of an
indicator are those of its rows in the node; the other side is the node's sums less
these. So a node costs what its drawn features or its own rows hold, whichever is
less, however many features there are.

As in ``forest``, a table that fits in a task is read by tasks that grow some trees
each; in a larger one the nodes that are too large for a task are split by jobs.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import forest as fo
from .boosting import BLOCK_ROWS, bin_rows, cut_points

#: Places (drawn features of nodes, rows of drawn features) that a task looks up at once, and rows that are scored at once.
PLACES = 2_000_000
SCORE_ROWS = 2_048
#: A row found through a drawn feature costs this share of one found through the node's rows.
POSTING_COST = 0.125


@dataclass
class Wide:
    """Cut points of the valued features (their numbers ascend); a split on indicator f is the place ``len(cuts.feature) + f``."""

    features: int
    valued: np.ndarray
    cuts: fo.Cuts

    @property
    def places(self) -> int:
        return len(self.cuts.feature)

    def feature(self, code: np.ndarray) -> np.ndarray:
        """The feature of each place."""
        out = code - self.places
        own = np.flatnonzero(code < self.places)
        out[own] = self.valued[self.cuts.feature[code[own]]]
        return out

    def drawn(self, spec: fo.ForestSpec, nodes: int, key: tuple) -> np.ndarray:
        """The features that each node considers, ascending (node x feature)."""
        rng, take = np.random.default_rng([spec.seed, *key]), spec.sampled(self.features)
        return np.sort(np.stack([rng.choice(self.features, take, replace=False, shuffle=False) for _ in range(nodes)]), axis=1)

    def valued_of(self, drawn: np.ndarray) -> np.ndarray:
        """Which valued features each node drew (node x valued feature)."""
        out = np.zeros((len(drawn), len(self.valued)), bool)
        node, j = np.nonzero(np.isin(drawn, self.valued))
        out[node, np.searchsorted(self.valued, drawn[node, j])] = True
        return out


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, .. for each range, one range after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Rows:
    """Rows of a block or of a node: bins of the valued features (feature x row) and each row's indicators."""

    def __init__(self, x: np.ndarray, size: np.ndarray, ones: np.ndarray) -> None:
        self.x, self.size, self.ones = x, size, ones
        self.start = np.cumsum(size) - size

    @classmethod
    def joined(cls, parts: list["Rows"]) -> "Rows":
        return cls(*(np.concatenate([getattr(p, f) for p in parts], axis=-1) for f in ("x", "size", "ones")))

    def taken(self, rows: np.ndarray) -> "Rows":
        return Rows(self.x[:, rows], self.size[rows], self.ones[ranges(self.start[rows], self.size[rows])])

    def by_feature(self) -> None:
        """Find the rows of each indicator."""
        order = np.argsort(self.ones, kind="stable")
        held = self.ones[order]
        self.first = np.flatnonzero(np.diff(held, prepend=-1))
        self.present, self.count = held[self.first], np.diff(self.first, append=len(held))
        self.owner = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)[order]

    def places_of(self, features: np.ndarray) -> np.ndarray:
        """The place of each feature among those present, -1 if no row has it."""
        if not len(self.present):
            return np.full(features.shape, -1)
        at = np.minimum(np.searchsorted(self.present, features), len(self.present) - 1)
        return np.where(self.present[at] == features, at, -1)

    def leaves(self, tree: fo.Tree, wide: Wide) -> np.ndarray:
        """The node of each row."""
        out = np.zeros(len(self.size), np.int64)
        used = np.unique(tree.code[tree.code >= wide.places]) - wide.places
        owner = np.repeat(np.arange(len(self.size)), self.size)
        at = np.searchsorted(used, self.ones)
        held = np.flatnonzero(np.append(used, -1)[at] == self.ones)
        at, owner = at[held], owner[held]
        # a place of the indicators that the tree asks for, or of a bin
        number = np.searchsorted(used, tree.code - wide.places)
        for a in range(0, len(out), SCORE_ROWS):
            some = slice(a, min(a + SCORE_ROWS, len(out)))
            has = np.zeros((len(used), some.stop - a), bool)
            here = slice(*np.searchsorted(owner, [some.start, some.stop]))
            has[at[here], owner[here] - a] = True
            out[some] = _leaves(tree, wide, self.x[:, some], has, number)
        return out


def _leaves(tree: fo.Tree, wide: Wide, x: np.ndarray, has: np.ndarray, number: np.ndarray) -> np.ndarray:
    node = np.zeros(has.shape[1], np.int64)
    rows = np.arange(len(node)) if tree.code[0] >= 0 else np.zeros(0, np.int64)
    while len(rows):
        own = node[rows]
        code = tree.code[own]
        right = np.zeros(len(rows), bool)
        one = code >= wide.places
        right[one] = has[number[own[one]], rows[one]]
        cut = ~one
        right[cut] = x[wide.cuts.feature[code[cut]], rows[cut]] > wide.cuts.cut[code[cut]]
        node[rows] = below = tree.left[own] + right
        rows = rows[tree.code[below] >= 0]
    return node


# --- splits --------------------------------------------------------------------------------------

def grown_here(rows: Rows, y: np.ndarray, w: np.ndarray, c: np.ndarray, wide: Wide, spec: fo.ForestSpec,
               key: tuple, depth: int = 0) -> tuple[fo.Tree, tuple[np.ndarray, np.ndarray]]:
    """The subtree of a node's rows (labels, weights and draws of each) and (features, gains) of its splits; see ``by_feature``."""
    order, nodes, count, classes = np.flatnonzero(c > 0), 1, 0, spec.classes
    slot = np.zeros(len(order), np.int64)
    codes, lefts, totals, features, gains, level = [], [], [], [], [], 0
    w = w * c
    while nodes:
        total = fo.sums(slot, nodes, y[order], w[order], c[order], classes)
        code, left = np.full(nodes, -1, np.int64), np.zeros(nodes, np.int32)
        codes.append(code), lefts.append(left), totals.append(total)
        count += nodes
        open_ = np.flatnonzero(fo.may_split(total, depth + level, spec))
        number = np.full(nodes, -1)
        number[open_] = np.arange(len(open_))
        slot = number[slot]
        order, slot = order[slot >= 0], slot[slot >= 0]
        total = total[:, open_]
        node_of = np.full(len(c), -1, np.int32)
        node_of[order] = slot
        gain, place = _best_of_level(rows, order, slot, node_of, total, y, w, c, wide, spec, (*key, level))
        split = fo.gains_enough(gain, total, spec)
        features.append(wide.feature(place[split])), gains.append(gain[split])
        code[open_[split]] = place[split]
        left[open_[split]] = count + 2 * np.arange(split.sum())
        right = _right(rows, place, split, node_of, wide)
        keep = split[slot]
        order, slot = order[keep], slot[keep]
        cut = np.flatnonzero(place[slot] < wide.places)
        at = place[slot[cut]]
        right[order[cut]] = rows.x[wide.cuts.feature[at], order[cut]] > wide.cuts.cut[at]
        slot = 2 * (np.cumsum(split) - 1)[slot] + right[order]
        by = np.argsort(slot, kind="stable")
        order, slot, nodes, level = order[by], slot[by], 2 * int(split.sum()), level + 1
    found = np.concatenate(features), np.concatenate(gains)
    return fo.made_tree(np.concatenate(codes), np.concatenate(lefts), np.concatenate(totals, 1), spec), by_feature(*found)


def by_feature(features: np.ndarray, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once, with the sum of its gains."""
    kept, at = np.unique(features, return_inverse=True)
    return kept, np.bincount(at, gains, len(kept))


def _right(rows: Rows, place: np.ndarray, split: np.ndarray, node_of: np.ndarray, wide: Wide) -> np.ndarray:
    """The rows that have the indicator which their node is split by."""
    out = np.zeros(len(node_of), bool)
    node = np.flatnonzero(split & (place >= wide.places))
    at = rows.places_of(place[node] - wide.places)
    owner = rows.owner[ranges(rows.first[at], rows.count[at])] if len(node) else np.zeros(0, np.int64)
    out[owner[node_of[owner] == np.repeat(node, rows.count[at])]] = True
    return out


def _best_of_level(rows: Rows, order, slot, node_of, total, y, w, c, wide: Wide, spec: fo.ForestSpec, key: tuple):
    """(gain, place) of each node of a level by its sums (sums x node); rows are in order of their nodes."""
    nodes = total.shape[1]
    best, place = np.full(nodes, -np.inf), np.zeros(nodes, np.int64)
    step = max(1, PLACES // (4 * spec.sampled(wide.features)))
    for a in range(0, nodes, step):
        m = min(step, nodes - a)
        here = slice(*np.searchsorted(slot, [a, a + m]))
        drawn = wide.drawn(spec, m, (*key, a))
        some = slice(a, a + m)
        _best_cuts(rows.x, order[here], slot[here] - a, wide.valued_of(drawn), total[:, some], y, w, c, wide, spec, best[some], place[some])
        for i, j, pair, row in _held(rows, order[here], slot[here] - a, node_of, a, drawn):
            if len(pair):
                _best_ones(pair, row, drawn[i:j], total[:, a + i:a + j], y, w, c, wide, spec, best[a + i:a + j], place[a + i:a + j])
    return best, place


def _best_cuts(x, rows, own, chosen, total, y, w, c, wide: Wide, spec: fo.ForestSpec, best, place) -> None:
    """Better cuts of the valued features that each node drew, into ``best`` and ``place``."""
    bins = wide.cuts.bins
    for j in np.flatnonzero(chosen.any(0)):
        of = np.flatnonzero(chosen[:, j])
        r = np.flatnonzero(chosen[own, j])
        at, r = np.searchsorted(of, own[r]), rows[r]
        at = at * bins + np.minimum(x[j][r], bins - 1)
        found, number = np.unique(at, return_inverse=True)
        gain, cut = fo.best_cuts(fo.sums(number, len(found), y[r], w[r], c[r], spec.classes), found // bins, total[:, of], spec)
        better = gain > best[of]
        best[of[better]] = gain[better]
        place[of[better]] = wide.cuts.first[j] + found[cut[better]] % bins


def _held(rows: Rows, order, own, node_of, a: int, drawn: np.ndarray):
    """(nodes from, to, places in ``drawn`` from there, rows) of the nodes' rows that have an indicator their node drew.

    Either the rows of the drawn features are looked through for the node's, or the features of its rows for the drawn.
    """
    m, take = drawn.shape
    at = rows.places_of(drawn)
    count = np.where(at >= 0, rows.count[at], 0) if len(rows.present) else np.zeros(drawn.shape, np.int64)
    through = count.sum(1)
    held = np.bincount(own, rows.size[order], m).astype(np.int64)
    by_rows = through * POSTING_COST > held
    cost = np.cumsum(np.where(by_rows, held, through))
    at_row = np.searchsorted(own, np.arange(m + 1))
    i = 0
    while i < m:
        j = max(i + 1, int(np.searchsorted(cost, (cost[i - 1] if i else 0) + PLACES, side="right")))
        pairs, found = [], []
        node, nth = np.nonzero((count[i:j] > 0) & ~by_rows[i:j, None])
        size = count[i:j][node, nth]
        owner = rows.owner[ranges(rows.first[at[i:j][node, nth]], size)] if len(node) else np.zeros(0, np.int64)
        hit = node_of[owner] == np.repeat(node + (a + i), size)
        pairs.append(np.repeat(node * take + nth, size)[hit]), found.append(owner[hit])
        r, n = order[at_row[i]:at_row[j]], own[at_row[i]:at_row[j]] - i
        small = by_rows[i:j][n]
        r, n = r[small], n[small]
        if len(r):
            size, width = rows.size[r], max(int(rows.present[-1]), int(drawn[i:j].max())) + 1
            asked = np.repeat(n, size) * width + rows.ones[ranges(rows.start[r], size)]
            drew = (drawn[i:j] + np.arange(j - i)[:, None] * width).reshape(-1)
            pair = np.minimum(np.searchsorted(drew, asked), len(drew) - 1)
            hit = drew[pair] == asked
            pairs.append(pair[hit]), found.append(np.repeat(r, size)[hit])
        yield i, j, np.concatenate(pairs), np.concatenate(found)
        i = j


def _best_ones(pair, row, drawn, total, y, w, c, wide: Wide, spec: fo.ForestSpec, best, place) -> None:
    """Better splits on indicators: the rows that have a drawn feature against the others of the node."""
    found, number = np.unique(pair, return_inverse=True)
    ones = fo.sums(number, len(found), y[row], w[row], c[row], spec.classes)
    _take_ones(found, ones, drawn, total, wide, spec, best, place)


def _take_ones(found, ones, drawn, total, wide: Wide, spec: fo.ForestSpec, best, place) -> None:
    node = found // drawn.shape[1]
    gain = ones_gain(ones, total[:, node], spec)
    first = np.flatnonzero(np.diff(node, prepend=-1))
    own, top = node[first], np.maximum.reduceat(gain, first)
    at = np.flatnonzero(gain == np.repeat(top, np.diff(first, append=len(node))))
    at = at[np.flatnonzero(np.diff(node[at], prepend=-1))]
    better = top > best[own]
    best[own[better]] = top[better]
    place[own[better]] = wide.places + drawn.reshape(-1)[found[at[better]]]


def ones_gain(ones: np.ndarray, total: np.ndarray, spec: fo.ForestSpec) -> np.ndarray:
    """Gain of parting the rows with the given sums from their node's."""
    rest, least = total - ones, max(spec.min_rows, 1) - 0.5
    gain = fo.purity(ones, spec.classes) + fo.purity(rest, spec.classes) - fo.purity(total, spec.classes)
    gain[(ones[-1] < least) | (rest[-1] < least)] = -np.inf
    return gain


# --- rows and blocks -----------------------------------------------------------------------------

def entries(features: str) -> tuple[Column, Column]:
    """(numbers, values) of a vector's entries; a dense vector has all of them."""
    v = F.unwrap_udt(features)
    return F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1)), v["values"]


def parted(size: np.ndarray, index: np.ndarray, value: np.ndarray, valued: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values of the valued features, row x feature; indicators of each row; their numbers) of rows' entries."""
    owner = np.repeat(np.arange(len(size)), size)
    at = np.searchsorted(valued, index)
    own = np.append(valued, -1)[at] == index
    x = np.zeros((len(size), len(valued)))
    x[owner[own], at[own]] = value[own]
    one = ~own & ~(value <= 0)
    return x, np.bincount(owner[one], minlength=len(size)), index[one]


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(np.asarray(column.offsets)).astype(np.int64)
    return size, np.asarray(column.flatten(), kind)


def valued_features(data: DataFrame) -> np.ndarray:
    """Features with a value other than 0 and 1."""
    def run(batches):
        found = np.zeros(0, np.int64)
        for b in batches:
            index, value = (_flat(b.column(i), k)[1] for i, k in ((0, np.int64), (1, np.float64)))
            found = np.union1d(found, index[(value != 0) & (value != 1)])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["f"])

    return np.array(sorted(r["f"] for r in data.select("i", "v").mapInArrow(run, "f long").distinct().collect()), np.int64)


def _dense(data: DataFrame, valued: np.ndarray) -> DataFrame:
    """The valued features' values as arrays (x)."""
    def run(batches):
        for b in batches:
            size, index = _flat(b.column(0), np.int64)
            x, _, _ = parted(size, index, _flat(b.column(1), np.float64)[1], valued)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(valued))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))], names=["x"])

    return data.select("i", "v").mapInArrow(run, "x array<double>")


def _blocks(data: DataFrame, wide_) -> DataFrame:
    """Rows (i, v, y, w) as binary blocks."""
    def run(batches):
        part, number, wide, held = TaskContext.get().partitionId(), 0, wide_.value, []

        def flush():
            x, size, ones, y, w = (np.concatenate(c) for c in zip(*held))
            held.clear()
            cols = [pa.array([v], pa.int64()) for v in (part, number, len(y))] + [
                pa.array([a.tobytes()], pa.binary()) for a in (x.T, size.astype("<i4"), ones.astype("<i4"), y, w)]
            return pa.RecordBatch.from_arrays(cols, names=["part", "number", "n", "x", "size", "ones", "y", "w"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                size, index = _flat(piece.column(0), np.int64)
                x, size, ones = parted(size, index, _flat(piece.column(1), np.float64)[1], wide.valued)
                held.append((bin_rows(x, wide.cuts.cuts), size, ones, *(np.asarray(piece.column(i), np.float64) for i in (2, 3))))
                if sum(len(h[1]) for h in held) >= BLOCK_ROWS:
                    yield flush()
                    number += 1
        if held:
            yield flush()

    return data.mapInArrow(run, "part long, number long, n long, x binary, size binary, ones binary, y binary, w binary")


@dataclass
class Block:
    key: tuple[int, int]
    rows: Rows
    y: np.ndarray
    w: np.ndarray

    @classmethod
    def of(cls, row, valued: int, scale: tuple[float, float]) -> "Block":
        x, size, ones = (np.frombuffer(row[f], t) for f, t in (("x", np.uint8), ("size", "<i4"), ("ones", "<i4")))
        return cls((row["part"], row["number"]), Rows(x.reshape(valued, row["n"]), size.astype(np.int64), ones),
                   (np.frombuffer(row["y"]) - scale[0]) / scale[1], np.frombuffer(row["w"]))


# --- trees of a small and of a large table -------------------------------------------------------

def forest_here(made: DataFrame, shared, spec: fo.ForestSpec, scale: tuple[float, float]) -> list:
    """All trees of a table that fits in a task: each task reads the blocks and grows a few."""
    sc = made.sparkSession.sparkContext
    shares = [list(range(t, min(t + fo.TASK_TREES, spec.trees))) for t in range(0, spec.trees, fo.TASK_TREES)]

    def run(pairs):
        own, held, wide = None, [], shared.value
        for own, row in pairs:
            held.append(Block.of(row, len(wide.valued), scale))
        if own is None:
            return
        held.sort(key=lambda b: b.key)
        rows = Rows.joined([b.rows for b in held])
        rows.by_feature()
        y, w = fo.weights_of(*(np.concatenate([getattr(b, f) for b in held]) for f in "yw"), spec.classes)
        for t in own:
            yield t, grown_here(rows, y, w, np.concatenate([spec.draws(t, b) for b in held]), wide, spec, (t, 0))

    pairs = sc.parallelize(shares, len(shares)).cartesian(made.rdd.coalesce(1))
    return [grown for _, grown in sorted(pairs.mapPartitions(run).collect(), key=lambda g: g[0])]


def forest_by_jobs(made: DataFrame, partitions: int, small: int, shared, spec: fo.ForestSpec, scale: tuple[float, float]):
    """As ``forest_here``, the nodes of more than ``small`` rows split by a job a level, ``WAVE`` trees at a time."""
    wide = shared.value
    state = made.rdd.map(lambda row: Block.of(row, len(shared.value.valued), scale))
    for start in range(0, spec.trees, fo.WAVE):
        growing = {t: fo.Growing(0) for t in range(start, min(start + fo.WAVE, spec.trees))}
        gains: dict[int, list] = {t: [] for t in growing}
        due, near = {t: [0] for t in growing}, {t: [] for t in growing}
        while any(due.values()):
            sketches = {t: (growing[t].sketch(), ids) for t, ids in due.items() if ids}
            found = _split_large(state, partitions, sketches, shared, spec)
            due = {t: [] for t in growing}
            for (t, i), (total, gain, code, left) in sorted(found.items(), key=lambda f: f[0]):
                tree = growing[t]
                if tree.total[i] is None:
                    tree.total[i] = total
                if not fo.gains_enough(gain, total, spec):
                    continue
                gains[t].append((wide.feature(np.array([code])), np.array([gain])))
                for j in tree.split(i, code, [left, total - left]):
                    if fo.may_split(tree.total[j][:, None], tree.depth[j], spec)[0]:
                        (near if tree.total[j][-1] <= small else due)[t].append(j)
        sketches = {t: (growing[t].sketch(), {i: growing[t].depth[i] for i in ids}) for t, ids in near.items() if ids}
        for (t, i), (sub, found) in _finished(state, partitions, sketches, shared, spec) if sketches else []:
            growing[t].below[i] = sub
            gains[t].append(found)
        for t in sorted(growing):
            none = [(np.zeros(0, np.int64), np.zeros(0))]
            yield growing[t].tree(spec), by_feature(*(np.concatenate(g) for g in zip(*(gains[t] or none))))


def _split_large(state, partitions: int, sketches: dict, shared, spec: fo.ForestSpec) -> dict:
    """By (tree, node): sums, and gain, place and the left side's sums of the best split."""
    def run(blocks_):
        held: dict = {}
        wide = shared.value
        bins = wide.cuts.bins
        for b in blocks_:
            y, w = fo.weights_of(b.y, b.w, spec.classes)
            for t, (sketch, ids) in sketches.items():
                c = spec.draws(t, b)
                leaf = b.rows.leaves(sketch, wide)
                for i in ids:
                    r = np.flatnonzero((leaf == i) & (c > 0))
                    if not len(r):
                        continue
                    drawn = wide.drawn(spec, 1, (t, i, 1))[0]
                    own = (y[r], w[r] * c[r], c[r])
                    size = b.rows.size[r]
                    ones = b.rows.ones[ranges(b.rows.start[r], size)]
                    at = np.minimum(np.searchsorted(drawn, ones), len(drawn) - 1)
                    hit = np.flatnonzero(drawn[at] == ones)
                    of = np.repeat(np.arange(len(r)), size)[hit]
                    parts = [fo.sums(np.zeros(len(r), np.int64), 1, *own, spec.classes),
                             fo.sums(at[hit], len(drawn), *(v[of] for v in own), spec.classes)]
                    parts += [fo.sums(np.minimum(b.rows.x[j][r], bins - 1).astype(np.int64), bins, *own, spec.classes)
                              for j in np.flatnonzero(wide.valued_of(drawn[None])[0])]
                    found = np.concatenate(parts, 1)
                    held[t, i] = held[t, i] + found if (t, i) in held else found
        return held.items()

    def best(item):
        (t, i), found = item
        wide = shared.value
        drawn, bins = wide.drawn(spec, 1, (t, i, 1)), wide.cuts.bins
        total, take = found[:, :1], drawn.shape[1]
        ones = found[:, 1:1 + take]
        top, code, left = -np.inf, 0, total[:, 0]
        for n, j in enumerate(np.flatnonzero(wide.valued_of(drawn)[0])):
            hist = found[:, 1 + take + n * bins:][:, :bins]
            gain, cut = fo.best_cuts(hist, np.zeros(bins, np.int64), total, spec)
            if gain[0] > top:
                top, code, left = gain[0], wide.cuts.first[j] + cut[0], hist[:, :cut[0] + 1].sum(1)
        gain = ones_gain(ones, np.repeat(total, take, 1), spec)
        f = int(gain.argmax())
        if gain[f] > top:
            top, code, left = gain[f], wide.places + drawn[0, f], total[:, 0] - ones[:, f]
        return (t, i), (total[:, 0], float(top), int(code), left)

    nodes = sum(len(ids) for _, ids in sketches.values())
    return dict(state.mapPartitions(run).reduceByKey(operator.add, min(nodes, 4 * partitions)).map(best).collect())


def _finished(state, partitions: int, sketches: dict, shared, spec: fo.ForestSpec) -> list:
    """((tree, node), (its subtree, its gains)) of nodes whose rows fit in a task."""
    def rows_of(b):
        y, w = fo.weights_of(b.y, b.w, spec.classes)
        for t, (sketch, ids) in sketches.items():
            c = spec.draws(t, b)
            leaf = b.rows.leaves(sketch, shared.value)
            for i in ids:
                r = np.flatnonzero((leaf == i) & (c > 0))
                if len(r):
                    yield (t, i), (b.key, b.rows.taken(r), y[r], w[r], c[r])

    def grow(item):
        (t, i), parts = item
        parts = sorted(parts, key=lambda p: p[0])
        rows = Rows.joined([p[1] for p in parts])
        rows.by_feature()
        y, w, c = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        return (t, i), grown_here(rows, y, w, c, shared.value, spec, (t, i), sketches[t][1][i])

    nodes = sum(len(ids) for _, ids in sketches.values())
    return state.flatMap(rows_of).groupByKey(max(partitions, min(nodes, 8 * partitions))).map(grow).collect()


# --- fitting and scoring -------------------------------------------------------------------------

def fit(df: DataFrame, features: str, label: Column, weight: Column, width: int, spec: fo.ForestSpec):
    """(trees, cut points, scale, (features, shares of gain), valued features) of a forest on wide vectors."""
    index, value = entries(features)
    data = df.select(index.alias("i"), value.alias("v"), label.alias("y"), weight.alias("w"))
    valued = valued_features(data)
    rows, held, mean, spread = data.agg(F.count("*"), F.sum(F.size("i")), F.avg("y"), F.stddev_pop("y")).first()
    scale = (0.0, 1.0) if spec.classes else (mean, spread or 1.0)
    x = _dense(data, valued)
    fine, coarse = cut_points(x, len(valued), fo.FINE_CUTS, fo.MAX_CUTS)
    wide = Wide(width, valued, fo.Cuts([f if len(f) <= fo.MAX_CUTS else c for f, c in zip(fine, coarse)]))
    shared = df.sparkSession.sparkContext.broadcast(wide)
    partitions = max(1, min(data.rdd.getNumPartitions(), math.ceil(held / fo.TASK_CELLS)))
    made = _blocks(data.coalesce(partitions), shared).checkpoint()
    if held <= fo.LOCAL_CELLS:
        found = forest_here(made, shared, spec, scale)
    else:
        found = list(forest_by_jobs(made, partitions, fo.LOCAL_CELLS * rows // held, shared, spec, scale))
    shares = [(f, g / g.sum()) for _, (f, g) in found if g.sum() > 0]
    none = [(np.zeros(0, np.int64), np.zeros(0))]
    return [t for t, _ in found], wide.cuts.cuts, scale, by_feature(*(np.concatenate(s) for s in zip(*(shares or none)))), valued


def mean_values(index: pd.Series, value: pd.Series, trees: list[fo.Tree], wide: Wide) -> np.ndarray:
    """The mean of the trees' leaves (row x value) for rows' entries."""
    size = index.map(len).to_numpy(np.int64)
    x, size, ones = parted(size, np.concatenate(index.to_numpy()).astype(np.int64), np.concatenate(value.to_numpy()), wide.valued)
    used = np.unique(np.concatenate([t.code for t in trees])) - wide.places
    asked = np.isin(ones, used[used >= 0])
    size = np.bincount(np.repeat(np.arange(len(size)), size)[asked], minlength=len(size))
    rows = Rows(np.ascontiguousarray(bin_rows(x, wide.cuts.cuts).T), size, ones[asked])
    out = np.zeros((len(size), trees[0].value.shape[1]))
    for tree in trees:
        out += tree.value[tree.left[rows.leaves(tree, wide)]]
    return out / len(trees)


class WideForestModel(fo.ForestModel):
    """A fitted forest on wide vectors."""

    def __init__(self, trees=None, cuts=None, classes=0, scale=(0.0, 1.0), gains=None, features="features", width=0, valued=()) -> None:
        kept, shares = gains or (np.zeros(0, np.int64), np.zeros(0))
        super().__init__(trees, cuts, classes, scale, shares, features)
        self.kept, self.width, self.valued = kept, width, np.asarray(valued, np.int64)

    @property
    def importances(self) -> np.ndarray:
        """As of ``ForestModel``, by feature; ``gains`` are those of the features ``kept``."""
        out = np.zeros(self.width)
        out[self.kept] = super().importances
        return out

    def _values(self, df: DataFrame) -> Column:
        shared = df.sparkSession.sparkContext.broadcast((self.trees, Wide(self.width, self.valued, fo.Cuts(self.cuts))))

        @F.pandas_udf("array<double>")
        def values(index: pd.Series, value: pd.Series) -> pd.Series:
            return pd.Series(list(mean_values(index, value, *shared.value)) if len(index) else [])

        return values(*entries(self.features))

    def state(self) -> dict:
        return super().state() | {"width": self.width, "valued": self.valued.tolist(), "kept": self.kept.tolist()}

    def restore(self, state: dict) -> None:
        super().restore(state)
        self.width = state["width"]
        self.kept, self.valued = (np.array(state[k], np.int64) for k in ("kept", "valued"))
