"""Histogram boosting: splits by brute force, leaf-wise order, classes, missing values, saving."""

import math
import pickle
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from dropflow.operators import boosting
from dropflow.operators.boosting import BoostSpec, HistogramBooster, Tree, gradients
from dropflow.operators.crew import Crew, shared


def table(spark, x, y, w=None, parts=3):
    rows = [([float(v) for v in a], float(b), float(c)) for a, b, c in zip(x, y, w if w is not None else np.ones(len(y)))]
    df = spark.createDataFrame(rows, "x array<double>, label double, weight double").repartition(parts)
    return df.select(array_to_vector("x").alias("features"), "label", "weight")


def best_split(x, g, h, lam, least):
    """(gain, feature, threshold) over all rows and values."""
    found = (0.0, None, None)
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= t
            if h[left].sum() >= least and h[~left].sum() >= least:
                score = lambda m: g[m].sum() ** 2 / (h[m].sum() + lam)
                gain = score(left) + score(~left) - g.sum() ** 2 / (h.sum() + lam)
                if gain > found[0] + 1e-9:
                    found = (gain, j, t)
    return found


def plain_tree(x, g, h, spec):
    """Leaf-wise (or depth-wise) growth of one tree, a split at a time; returns a value for each row."""
    value = np.zeros(len(g))
    leaves = [(np.arange(len(g)), 0)]
    while True:
        open_ = []
        for n, (rows, depth) in enumerate(leaves):
            if spec.max_depth is None or depth < spec.max_depth:
                gain, j, t = best_split(x[rows], g[rows], h[rows], spec.reg_lambda, spec.min_child_weight)
                if j is not None:
                    open_.append((gain, n, j, t))
        if not open_ or (spec.max_leaves and len(leaves) >= spec.max_leaves):
            break
        _, n, j, t = max(open_)
        rows, depth = leaves.pop(n)
        left = x[rows, j] <= t
        leaves += [(rows[left], depth + 1), (rows[~left], depth + 1)]
    for rows, _ in leaves:
        value[rows] = -spec.learning_rate * g[rows].sum() / (h[rows].sum() + spec.reg_lambda)
    return value


@pytest.mark.parametrize("spec", [
    BoostSpec("binary", rounds=3, learning_rate=0.3, max_depth=3),
    BoostSpec("binary", rounds=2, learning_rate=0.5, max_depth=None, max_leaves=6, reg_lambda=0.1, start_at_mean=True),
    BoostSpec("regression", rounds=3, learning_rate=0.4, max_depth=2),
    BoostSpec("multiclass", rounds=2, learning_rate=0.3, max_depth=None, max_leaves=5, hessian_scale=2.0)])
@pytest.mark.parametrize("local_cells, task_cells", [(0, 100), (160, 100), (boosting.LOCAL_CELLS, 10 ** 9)])
def test_trees_are_those_of_a_plain_search(spark, monkeypatch, spec, local_cells, task_cells):
    """Grown by jobs alone, by jobs down to small nodes, or in one task: the same trees."""
    monkeypatch.setattr(boosting, "LOCAL_CELLS", local_cells)
    monkeypatch.setattr(boosting, "TASK_CELLS", task_cells)
    rng = np.random.default_rng(7)
    x = rng.integers(0, 9, (160, 4)).astype(float) + rng.integers(0, 2, (160, 4)) * 0.5
    signal = x[:, 0] - 0.7 * x[:, 1] + 0.3 * x[:, 2] * (x[:, 3] > 4) + rng.normal(0, 1, 160)
    k = 3 if spec.objective == "multiclass" else 1
    y = {"binary": (signal > 1).astype(float), "regression": signal,
         "multiclass": np.digitize(signal, [0, 2]).astype(float)}[spec.objective]
    w = rng.choice([1.0, 2.0], 160)
    model = HistogramBooster(spec, classes=k, weight="weight").fit(table(spark, x, y, w))
    margin = np.tile(model.start, (160, 1))
    for _ in range(spec.rounds):
        g, h = gradients(y, w, margin, spec)
        margin = margin + np.stack([plain_tree(x, g[:, j], h[:, j], spec) for j in range(k)], 1)
    got = model.transform(table(spark, x, y, w)).select("features", "prediction").withColumn("x", vector_to_array("features"))
    want = {tuple(a): m for a, m in zip(x.tolist(), margin)}
    for r in got.collect():
        m = want[tuple(r["x"])]
        p = m[0] if spec.objective == "regression" else float(m.argmax() if k > 1 else m[0] > 0)
        assert r["prediction"] == pytest.approx(p, abs=1e-8)
    assert sum(model.importances) == pytest.approx(1.0)


def test_learns_a_four_class_rule_and_survives_saving(spark, tmp_dir):
    rng = np.random.default_rng(1)
    x = rng.random((3000, 5))
    y = (x[:, 0] > 0.5) * 2.0 + (x[:, 1] > 0.5)
    spec = BoostSpec("multiclass", rounds=12, learning_rate=0.3, max_depth=None, max_leaves=8, colsample=0.8, subsample=0.8)
    model = HistogramBooster(spec, classes=4).fit(table(spark, x[:2000], y[:2000], parts=4))
    held = table(spark, x[2000:], y[2000:])
    scored = model.transform(held)
    assert scored.filter(F.col("prediction") == F.col("label")).count() >= 970
    sums = scored.select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, v: a + v).alias("s")).distinct()
    assert all(r["s"] == pytest.approx(1.0) for r in sums.collect())
    assert model.importances[:2].sum() > 0.95
    PipelineModel([model]).write().save(f"{tmp_dir}/p")
    again = PipelineModel.load(f"{tmp_dir}/p").transform(held)
    key = lambda d: sorted((tuple(r["features"]), r["prediction"], tuple(r["probability"])) for r in d.collect())
    assert key(again) == key(scored)


def test_missing_values_go_to_the_better_side(spark):
    x = np.array([[math.nan if i % 3 == 0 else float(i % 50)] for i in range(300)])
    y = np.array([1.0 if i % 3 == 0 or i % 50 > 25 else 0.0 for i in range(300)])
    model = HistogramBooster(BoostSpec("binary", rounds=10, learning_rate=0.5, max_depth=2)).fit(table(spark, x, y))
    assert model.transform(table(spark, x, y)).filter("prediction = label").count() == 300


def test_refits_are_equal_and_few_rows_do_not_fail(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random((500, 3)), (rng.random(500) > 0.5).astype(float)
    spec = BoostSpec("binary", rounds=30, subsample=0.7, colsample=0.7, max_depth=3)
    data = table(spark, x, y, parts=1).persist()
    one, two = (HistogramBooster(spec).fit(data) for _ in range(2))
    assert all(np.array_equal(a.value, b.value) for r, s in zip(one.rounds, two.rounds) for a, b in zip(r, s))
    single = HistogramBooster(spec).fit(table(spark, x[:1], [1.0]))
    assert isinstance(single.rounds[0][0], Tree) and single.transform(table(spark, x[:5], y[:5])).count() == 5


@pytest.mark.parametrize("local_cells", [0, 1000])
def test_histograms_and_bins_stay_with_the_tasks(spark, monkeypatch, local_cells):
    """What tasks send to the driver is a few numbers a node, whatever the number of bins."""
    monkeypatch.setattr(boosting, "LOCAL_CELLS", local_cells)
    monkeypatch.setattr(boosting, "TASK_CELLS", 1000)
    rng = np.random.default_rng(5)
    x = rng.random((2000, 40))                            # 40 features of 256 bins: 245 kB of sums a node
    y = x[:, 0] + x[:, 1] ** 2 + rng.normal(0, 0.1, 2000)
    sent = []
    best = boosting._best_splits
    monkeypatch.setattr(boosting, "_best_splits", lambda *a: sent.append(best(*a)) or sent[-1])
    finished = boosting._finished
    monkeypatch.setattr(boosting, "_finished", lambda *a: sent.append(finished(*a)) or sent[-1])
    spec = BoostSpec("regression", rounds=2, max_depth=None, max_leaves=31)
    model = HistogramBooster(spec).fit(table(spark, x, y, parts=4))
    nodes = sum(len(t.feature) for r in model.rounds for t in r)
    assert nodes == 2 * 61 and sent and len(pickle.dumps(sent)) < 3000 * nodes


def test_a_table_of_one_task_is_boosted_many_rounds_a_job(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, y = rng.random((400, 3)), (rng.random(400) > 0.5).astype(float)
    jobs = []
    here = boosting._rounds_here
    monkeypatch.setattr(boosting, "_rounds_here", lambda *a: jobs.append(1) or here(*a))
    model = HistogramBooster(BoostSpec("binary", rounds=60, subsample=0.8, max_depth=3)).fit(table(spark, x, y))
    assert len(model.rounds) == 60 and len(jobs) == math.ceil(60 / boosting.REFRESH)


@pytest.mark.parametrize("spec", [BoostSpec("regression", rounds=3, max_depth=6),
                                  BoostSpec("regression", rounds=3, max_depth=None, max_leaves=12)])
def test_small_nodes_of_a_round_are_finished_together(spark, monkeypatch, spec):
    """Wherever the first splits go, the small nodes wait for the large ones, and the trees are those of one task."""
    rng = np.random.default_rng(8)
    x = rng.random((4000, 4))
    y = np.where(x[:, 0] > 0.8, 9 * x[:, 1], np.where(x[:, 1] > 0.3, 3 * x[:, 2], x[:, 3])) + rng.normal(0, 0.1, 4000)
    data = table(spark, x, y, parts=4).persist()
    whole = HistogramBooster(spec).fit(data)
    monkeypatch.setattr(boosting, "LOCAL_CELLS", 1600)
    monkeypatch.setattr(boosting, "TASK_CELLS", 4000)
    calls, finished = [], boosting._finished
    monkeypatch.setattr(boosting, "_finished", lambda *a: calls.append("finished") or finished(*a))
    rounds, once = [], boosting._round
    monkeypatch.setattr(boosting, "_round", lambda *a: rounds.append(len(calls)) or once(*a))
    parted = HistogramBooster(spec).fit(data)
    a_round = np.diff([*rounds, len(calls)])
    assert len(a_round) == 3 and calls and (a_round <= (1 if spec.max_depth else 2)).all()
    leaves = lambda m: [sorted(np.round(t.value[t.feature < 0], 9)) for r in m.rounds for t in r]
    assert leaves(parted) == leaves(whole)


def test_small_nodes_are_spread_over_the_tasks():
    assert boosting.spread({"a": 5, "b": 9, "c": 4, "d": 1}, 2) == {"b": 0, "a": 1, "c": 1, "d": 0}
    assert sorted(boosting.spread({(0, i): 7 for i in range(8)}, 8).values()) == list(range(8))


def test_best_splits_of_many_nodes_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(9)
    binned = rng.integers(0, 20, (3, 900)).astype(np.uint8)
    slot = rng.integers(0, 9, 900)
    bins = boosting.Bins(np.arange(3), np.full(3, 22), BoostSpec("regression"))
    hists = bins.sums(binned, np.arange(900), slot, 9, rng.normal(size=900), np.ones(900))
    for (sums, best), n in zip(bins.best_splits(hists), range(9)):
        (own, (gain, *place, left)), = bins.best_splits(hists[:, n:n + 1])
        assert np.array_equal(sums, own) and best[:3] == (gain, *place) and np.array_equal(best[3], left)


@pytest.mark.parametrize("spec", [
    BoostSpec("multiclass", rounds=30, max_depth=None, max_leaves=7, min_child_rows=5, start_at_mean=True),
    BoostSpec("binary", rounds=30, max_depth=4, subsample=0.8, colsample=0.8),
    BoostSpec("regression", rounds=30, max_depth=None, max_leaves=9)])
def test_a_larger_table_is_boosted_by_one_task_with_helpers(spark, monkeypatch, spec):
    """Cells beyond a node's limit, within that of the cores: a job does 25 rounds, with the trees of the jobs a level."""
    rng = np.random.default_rng(10)
    x = rng.integers(0, 30, (900, 4)).astype(float)
    x[rng.random(x.shape) < 0.1] = math.nan
    y = (np.nan_to_num(x[:, 0]) > 9).astype(float) + (np.nan_to_num(x[:, 1]) > 15) * (spec.objective != "binary")
    y += rng.normal(0, 0.3, 900) * (spec.objective == "regression")
    data = table(spark, x, y, parts=3).persist()
    monkeypatch.setattr(boosting, "TASK_CELLS", 1500)
    monkeypatch.setattr(boosting, "CREW_CELLS", 0)
    calls, rounds = [], []
    here, by_jobs = boosting._rounds_here, boosting._round
    monkeypatch.setattr(boosting, "_rounds_here", lambda *a: calls.append(a[-1]) or here(*a))
    monkeypatch.setattr(boosting, "_round", lambda *a: rounds.append(1) or by_jobs(*a))
    classes = 3 if spec.objective == "multiclass" else 2
    fits = []
    for cells, n in (400, 30), (60, 3):                   # 4 cores: tables of 3,600 and of 540 cells
        monkeypatch.setattr(boosting, "LOCAL_CELLS", cells)
        fits.append(HistogramBooster(replace(spec, rounds=n), classes=classes).fit(data))
    assert calls == [4, 4] and len(rounds) == 3
    leaves = lambda m: [sorted(np.round(t.value[t.feature < 0], 6)) for r in m.rounds[:3] for t in r]
    assert len(fits[0].rounds) == 30 and leaves(fits[0]) == leaves(fits[1])


def test_helpers_answer_and_their_failure_is_the_tasks():
    class Job:
        def __init__(self):
            self.seen = shared(3)

        def note(self, own, all_, x):
            self.seen[own] = x * (own + 1)
            return own, all_

        def fail(self, own, all_):
            if own:
                raise ValueError("told")

    job = Job()
    with Crew(3, job) as crew:
        assert crew.work("note", 2.0) == [(0, 3), (1, 3), (2, 3)] and job.seen.tolist() == [2.0, 4.0, 6.0]
        assert crew.work("note", 5.0, alone=True) == [(0, 1)] and job.seen.tolist() == [5.0, 4.0, 6.0]
        with pytest.raises(RuntimeError, match="told"):
            crew.work("fail")


def test_cut_points_are_quantiles(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 500)
    rng = np.random.default_rng(11)
    x = np.stack([rng.normal(size=20_000), rng.integers(0, 3, 20_000), np.full(20_000, 7.0), np.full(20_000, math.nan)], 1)
    x[:50, 1] = math.nan
    data = spark.createDataFrame([(a.tolist(),) for a in x], "x array<double>").repartition(3)
    fine, few, one, none = boosting.cut_points(data, 4, 20)
    rank = np.searchsorted(np.sort(x[:, 0]), fine, side="right") / 20_000
    assert rank == pytest.approx(np.arange(1, 21) / 21, abs=1 / 200)
    assert few.tolist() == [0.0, 1.0] and not len(one) and not len(none)
    assert [len(c) for c in boosting.cut_points(data.limit(0), 4, 20)] == [0] * 4
