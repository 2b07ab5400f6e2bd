"""Forests on binned rows: trees by a plain search, in one task and by jobs; classes, draws, saving, jobs."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from dropflow.operators import forest, wide_forest
from dropflow.operators.forest import ForestSpec, HistogramForest
from dropflow.operators.models import classifiers, regressors
from test_boosting import table


def impurity(y, w, classes):
    if classes:
        p = np.array([w[y == k].sum() for k in range(classes)]) / w.sum()
        return 1 - (p ** 2).sum()
    return (w * (y - (w * y).sum() / w.sum()) ** 2).sum() / w.sum()


def plain_tree(x, y, w, spec, depth=0):
    """Predicted values (classes' shares, or the mean) of the rows by one tree, a split at a time over all values."""
    whole = impurity(y, w, spec.classes) * w.sum()
    best = (1e-9, None)
    for j in range(x.shape[1] if depth < spec.max_depth else 0):
        for t in np.unique(x[:, j])[:-1]:
            a = x[:, j] <= t
            if min(a.sum(), (~a).sum()) >= spec.min_rows:
                gain = whole - impurity(y[a], w[a], spec.classes) * w[a].sum() - impurity(y[~a], w[~a], spec.classes) * w[~a].sum()
                if gain > best[0] + 1e-9:
                    best = (gain, a)
    if best[1] is None:
        return np.tile([w[y == k].sum() / w.sum() for k in range(spec.classes)] if spec.classes else [(w * y).sum() / w.sum()], (len(y), 1))
    out = np.zeros((len(y), max(1, spec.classes)))
    for side in (best[1], ~best[1]):
        out[side] = plain_tree(x[side], y[side], w[side], spec, depth + 1)
    return out


@pytest.mark.parametrize("spec", [ForestSpec(trees=2, classes=3, max_depth=5, min_rows=4, bagging=False),
                                  ForestSpec(trees=2, max_depth=4, min_rows=3, bagging=False)])
@pytest.mark.parametrize("local_cells", [0, 240, 10 ** 9])
def test_trees_are_those_of_a_plain_search(spark, monkeypatch, spec, local_cells):
    """By jobs alone, by jobs down to small nodes, or each tree in one task."""
    monkeypatch.setattr(forest, "LOCAL_CELLS", local_cells)
    monkeypatch.setattr(forest, "TASK_CELLS", 100)
    monkeypatch.setattr(forest, "SUM_CELLS", 200)             # several pieces of a level
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (150, 3)).astype(float)
    signal = x[:, 0] - 0.7 * x[:, 1] + rng.normal(0, 1.5, 150)
    y = np.digitize(signal, [0, 2]).astype(float) if spec.classes else signal
    w = rng.choice([1.0, 2.5], 150)
    model = HistogramForest(spec, weight="weight").fit(table(spark, x, y, w))
    want = {(tuple(a), b): v for a, b, v in zip(x.tolist(), y.tolist(), plain_tree(x, y, w, spec).tolist())}
    got = model.transform(table(spark, x, y, w)).withColumn("x", vector_to_array("features")).collect()
    assert len(got) == 150 and len(model.trees) == 2
    for r in got:
        value = list(r["probability"]) if spec.classes else [r["prediction"]]
        assert value == pytest.approx(want[tuple(r["x"]), r["label"]], abs=1e-6)
    assert sum(model.importances) == pytest.approx(1.0)


@pytest.mark.parametrize("local_cells", [2000, forest.LOCAL_CELLS])
def test_a_forest_learns_and_survives_saving_and_refits_are_equal(spark, monkeypatch, tmp_dir, local_cells):
    monkeypatch.setattr(forest, "LOCAL_CELLS", local_cells)
    monkeypatch.setattr(forest, "TASK_CELLS", 2000)
    monkeypatch.setattr(forest, "WAVE", 8)
    rng = np.random.default_rng(1)
    x = rng.random((2000, 6))
    y = (x[:, 0] > 0.5) * 2.0 + (x[:, 1] > 0.5)
    spec = ForestSpec(trees=20, classes=4, max_depth=8, min_rows=2, sqrt_features=True)
    data, held = table(spark, x[:1500], y[:1500], parts=1).persist(), table(spark, x[1500:], y[1500:])
    model, again = (HistogramForest(spec).fit(data) for _ in range(2))
    assert all(np.array_equal(a.code, b.code) and np.array_equal(a.value, b.value) for a, b in zip(model.trees, again.trees))
    assert len({t.code.tobytes() for t in model.trees}) == 20  # each tree has draws and features of its own
    scored = model.transform(held)
    assert scored.filter(F.col("prediction") == F.col("label")).count() >= 470
    assert model.importances[:2].sum() > 0.8 and model.getNumTrees == 20
    PipelineModel([model]).write().save(f"{tmp_dir}/p")
    loaded = PipelineModel.load(f"{tmp_dir}/p").transform(held)
    key = lambda d: sorted((tuple(r["features"]), r["prediction"], tuple(r["probability"])) for r in d.collect())
    assert key(loaded) == key(scored)


def test_draws_weigh_rows_and_missing_values_go_right(spark):
    x = np.array([[math.nan if i % 3 == 0 else float(i % 20)] for i in range(300)])
    y = np.array([1.0 if i % 3 == 0 else 0.0 for i in range(300)])
    model = HistogramForest(ForestSpec(trees=5, classes=2, max_depth=6)).fit(table(spark, x, y))
    scored = model.transform(table(spark, x, y))
    assert scored.filter(F.isnan(vector_to_array("features")[0]) & (F.col("prediction") == 1.0)).count() == 100
    spec = ForestSpec()
    block = forest.Block((0, 1), None, np.zeros(20000), None, None)
    assert np.array_equal(spec.draws(3, block), spec.draws(3, block)) and not np.array_equal(spec.draws(3, block), spec.draws(4, block))
    assert spec.draws(3, block).mean() == pytest.approx(1.0, abs=0.03)


def test_one_row_and_one_class_do_not_fail(spark):
    for spec in (ForestSpec(trees=3, classes=2), ForestSpec(trees=3)):
        model = HistogramForest(spec).fit(table(spark, np.ones((1, 2)), [1.0]))
        assert model.transform(table(spark, np.ones((2, 2)), [1.0, 1.0])).filter("prediction is not null").count() == 2


@pytest.mark.parametrize("made", [lambda: classifiers("g3", 4, 1.0), lambda: classifiers("g2", 4, 1.0), lambda: regressors("g3")])
def test_deep_trees_need_no_job_a_level(spark, made):
    """The scripts' forests grow all trees to the end in a fixed number of jobs, however deep they are."""
    rng = np.random.default_rng(2)
    data = table(spark, rng.random((2000, 4)), rng.integers(0, 4, 2000).astype(float)).persist()
    sc = spark.sparkContext
    group = f"forest-{data.count()}-{id(data)}"
    sc.setJobGroup(group, "fit")
    model = made()["RandomForest"].fit(data)
    sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(sc.statusTracker().getJobIdsForGroup(group))
    assert model.getNumTrees in (200, 300) and 0 < jobs <= 12


def one_hot(spark, x, y, w=None, parts=3):
    """Rows of numeric columns and a category each as sparse vectors; category k is indicator k."""
    numeric, category, width = x
    rows = [(SparseVector(len(n) + width, [*np.flatnonzero(n).tolist(), len(n) + int(k)], [*n[n != 0].tolist(), 1.0]), float(t),
             float(v)) for n, k, t, v in zip(numeric, category, y, w if w is not None else np.ones(len(y)))]
    return spark.createDataFrame(rows, ["features", "label", "weight"]).repartition(parts)


@pytest.mark.parametrize("spec", [ForestSpec(trees=2, classes=3, max_depth=5, min_rows=4, bagging=False),
                                  ForestSpec(trees=2, max_depth=4, min_rows=3, bagging=False)])
@pytest.mark.parametrize("local_cells", [0, 240, 10 ** 9])
def test_trees_on_wide_vectors_are_those_of_a_plain_search(spark, monkeypatch, spec, local_cells):
    """By jobs alone, by jobs down to small nodes, or each tree in one task."""
    monkeypatch.setattr(forest, "LOCAL_CELLS", local_cells)
    monkeypatch.setattr(forest, "TASK_CELLS", 100)
    rng = np.random.default_rng(4)
    numeric, category = rng.integers(0, 6, (150, 2)).astype(float), rng.integers(0, 7, 150)
    signal = numeric[:, 0] - 3.0 * (category == 2) + 2.0 * (category == 5) + rng.normal(0, 1.5, 150)
    y = np.digitize(signal, [0, 2]).astype(float) if spec.classes else signal
    w = rng.choice([1.0, 2.5], 150)
    data = one_hot(spark, (numeric, category, 9), y, w)
    trees, cuts, scale, gains, valued = wide_forest.fit(data, "features", F.col("label"), F.col("weight"), 11, spec)
    model = wide_forest.WideForestModel(trees, cuts, spec.classes, scale, gains, "features", 11, valued)
    spread = np.concatenate([numeric, category[:, None] == np.arange(9)], axis=1)
    want = {(tuple(a), b): v for a, b, v in zip(spread.tolist(), y.tolist(), plain_tree(spread, y, w, spec).tolist())}
    got = model.transform(data).collect()
    assert len(got) == 150 and len(model.trees) == 2
    for r in got:
        value = list(r["probability"]) if spec.classes else [r["prediction"]]
        assert value == pytest.approx(want[tuple(r["features"].toArray()), r["label"]], abs=1e-6)
    assert sum(model.importances) == pytest.approx(1.0) and len(model.importances) == 11 and not model.importances[-2:].any()


@pytest.mark.parametrize("posting_cost", [0, 10 ** 9])
def test_rows_of_drawn_features_and_features_of_rows_find_the_same_splits(monkeypatch, posting_cost):
    rng = np.random.default_rng(3)
    n, width = 3000, 500
    has = rng.random((n, width)) < rng.random(width) ** 4
    y, c = (has[:, :40].sum(1) + rng.integers(0, 3, n)) % 3, rng.poisson(1.0, n).astype(float)
    wide = wide_forest.Wide(width + 1, np.array([width]), forest.Cuts([np.arange(5.0)]))
    rows = wide_forest.Rows(rng.integers(0, 6, (1, n)).astype(np.uint8), has.sum(1), np.nonzero(has)[1].astype(np.int32))
    rows.by_feature()
    spec = ForestSpec(classes=3, sqrt_features=True)
    plain = wide_forest.grown_here(rows, y, np.ones(n), c, wide, spec, (0, 0))
    monkeypatch.setattr(wide_forest, "POSTING_COST", posting_cost)
    tree, gains = wide_forest.grown_here(rows, y, np.ones(n), c, wide, spec, (0, 0))
    assert np.array_equal(tree.code, plain[0].code) and np.array_equal(tree.value, plain[0].value) and len(tree.code) > 500
    assert np.array_equal(gains[0], plain[1][0]) and np.allclose(gains[1], plain[1][1])
    # every leaf has the classes of the rows that reach it
    leaf = tree.left[rows.leaves(tree, wide)]
    share = np.stack([np.bincount(leaf, c * (y == k), len(tree.value)) for k in range(3)], axis=1)
    assert np.allclose(share / share.sum(1, keepdims=True), tree.value, atol=1e-6)


def test_a_forest_on_as_many_features_as_rows_needs_no_job_a_level(spark, tmp_dir):
    """The predictor's forest: an id a row among the one-hot features; refits and saved models score alike."""
    rng = np.random.default_rng(2)
    n = 2000
    numeric, y = rng.random((n, 3)), np.zeros(n)
    y[numeric[:, 0] > 0.5] = 1.0
    data = one_hot(spark, (numeric, np.arange(n), n), y).persist()
    data.count()
    sc = spark.sparkContext
    group = f"wide-{id(data)}"
    sc.setJobGroup(group, "fit")
    model = classifiers("g1", 2, 1.0)["RandomForest"].fit(data)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert model.getNumTrees == 100 and len({t.code.tobytes() for t in model.trees}) > 50
    assert 0 < len(sc.statusTracker().getJobIdsForGroup(group)) <= 12
    again = classifiers("g1", 2, 1.0)["RandomForest"].fit(data)
    assert all(np.array_equal(a.code, b.code) and np.array_equal(a.value, b.value) for a, b in zip(model.trees, again.trees))
    PipelineModel([model]).write().save(f"{tmp_dir}/p")
    loaded = PipelineModel.load(f"{tmp_dir}/p")
    key = lambda d: sorted((tuple(r["features"].indices), r["prediction"], tuple(r["probability"])) for r in d.collect())
    assert key(loaded.transform(data)) == key(model.transform(data))
    assert np.array_equal(loaded.stages[0].importances, model.importances)


def test_weights_of_one_are_counted_once_and_cut_points_found_in_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(12)
    at, y, c = rng.integers(0, 50, 400), rng.normal(size=400), rng.poisson(1.0, 400).astype(float)
    counted = []
    bincount = np.bincount
    with monkeypatch.context() as m:
        m.setattr(forest.np, "bincount", lambda *a, **k: counted.append(1) or bincount(*a, **k))
        own = forest.sums(at, 50, y, c, c, 0)
        once, counted[:] = len(counted), []
        apart = forest.sums(at, 50, y, c.copy(), c, 0)
    assert once == 2 and len(counted) == 3 and np.array_equal(own, apart)
    calls, found = [], forest.cut_points
    monkeypatch.setattr(forest, "cut_points", lambda data, d, *n: calls.append(n) or found(data, d, *n))
    x = np.stack([np.arange(300) % 7, np.arange(300) / 300], 1)
    model = HistogramForest(ForestSpec(trees=2, max_depth=3)).fit(table(spark, x, np.arange(300) % 5))
    assert calls == [(forest.FINE_CUTS, forest.MAX_CUTS)] and [len(k) for k in model.cuts] == [6, forest.MAX_CUTS]
