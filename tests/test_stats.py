"""Quantiles, labels, box statistics, AUC, weights: goldens and property checks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dropflow.operators.labels import DuplicateEdges, label_binary, label_code, label_quartile, quartile_class
from dropflow.operators.metrics import regression_metrics, roc_auc, weighted_metrics
from dropflow.operators.ordered import global_rank
from dropflow.operators.stats import (box_stats, class_weights, column_medians, column_modes,
                                      exact_quantiles, positive_ratio, quantile_values, rate_threshold)


def test_exact_quantiles_golden(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 10, 11]], "x double")
    assert quantile_values(df, "x", [0.25, 0.5, 0.75]) == [2.25, 3.5, 8.5]


def test_exact_quantiles_match_numpy_grouped(spark):
    rng = np.random.default_rng(7)
    n = 3000
    g = rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1])  # "a" is a hot group
    x = np.round(rng.exponential(2.0, n), 2)
    x[rng.random(n) < 0.1] = 0.0  # many duplicates
    pdf = pd.DataFrame({"g": g, "x": x})
    df = spark.createDataFrame(pdf)
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = {r["g"]: [r[f"p{i}"] for i in range(5)]
           for r in exact_quantiles(df, "x", probs, ["g"], names=[f"p{i}" for i in range(5)]).collect()}
    for key, sub in pdf.groupby("g"):
        assert got[key] == pytest.approx(list(np.quantile(sub["x"], probs)), abs=1e-12)


def test_quantiles_with_more_buckets_than_values(spark):
    df = spark.createDataFrame([(5.0,), (1.0,)], "x double")
    assert quantile_values(df, "x", [0.5]) == [3.0]


def test_global_rank_is_exact(spark):
    rng = np.random.default_rng(1)
    vals = rng.permutation(500).astype(float)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    ranks = {r["v"]: r["_rank"] for r in global_rank(df, ["v"], num_buckets=7).collect()}
    assert all(ranks[float(v)] == int(v) for v in range(500))


def test_thresholds_and_labels(spark):
    df = spark.createDataFrame([(float(v), 20) for v in [1, 2, 3, 4, 10, 11]], "TX_EVASAO double, QT_ING int")
    assert rate_threshold(df, min_volume=10) == 3.5
    lab_gt, t = label_binary(df, "y", op=">", min_volume=10)
    lab_ge, _ = label_binary(df, "y", op=">=", min_volume=10, threshold=3.5)
    assert t == 3.5
    assert sorted(r["y"] for r in lab_gt.collect()) == [0, 0, 0, 1, 1, 1]
    one = spark.createDataFrame([(3.5, 20)], "TX_EVASAO double, QT_ING int")
    assert label_binary(one, "y", op=">=", threshold=3.5)[0].first()["y"] == 1
    assert label_binary(one, "y", op=">", threshold=3.5)[0].first()["y"] == 0
    zero = spark.createDataFrame([(0.0, 20), (0.0, 5)], "TX_EVASAO double, QT_ING int")
    assert rate_threshold(zero) == 0.0
    assert [r["y"] for r in label_binary(zero, "y", op=">=", min_volume=1)[0].collect()] == [1, 1]
    assert lab_ge.count() == 6


def test_quartile_label_bins(spark):
    df = spark.createDataFrame([(v,) for v in [2.25, 3.5, 8.5, 8.51, 0.0]], "r double")
    got = [r[0] for r in df.select(quartile_class(F.col("r"), 2.25, 3.5, 8.5)).collect()]
    assert got == ["muito baixo risco", "baixo risco", "alto risco", "muito alto risco", "muito baixo risco"]
    codes = spark.createDataFrame([(c,) for c in ["alto risco", "baixo risco", "muito alto risco", "muito baixo risco"]], "c string")
    assert [r[0] for r in codes.select(label_code(F.col("c"))).collect()] == [0, 1, 2, 3]


def test_duplicate_quartiles_skip(spark):
    df = spark.createDataFrame([(1.0, 20)] * 10, "TX_EVASAO double, QT_ING int")
    with pytest.raises(DuplicateEdges):
        label_quartile(df)


def test_box_stats_golden(spark):
    df = spark.createDataFrame([(float(v), "k") for v in [1, 2, 3, 4, 100]], "v double, c string")
    r = box_stats(df, "v", ["c"]).first()
    assert (r["q1"], r["median"], r["q3"], r["iqr"]) == (2.0, 3.0, 4.0, 2.0)
    assert (r["lower_fence"], r["upper_fence"]) == (-1.0, 7.0)
    assert (r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (1.0, 4.0, 1)


def test_auc_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "s double, y int")
    assert roc_auc(df, "y", "s").first()["roc_auc"] == 0.875


def test_auc_matches_rank_formula(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(400), 2)
    y = (rng.random(400) < s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    ranks = pd.Series(s).rank()  # midranks
    p = y.sum()
    expected = (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))
    assert roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(expected, abs=1e-12)


def test_weights_and_ratio(spark):
    df = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10, "y int")
    w = {r["y"]: r["weight"] for r in class_weights(df, "y").distinct().collect()}
    assert w[0] == pytest.approx(40 / 60) and w[1] == pytest.approx(2.0)
    assert positive_ratio(df, "y") == 3.0


def test_medians_and_modes(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "a"), (10.0, "b"), (None, None)], "x double, c string")
    assert column_medians(df, ["x"]) == {"x": 2.5}
    assert column_modes(df, ["c"]) == {"c": "a"}  # tie -> smallest


def test_regression_and_weighted_metrics(spark):
    y = [1.0, 2.0, 3.0, 4.0]
    p = [1.5, 2.0, 2.0, 5.0]
    df = spark.createDataFrame(list(zip(y, p)), "y double, p double")
    r = regression_metrics(df, "y", "p").first()
    e = np.array(y) - np.array(p)
    assert r["MAE"] == pytest.approx(np.abs(e).mean())
    assert r["RMSE"] == pytest.approx(np.sqrt((e ** 2).mean()))
    assert r["R2"] == pytest.approx(1 - (e ** 2).sum() / ((np.array(y) - 2.5) ** 2).sum())
    c = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    m = weighted_metrics(c, "y", "p").first()
    # per class: a P=1 R=.5 F1=2/3 (sup 2); b P=1/3 R=1 F1=.5 (sup 1); c P=0 R=0 (sup 1)
    assert m["accuracy"] == 0.5
    assert m["precision_weighted"] == pytest.approx((2 * 1 + 1 / 3) / 4)
    assert m["recall_weighted"] == pytest.approx((2 * 0.5 + 1) / 4)
    assert m["f1_weighted"] == pytest.approx((2 * 2 / 3 + 0.5) / 4)
