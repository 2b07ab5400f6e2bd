"""Iterations of the classifiers follow the scripts of each profile."""

import pytest

from dropflow.operators.models import classifiers


@pytest.mark.parametrize("profile, iterations", [("g1", 1000), ("g2", 200), ("g3", 5000)])
def test_iterations_of_each_profile(spark, profile, iterations):
    assert classifiers(profile, 2, 100.0, 1.0)["LogisticRegression"].getMaxIter() == iterations


@pytest.mark.parametrize("profile, hidden, activation, alpha, iterations", [
    ("g1", (100,), "relu", 1e-4, 500), ("g2", (128, 64), "relu", 1e-4, 500), ("g3", (128, 64), "tanh", 1e-3, 5000)])
def test_network_of_each_profile(spark, profile, hidden, activation, alpha, iterations):
    made = classifiers(profile, 4, 100.0, 1.0)["MLP"]
    assert (made.classes, made.hidden, made.activation, made.alpha, made.max_iter) == (4, hidden, activation, alpha, iterations)


def test_booster_settings(spark):
    made = classifiers("g3", 4, 100.0, 1.0)
    xgb, lgb = made["XGBoost"].spec, made["LightGBM"].spec
    assert (xgb.objective, xgb.rounds, xgb.learning_rate, xgb.max_depth, xgb.subsample, xgb.colsample) == ("multiclass", 300, 0.05, 8, 0.8, 0.8)
    assert (lgb.max_leaves, lgb.max_depth, lgb.min_child_rows, lgb.subsample) == (31, None, 20, 1.0)
