"""Networks: gradients, the same steps as a plain loop, jobs, held-out accuracy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from dropflow.operators import mlp
from dropflow.operators.mlp import Adam, MLPClassifier, MLPRegressor, batch_gradient


def table(spark, x, y, parts=1):
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y)]
    return (spark.createDataFrame(rows, "x array<double>, label double").coalesce(1).repartition(parts)
            .select(array_to_vector("x").alias("features"), "label"))


@pytest.mark.parametrize("kind, classes", [("tanh", 0), ("relu", 0), ("tanh", 3), ("relu", 3)])
def test_gradients_are_slopes_of_the_loss(kind, classes):
    rng = np.random.default_rng(1)
    sizes = [4, 5, 3, classes or 1]
    theta = rng.normal(size=sum(a * b + b for a, b in zip(sizes[:-1], sizes[1:])))
    x, y = rng.normal(size=(7, 4)), rng.integers(0, 3, 7).astype(float)
    grad, _ = batch_gradient(x, y, theta, sizes, kind, 0.1, classes)
    for i in range(0, len(theta), 5):
        near = [batch_gradient(x, y, theta + d, sizes, kind, 0.1, classes)[1] for d in (np.eye(len(theta))[i] * e for e in (1e-6, -1e-6))]
        assert grad[i] == pytest.approx((near[0] - near[1]) / 2e-6, abs=1e-5)


def test_one_partition_makes_the_steps_of_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(450, 3)), rng.normal(size=450)
    data = table(spark, x, y).persist()
    seen = data.collect()
    x, y = np.array([r["features"].toArray() for r in seen]), np.array([r["label"] for r in seen])
    model = MLPRegressor(hidden=(4,), activation="tanh", alpha=0.01, max_iter=7, epochs_per_job=3).fit(data)
    start = MLPRegressor(hidden=(4,), activation="tanh", alpha=0.01, max_iter=0).fit(data)
    state = Adam(start.theta, np.zeros_like(start.theta), np.zeros_like(start.theta))
    for epoch in range(7):
        order = np.random.default_rng([42, epoch, 0]).permutation(450)
        for at in range(0, 450, mlp.BATCH_ROWS):
            rows = order[at:at + mlp.BATCH_ROWS]
            state.step(batch_gradient(x[rows], y[rows], state.theta, model.sizes, "tanh", 0.01, 0)[0], 1e-3)
    assert model.theta == pytest.approx(state.theta, abs=1e-9) and len(model.curve) == 7


def test_fewer_jobs_than_epochs_and_averages_learn(spark, monkeypatch):
    jobs = []
    run = mlp._epochs
    monkeypatch.setattr(mlp, "_epochs", lambda *a: jobs.append(1) or run(*a))
    monkeypatch.setattr(mlp, "TASK_CELLS", 100)  # rows stay in four partitions
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 2))
    y = (x[:, 0] > 0) * 1.0 + (x[:, 1] > 0) * 2.0
    model = MLPClassifier(4, hidden=(16,), activation="tanh", alpha=1e-3, learning_rate=0.01, max_iter=60).fit(
        table(spark, x[:1500], y[:1500], parts=4))
    assert len(model.curve) >= 10 and len(jobs) * 4 <= len(model.curve) + 4
    assert model.curve[-1] < model.curve[0] / 3
    held = model.transform(table(spark, x[1500:], y[1500:]))
    assert held.filter(F.col("prediction") == F.col("label")).count() >= 475


def test_a_middling_table_trains_in_several_tasks(spark, monkeypatch):
    """An epoch's time is that of its largest task, so 600,000 numbers are not left to one."""
    parts = []
    run = mlp._epochs
    monkeypatch.setattr(mlp, "_epochs", lambda data, *a: parts.append(data.rdd.getNumPartitions()) or run(data, *a))
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 100))
    MLPRegressor(hidden=(2,), max_iter=1).fit(table(spark, x, x[:, 0], parts=4))
    assert parts == [2]
