"""Multilayer perceptrons as data-parallel Spark jobs.

The scripts' networks: tanh or ReLU units, an L2 penalty, Adam on shuffled
mini-batches, a softmax (classifier) or linear (regressor) output, and a stop when
the loss has not improved for ten epochs. Spark ML's classifier has sigmoid units,
no penalty and a full-batch solver, and it has no regressor.

A job runs a few epochs: every task makes the mini-batch steps on its own rows,
starting from the shared parameters and Adam moments, and a tree reduction
averages the tasks' results by their rows. Only parameters move (a few
thousand numbers), the rows stay partitioned. A task holds about ``TASK_CELLS``
numbers of rows; a table that small is one partition and trains as on one
machine. Each epoch then costs a task what its own rows cost, so tasks are kept
small enough that a middling table uses all cores. The order of rows within an epoch follows (seed, epoch, partition), so a
retried task makes the same steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import workers_import
from .saved import SavedState

TASK_CELLS = 400_000
EPOCHS_PER_JOB = 5
BATCH_ROWS = 200
FIRST_DECAY, SECOND_DECAY, TINY = 0.9, 0.999, 1e-8


def _unpack(theta, sizes):
    params, off = [], 0
    for fan_in, fan_out in zip(sizes[:-1], sizes[1:]):
        w = theta[off:off + fan_in * fan_out].reshape(fan_in, fan_out)
        off += fan_in * fan_out
        params.append((w, theta[off:off + fan_out]))
        off += fan_out
    return params


def _outputs(x, params, kind):
    """Activations of every layer; the last one is linear."""
    acts = [x]
    for i, (w, b) in enumerate(params):
        z = acts[-1] @ w + b
        acts.append(z if i == len(params) - 1 else np.tanh(z) if kind == "tanh" else np.maximum(z, 0.0))
    return acts


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def batch_gradient(x, y, theta, sizes, kind, alpha, classes):
    """(gradient, loss) per row of a mini-batch with the penalty; ``classes``: y holds class numbers."""
    params, n = _unpack(theta, sizes), len(x)
    acts = _outputs(x, params, kind)
    if classes:
        p = softmax(acts[-1])
        own = y.astype(np.int64)
        loss = -np.log(np.maximum(p[np.arange(n), own], 1e-300)).sum()
        delta = p
        delta[np.arange(n), own] -= 1.0
    else:
        delta = acts[-1] - y[:, None]
        loss = 0.5 * float((delta ** 2).sum())
    loss += 0.5 * alpha * sum(float((w * w).sum()) for w, _ in params)
    grads = []
    for i in range(len(params) - 1, -1, -1):
        grads.append(np.concatenate([(acts[i].T @ delta + alpha * params[i][0]).ravel(), delta.sum(axis=0)]))
        if i > 0:
            slope = 1.0 - acts[i] ** 2 if kind == "tanh" else acts[i] > 0
            delta = (delta @ params[i][0].T) * slope
    return np.concatenate(grads[::-1]) / n, loss / n


@dataclass
class Adam:
    """Parameters, moments and steps made."""

    theta: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0

    def step(self, grad, rate):
        self.steps += 1
        self.first = FIRST_DECAY * self.first + (1 - FIRST_DECAY) * grad
        self.second = SECOND_DECAY * self.second + (1 - SECOND_DECAY) * grad * grad
        rate = rate * math.sqrt(1 - SECOND_DECAY ** self.steps) / (1 - FIRST_DECAY ** self.steps)
        self.theta = self.theta - rate * self.first / (np.sqrt(self.second) + TINY)


def _epochs(data: DataFrame, start: Adam, epochs: range, net: dict) -> tuple[Adam, np.ndarray]:
    """Some epochs in every task; the averages by rows, and the mean loss of each epoch."""
    shared = data.sparkSession.sparkContext.broadcast(start)

    def run(batches):
        from pyspark import TaskContext
        parts = [(np.asarray(b.column(0).flatten(), np.float64).reshape(b.num_rows, -1), np.asarray(b.column(1), np.float64))
                 for b in batches if b.num_rows]
        if not parts:
            return
        x, y = (np.concatenate(c) for c in zip(*parts))
        state = Adam(**vars(shared.value))
        losses = []
        for epoch in epochs:
            order = np.random.default_rng([net["seed"], epoch, TaskContext.get().partitionId()]).permutation(len(x))
            total = 0.0
            for at in range(0, len(x), BATCH_ROWS):
                rows = order[at:at + BATCH_ROWS]
                grad, loss = batch_gradient(x[rows], y[rows], state.theta, net["sizes"], net["kind"], net["alpha"], net["classes"])
                state.step(grad, net["rate"])
                total += loss * len(rows)
            losses.append(total / len(x))
        found = np.concatenate([state.theta, state.first, state.second, [state.steps], losses])
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary()), pa.array([len(x)], pa.int64())], names=["found", "n"])

    sums = data.mapInArrow(run, "found binary, n long").rdd.map(lambda r: (np.frombuffer(bytes(r["found"])) * r["n"], r["n"]))
    total, n = sums.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
    shared.unpersist()
    mean, k = total / n, len(start.theta)
    return Adam(mean[:k], mean[k:2 * k], mean[2 * k:3 * k], float(mean[3 * k])), mean[3 * k + 1:]


class _MLP(Estimator):
    def __init__(self, classes=0, hidden=(100,), activation="relu", alpha=1e-4, learning_rate=1e-3, max_iter=200, tol=1e-4,
                 n_iter_no_change=10, seed=42, epochs_per_job=EPOCHS_PER_JOB, features="features", label="label"):
        super().__init__()
        self.classes, self.hidden, self.activation, self.alpha = classes, tuple(hidden), activation, alpha
        self.learning_rate, self.max_iter, self.tol = learning_rate, max_iter, tol
        self.n_iter_no_change, self.seed, self.epochs_per_job = n_iter_no_change, seed, epochs_per_job
        self.features, self.label = features, label

    def _fit(self, df: DataFrame) -> "MLPModel":
        workers_import(df.sparkSession)
        data = df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y"))
        head = data.first()
        if head is None:
            raise ValueError("no rows to fit")
        sizes = [len(head["x"]), *self.hidden, self.classes or 1]
        partitions = max(1, min(data.rdd.getNumPartitions(), math.ceil(data.count() * sizes[0] / TASK_CELLS)))
        data = data.coalesce(partitions).persist()
        rng = np.random.default_rng(self.seed)
        parts = []
        for fan_in, fan_out in zip(sizes[:-1], sizes[1:]):
            bound = math.sqrt(6.0 / (fan_in + fan_out))
            parts += [rng.uniform(-bound, bound, fan_in * fan_out), rng.uniform(-bound, bound, fan_out)]
        theta = np.concatenate(parts)
        state = Adam(theta, np.zeros_like(theta), np.zeros_like(theta))
        net = dict(sizes=sizes, kind=self.activation, alpha=self.alpha, classes=self.classes, rate=self.learning_rate, seed=self.seed)
        best, stall, curve = math.inf, 0, []
        while len(curve) < self.max_iter and stall < self.n_iter_no_change:
            state, losses = _epochs(data, state, range(len(curve), min(len(curve) + self.epochs_per_job, self.max_iter)), net)
            for loss in losses.tolist():
                stall = stall + 1 if loss > best - self.tol else 0
                best = min(best, loss)
                curve.append(loss)
        data.unpersist()
        return MLPModel(state.theta, sizes, self.activation, self.classes, self.features, curve)


class MLPRegressor(_MLP):
    """``fit`` on (features vector, label)."""

    def __init__(self, **settings):
        super().__init__(classes=0, **settings)


class MLPClassifier(_MLP):
    """``fit`` on (features vector, class number from 0)."""

    def __init__(self, classes: int = 2, **settings):
        super().__init__(classes=classes, **settings)


class MLPModel(Model, SavedState):
    """``transform`` adds prediction, and for a classifier probability; ``curve`` is the loss of each epoch."""

    def __init__(self, theta=None, sizes=None, kind="relu", classes=0, features="features", curve=None):
        super().__init__()
        self.theta, self.sizes, self.kind, self.classes = theta, sizes, kind, classes
        self.features, self.curve = features, curve or []

    def _transform(self, df: DataFrame) -> DataFrame:
        workers_import(df.sparkSession)
        # a few thousand numbers: they travel with the function, and leave with it
        theta, sizes, kind, classes = self.theta, self.sizes, self.kind, self.classes

        @F.pandas_udf("array<double>")
        def outputs(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            out = _outputs(np.stack(x.to_numpy()), _unpack(theta, sizes), kind)[-1]
            return pd.Series(list(softmax(out) if classes else out))

        out = df.withColumn("__out", outputs(vector_to_array(self.features)))
        o = F.col("__out")
        if not classes:
            return out.withColumn("prediction", o[0]).drop("__out")
        best = (F.array_position(o, F.array_max(o)) - 1).cast("double")
        return out.withColumns({"probability": array_to_vector(o), "prediction": best}).drop("__out")

    def state(self) -> dict:
        return {"theta": self.theta.tolist(), "sizes": [int(x) for x in self.sizes], "kind": self.kind,
                "classes": self.classes, "features": self.features, "curve": self.curve}

    def restore(self, state: dict) -> None:
        self.theta, self.sizes, self.kind = np.array(state["theta"]), state["sizes"], state["kind"]
        self.classes, self.features, self.curve = state["classes"], state["features"], state["curve"]
