"""Registered model queries.

The labelled table is the whole course view (every course, not only the
name/degree subset, which is too small for the 50-row guard at small scale)
with the engineered features; each query trains one model family and returns
one row of invariants: rows and labels of the test set, finite predictions,
the sum of tree importances, metrics in their range. They prove that training
and scoring cover the right rows, not how good a model is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RATE
from ..functions.features import add_features
from ..functions.rates import with_rate
from ..operators.columns import drop_leakage, drop_prefix, roles_by_prefix
from ..operators.labels import label_binary, label_quartile
from .common import courses
from .evaluate import train_classifiers, train_regressors


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = drop_prefix(courses(spark, sf_dir), "NO_")
    return drop_leakage(add_features(with_rate(c, "R2")))


def _quartile(spark, sf_dir):
    out, _ = label_quartile(model_table(spark, sf_dir))
    return out


def _binary(spark, sf_dir):
    out, _ = label_binary(model_table(spark, sf_dir), "NIVEL_RISCO", op=">", min_volume=10)
    return out


CHECK_SCHEMA = ("modelo string, n_test long, n_labels long, n_finite long, importance_sum double, "
                "metrics_in_range boolean")


def _checked(spark: SparkSession, model: str, counts: dict, importances, in_range: bool) -> DataFrame:
    """One row of facts that hold whatever the model learned, so that SQL can state them."""
    total = None
    if importances is not None and model != "LogisticRegression":  # coefficients have no fixed sum
        total = round(importances.agg(F.sum("Importance")).first()[0], 6)
    row = (model, counts["n_test"], counts["n_labels"], counts["n_finite"], total, in_range)
    return spark.createDataFrame([row], CHECK_SCHEMA)


def _cls(task: str, model: str, profile: str = "g3"):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = _quartile(spark, sf_dir) if task == "quartile" else _binary(spark, sf_dir)
        roles = None if profile == "g3" else roles_by_prefix(data, ("QT_",), exclude=["NIVEL_RISCO"])
        scored = {}
        metrics, imp = train_classifiers(data, "NIVEL_RISCO", "courses", task=task, profile=profile,
                                         only=[model], roles=roles, scored=scored)
        values = [v for k, v in metrics.first().asDict().items() if isinstance(v, float) and k != "train_seconds"]
        return _checked(spark, model, scored[model], imp, all(0.0 <= v <= 1.0 for v in values))
    return q


def _reg(model: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = {}
        metrics, imp = train_regressors(model_table(spark, sf_dir), RATE, "courses", only=[model],
                                        with_mlp=(model == "MLP"), scored=scored)
        m = metrics.first()
        scored[model]["n_labels"] = None  # a regression's label is continuous
        return _checked(spark, model, scored[model], imp, m["R2"] <= 1.0 and 0.0 <= m["MAE"] <= m["RMSE"])
    return q


q_model_rf = _cls("quartile", "RandomForest")
q_model_lr = _cls("quartile", "LogisticRegression")
q_model_mlp = _cls("binary", "MLP")
q_model_gbt = _cls("binary", "LightGBM")
q_model_xgb = _cls("binary", "XGBoost")
q_model_xgb_quartile = _cls("quartile", "XGBoost")
q_model_gbt_quartile = _cls("quartile", "LightGBM")
q_model_rf_default = _cls("binary", "RandomForest", "g1")
q_model_rf_reg = _reg("RandomForest")
q_model_gbt_reg = _reg("LightGBM")
q_model_xgb_reg = _reg("XGBoost")
q_model_mlp_reg = _reg("MLP")
