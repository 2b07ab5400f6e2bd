"""Learners mapped onto Spark ML, and feature-importance extraction.

Settings follow the reference's model dictionaries; where Spark's learner
differs, the closest Spark setting is used and noted:

* random forests (``operators.forest``): the scripts' trees, depth (30 for
  "unlimited") and least rows of a leaf; balanced class weights through the
  weight column; regressors consider all features per split. The classifier of
  'g1' keeps its one-hot vectors as entries (``operators.wide_forest``); its
  regressor is Spark's.
* logistic regression: L2 with ``regParam = 1 / (C * sum(weights))`` and no
  internal standardisation, which is the same objective as the reference's.
* boosted trees ("XGBoost" / "LightGBM" settings): second-order histogram
  boosting (``operators.boosting``), depth-wise to depth 8 or leaf-wise to 31
  leaves, with a softmax over four classes in one model.
* MLP classifier and regressor: the scripts' units, penalty and optimiser
  (``operators.mlp``).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import LGB, XGB, BoostSpec, HistogramBooster
from .forest import ForestSpec, HistogramForest
from .mlp import MLPClassifier

SEED = 42
MAX_TREE_DEPTH = 30


def classifiers(profile: str, n_classes: int, n_train_weight: float,
                pos_weight: float | None = None, features: str = "features",
                label: str = "label", weight: str = "weight") -> dict:
    """Estimators per model name for a reference script profile.

    ``profile``: 'g3' (five families, engineered-feature scripts), 'g2' (root
    scripts: RF/MLP/LR), 'g1' (predictor defaults).
    """
    common = dict(featuresCol=features, labelCol=label)
    named = dict(features=features, label=label)
    multi = n_classes > 2
    network = lambda **settings: MLPClassifier(n_classes, seed=SEED, **settings, **named)

    def forest(weight=None, **settings):
        return HistogramForest(ForestSpec(classes=n_classes, sqrt_features=True, seed=SEED, **settings), weight=weight, **named)

    if profile == "g2":
        return {
            "RandomForest": forest(trees=200, max_depth=MAX_TREE_DEPTH, weight=weight),
            "MLP": network(hidden=(128, 64), activation="relu", alpha=1e-4, max_iter=500),
            "LogisticRegression": LogisticRegression(regParam=1.0 / (1.0 * n_train_weight),
                                                     elasticNetParam=0.0, standardization=False,
                                                     maxIter=200, weightCol=weight, **common),
        }
    if profile == "g1":
        return {
            "LogisticRegression": LogisticRegression(regParam=1.0 / n_train_weight, elasticNetParam=0.0,
                                                     standardization=False, maxIter=1000, **common),
            "RandomForest": forest(trees=100, max_depth=MAX_TREE_DEPTH),
            "MLP": network(hidden=(100,), activation="relu", alpha=1e-4, max_iter=500),
        }
    objective = "multiclass" if multi else "binary"
    # the positive-class weight (negatives / positives) of the binary task is carried by the
    # weight column prepared by the caller (``pos_weight`` on positives)
    xgb = HistogramBooster(BoostSpec(objective, hessian_scale=2.0, seed=SEED, **XGB), n_classes,
                           weight=None if multi else "__posw", **named)
    lgb = HistogramBooster(BoostSpec(objective, hessian_scale=n_classes / (n_classes - 1), seed=SEED, **LGB), n_classes,
                           weight=weight, **named)
    return {
        "RandomForest": forest(trees=200, max_depth=15, min_rows=5, weight=weight),
        "MLP": network(hidden=(128, 64), activation="tanh", alpha=1e-3, max_iter=5000),
        "LogisticRegression": LogisticRegression(regParam=1.0 / (0.1 * n_train_weight), elasticNetParam=0.0,
                                                 standardization=False, maxIter=5000, weightCol=weight,
                                                 family="multinomial" if multi else "binomial", **common),
        "XGBoost": xgb,
        "LightGBM": lgb,
    }


def regressors(profile: str = "g3", features: str = "features", label: str = "label") -> dict:
    def forest(**settings):
        return HistogramForest(ForestSpec(seed=SEED, **settings), features=features, label=label)

    if profile == "g2":
        return {"RandomForest": forest(trees=200, max_depth=MAX_TREE_DEPTH)}
    if profile == "g1":
        return {"RandomForest": RandomForestRegressor(numTrees=100, maxDepth=MAX_TREE_DEPTH, seed=SEED,
                                                      featureSubsetStrategy="all", featuresCol=features, labelCol=label)}
    return {
        "RandomForest": forest(trees=300, max_depth=15, min_rows=5),
        "XGBoost": HistogramBooster(BoostSpec("regression", seed=SEED, **XGB), features=features, label=label),
        "LightGBM": HistogramBooster(BoostSpec("regression", seed=SEED, **LGB), features=features, label=label),
    }


def importances(model):
    """Trees: shares of impurity or gain; linear: |coef| (mean over classes); else None (V9), by feature."""
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficientMatrix"):
        return np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    return getattr(model, "importances", None)


def importance_frame(names: DataFrame, values, dataset: str, model_name: str) -> DataFrame:
    """Named importances, highest first; ``names`` is (place, Feature), one row a feature."""
    # only features that a model uses leave the driver: one-hot features are as many as a table has ids
    found = names.sparkSession.createDataFrame([(i, float(values[i])) for i in np.flatnonzero(values).tolist()],
                                               "place long, Importance double")
    return (names.join(found, "place", "left")
            .select("Feature", F.coalesce("Importance", F.lit(0.0)).alias("Importance"), F.lit(dataset).alias("Arquivo"),
                    F.lit(model_name).alias("Modelo"))
            .orderBy(F.desc("Importance"), "Feature"))
