"""Train-and-evaluate drivers.

Per dataset: encode the label, split (stratified for classification), fit
the preprocessing once on the training part, persist both prepared parts,
then fit each model and evaluate it with the distributed metric operators.
Only metric rows and importance vectors reach the driver.
"""

from __future__ import annotations

import time
from functools import wraps

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import QUARTILE_LABELS, RATE
from ..operators.columns import model_roles
from ..operators.labels import label_code
from ..operators.metrics import (back_transform, classification_metrics, regression_metrics,
                                 roc_auc, roc_auc_ovr, weighted_metrics)
from ..operators.models import classifiers, importance_frame, importances, regressors
from ..operators.prep import Preprocess
from ..operators.split import row_hash, split
from ..operators.stats import class_weights, positive_ratio
from ..session import ensure_checkpoint_dir, wide_tables

METRIC_SCHEMA_BIN = ("Arquivo string, Modelo string, Accuracy double, `F1-score (Alto Risco)` double, "
                     "`ROC-AUC` double, `Precision (Alto Risco)` double, `Recall (Alto Risco)` double, "
                     "train_seconds double")
METRIC_SCHEMA_MULTI = ("Arquivo string, Modelo string, Accuracy double, `F1-score (weighted)` double, "
                       "`ROC-AUC (weighted, ovr)` double, `Precision (weighted)` double, "
                       "`Recall (weighted)` double, train_seconds double")
METRIC_SCHEMA_REG = "arquivo string, modelo string, R2 double, MAE double, RMSE double, train_seconds double, erro string"


def _on_wide_tables(train):
    """Decorator: plan and run the training of a wide table without constraint propagation."""
    @wraps(train)
    def run(df, *args, **kwargs):
        with wide_tables(df.sparkSession):
            return train(df, *args, **kwargs)
    return run


# Settings of the script families: preprocessing, regression target, MLP regressor.
PROFILES = {
    # engineered-feature scripts: QT_/FEAT_ numeric, ids ignored, zero-impute + scale
    "g3": dict(prep=dict(numeric="zero+scale", categorical="ordinal"), log_target=True, strip_quotes=True,
               mlp=dict(hidden=(128, 64), activation="tanh", alpha=1e-3, max_iter=5000)),
    # root scripts: QT_ numeric, everything else ordinal, scale only, the rate as it is
    "g2": dict(prep=dict(numeric="scale", categorical="ordinal"), log_target=False, strip_quotes=False,
               mlp=dict(hidden=(128, 64), activation="relu", alpha=1e-4, max_iter=500)),
    # one-file predictor: median-impute + scale, mode + one-hot
    "g1": dict(prep=dict(numeric="median+scale", categorical="onehot"), log_target=False, strip_quotes=False,
               mlp=dict(hidden=(100,), activation="relu", alpha=1e-4, max_iter=500)),
}


def _prepared(df: DataFrame, target: str, stratify: str | None, roles, prep: dict):
    num, cat = roles if roles is not None else model_roles(df, target)
    num = [c for c in num if c not in (target, "label")]
    cat = [c for c in cat if c not in (target, "label")]
    # the rows and their side are read by several jobs (split sizes, preprocessing
    # statistics, fitting, evaluation): persisted once, so the columns' expressions
    # are not repeated in the row hash and a row is on the same side in all jobs
    df = df.persist()
    flagged = split(df, None, 0.2, 42, stratify=stratify).persist()
    train = flagged.filter(~F.col("is_test")).drop("is_test")
    test = flagged.filter(F.col("is_test")).drop("is_test")
    fitted = Preprocess(num, cat, **prep).fit(train)
    key = row_hash(df).alias("__key")
    tr = fitted.transform(train.withColumn("__key", key)).select("features", "label", "__key")
    te = fitted.transform(test).select("features", "label")
    return tr, te, fitted, (flagged, df)


def _fixed_layout(tr: DataFrame) -> DataFrame:
    """Hash-partition and sort the training rows by their row hash as the last step
    before fitting: bagging and subsampling then see the same rows in the same order
    on every rerun and task retry, whatever joins ran before."""
    parts = int(tr.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tr.repartition(parts, "__key").sortWithinPartitions("__key").drop("__key")


@_on_wide_tables
def train_classifiers(df: DataFrame, target: str, dataset: str = "dataset", task: str = "binary",
                      profile: str = "g3", only=None, roles=None, fitted: dict | None = None,
                      scored: dict | None = None, **prep):
    """Fit the profile's classifiers on one labelled table; returns (metrics_df, importance_df).

    ``prep`` overrides the profile's preprocessing; fitted pipelines (preprocessing and model, which score raw
    rows) go into ``fitted`` by name, and counts of the scored test rows (see :func:`scored_counts`) into ``scored``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)  # boosted trees checkpoint their lineage every 10 rounds
    multi = task == "quartile"
    lab = label_code(F.col(target)) if multi else F.col(target)
    data = df.withColumn("label", lab.cast("double"))
    tr, te, prepared, cached = _prepared(data, target, "label", roles, PROFILES[profile]["prep"] | prep)
    tr = class_weights(tr, "label", "weight")
    ratio = positive_ratio(tr, "label") if not multi else 1.0
    tr = tr.withColumn("__posw", F.when(F.col("label") == 1.0, F.lit(ratio)).otherwise(F.lit(1.0)))
    tr = _fixed_layout(tr).persist()
    te = te.persist()
    tr.count()
    te.count()
    for c in cached:
        c.unpersist()
    n_train_w = float(tr.agg(F.sum("weight")).first()[0])
    models = classifiers(profile, 4 if multi else 2, n_train_w, ratio)
    names = prepared.feature_names(spark)
    rows, imps = [], []
    for name, est in models.items():
        if only and name not in only:
            continue
        t0 = time.time()
        model = est.fit(tr)
        secs = time.time() - t0
        rows.append((dataset, name, *_classified(model, te, multi), secs))
        if fitted is not None:
            fitted[f"classifier_{name}"] = PipelineModel([prepared, model])
        if scored is not None:
            scored[name] = scored_counts(model, te)
        imp = importances(model)
        if imp is not None:
            imps.append(importance_frame(names, imp, dataset, name))
    tr.unpersist()
    te.unpersist()
    metrics = spark.createDataFrame(rows, METRIC_SCHEMA_MULTI if multi else METRIC_SCHEMA_BIN)
    imp_df = None
    for f in imps:
        imp_df = f if imp_df is None else imp_df.unionByName(f)
    return metrics, imp_df


def _classified(model, te: DataFrame, multi: bool) -> tuple:
    """(accuracy, F1, AUC, precision, recall) of a fitted classifier on a prepared test set.

    The model scores the test set once; label, prediction and scores are persisted for both metric jobs.
    """
    pred = model.transform(te)
    score_col = "probability" if "probability" in pred.columns else "rawPrediction"
    if multi:
        p = vector_to_array(score_col)
        slim = pred.select("label", "prediction", *[p[i].alias(f"__p{i}") for i in range(4)]).persist()
        m = weighted_metrics(slim, "label", "prediction").first()
        auc = roc_auc_ovr(slim.withColumn("label", F.col("label").cast("int").cast("string")),
                          "label", {str(i): f"__p{i}" for i in range(4)}).first()[0]
        found = (m["accuracy"], m["f1_weighted"], auc, m["precision_weighted"], m["recall_weighted"])
    else:
        score = vector_to_array("probability")[1] if "probability" in pred.columns else F.col("prediction")
        slim = pred.select("label", "prediction", score.alias("__score")).persist()
        m = classification_metrics(slim, "label", "prediction", 1.0).first()
        auc = roc_auc(slim, "label", "__score", 1.0).first()["roc_auc"]
        found = (m["accuracy"], m["f1"], auc, m["precision"], m["recall"])
    slim.unpersist()
    return found


def scored_counts(model, te: DataFrame) -> dict:
    """What must hold whatever a model learned: test rows, label values among them, finite predictions."""
    x = F.col("prediction")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    r = model.transform(te).select("label", "prediction").agg(
        F.count(F.lit(1)).alias("n_test"), F.countDistinct("label").alias("n_labels"),
        F.sum(finite.cast("long")).alias("n_finite")).first()
    return r.asDict()


def _regressed(model, te: DataFrame, log_target: bool) -> tuple:
    """(R2, MAE, RMSE) of a fitted regressor on a prepared test set, on the original scale."""
    pred = model.transform(te)
    if log_target:
        pred = pred.select(F.expm1("label").alias("__y"), back_transform(F.col("prediction")).alias("__p"))
    else:
        pred = pred.select(F.col("label").alias("__y"), F.col("prediction").alias("__p"))
    m = regression_metrics(pred, "__y", "__p").first()
    return m["R2"], m["MAE"], m["RMSE"]


def evaluate_fitted(models: dict, test: DataFrame, dataset: str = "dataset", task: str = "binary",
                    log_target: bool = False) -> DataFrame:
    """Metrics of already fitted models (name -> model) on a prepared test set (features, label)."""
    rows = []
    for name, model in models.items():
        t0 = time.time()
        found = _regressed(model, test, log_target) if task == "regression" else _classified(model, test, task == "quartile")
        rows.append((dataset, name, *found, time.time() - t0))
    schema = {"regression": METRIC_SCHEMA_REG, "quartile": METRIC_SCHEMA_MULTI}.get(task, METRIC_SCHEMA_BIN)
    return test.sparkSession.createDataFrame([r + ("",) if task == "regression" else r for r in rows], schema)


@_on_wide_tables
def train_regressors(df: DataFrame, target: str = RATE, dataset: str = "dataset", profile: str = "g3",
                     log_target: bool | None = None, only=None, roles=None, with_mlp: bool = True,
                     fitted: dict | None = None, scored: dict | None = None, **prep):
    """Fit the profile's regressors; metrics on the original scale (V7/V8).

    ``log_target`` (fit log1p, report expm1 + clip) is the profile's unless given.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    settings = PROFILES[profile]
    log_target = settings["log_target"] if log_target is None else log_target
    y = F.col(target).cast("double")
    data = df.filter(y.isNotNull()).withColumn("label", F.log1p(y) if log_target else y)
    prep = settings["prep"] | dict(strip_quotes=settings["strip_quotes"]) | prep
    tr, te, prepared, cached = _prepared(data, target, None, roles, prep)
    tr, te = _fixed_layout(tr).persist(), te.persist()
    tr.count()
    te.count()
    for c in cached:
        c.unpersist()
    models = dict(regressors(profile))
    if with_mlp:
        from ..operators.mlp import MLPRegressor
        models["MLP"] = MLPRegressor(**settings["mlp"], seed=42)
    names = prepared.feature_names(spark)
    rows, imps = [], []
    for name, est in models.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            model = est.fit(tr)
            secs = time.time() - t0
            rows.append((dataset, name, *_regressed(model, te, log_target), secs, ""))
            if fitted is not None:
                fitted[f"regressor_{name}"] = PipelineModel([prepared, model])
            if scored is not None:
                scored[name] = scored_counts(model, te)
            imp = importances(model)
            if imp is not None:
                imps.append(importance_frame(names, imp, dataset, name))
        except Exception as e:  # noqa: BLE001 - a failed model yields NaN metrics and its reason, others continue
            nan = float("nan")
            rows.append((dataset, name, nan, nan, nan, time.time() - t0, f"{type(e).__name__}: {e}"))
    tr.unpersist()
    te.unpersist()
    metrics = spark.createDataFrame(rows, METRIC_SCHEMA_REG)
    imp_df = None
    for f in imps:
        imp_df = f if imp_df is None else imp_df.unionByName(f)
    return metrics, imp_df


def top_k(importance_df: DataFrame, k: int = 5, by=("Arquivo", "Modelo")) -> DataFrame:
    """Top-k features per dataset and model (O1/O2)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last("Importance"), "Feature")
    return importance_df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


QUARTILE_CLASSES = QUARTILE_LABELS
