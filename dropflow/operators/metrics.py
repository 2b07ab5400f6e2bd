"""Evaluation metrics as distributed aggregates.

Every metric is one aggregation over the prediction table; only the final
numbers (one row per group) reach the driver. ROC-AUC is the tie-aware rank
statistic: scores are reduced to a (score -> positives, negatives) histogram
and the negatives below each score come from ``ordered_cumsum``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ordered_cumsum


def _ratio(a: Column, b: Column) -> Column:
    """a / b with 0 on a zero denominator (zero_division=0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           positive=1, group_cols=()) -> DataFrame:
    """Accuracy and precision/recall/F1 of the positive class in one pass (V2/V3)."""
    y, p = F.col(label), F.col(prediction)
    tp = F.sum(F.when((y == positive) & (p == positive), 1).otherwise(0))
    fp = F.sum(F.when((y != positive) & (p == positive), 1).otherwise(0))
    fn = F.sum(F.when((y == positive) & (p != positive), 1).otherwise(0))
    agg = df.groupBy(*group_cols).agg(
        F.avg(F.when(y == p, 1.0).otherwise(0.0)).alias("accuracy"),
        tp.alias("__tp"), fp.alias("__fp"), fn.alias("__fn"))
    prec = _ratio(F.col("__tp"), F.col("__tp") + F.col("__fp"))
    rec = _ratio(F.col("__tp"), F.col("__tp") + F.col("__fn"))
    f1 = _ratio(F.lit(2) * F.col("__tp"), F.lit(2) * F.col("__tp") + F.col("__fp") + F.col("__fn"))
    return agg.select(*group_cols, "accuracy", prec.alias("precision"), rec.alias("recall"),
                      f1.alias("f1"))


def weighted_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     group_cols=()) -> DataFrame:
    """Accuracy and support-weighted precision/recall/F1 (V4).

    One pass over the predictions builds the (truth, prediction) count table;
    each pair then feeds its truth class (support, hits) and its predicted
    class (predicted count), so per-class totals need a single small
    aggregation and no join.
    """
    g = list(group_cols)
    pairs = df.groupBy(*g, F.col(label).cast("string").alias("__y"),
                       F.col(prediction).cast("string").alias("__p")) \
        .agg(F.count(F.lit(1)).alias("__c"))
    hit = F.when(F.col("__y") == F.col("__p"), F.col("__c")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("__y").alias("cls"), F.col("__c").alias("sup"), F.lit(0).cast("long").alias("pred"),
                 hit.cast("long").alias("tp")),
        F.struct(F.col("__p").alias("cls"), F.lit(0).cast("long").alias("sup"), F.col("__c").alias("pred"),
                 F.lit(0).cast("long").alias("tp")))
    per = pairs.select(*g, F.explode(sides).alias("s")) \
        .groupBy(*g, F.col("s.cls").alias("__cls")) \
        .agg(F.sum("s.sup").alias("__sup"), F.sum("s.pred").alias("__pred"), F.sum("s.tp").alias("__tp"))
    prec = _ratio(F.col("__tp"), F.col("__pred"))
    rec = _ratio(F.col("__tp"), F.col("__sup"))
    f1 = _ratio(F.lit(2) * F.col("__tp"), F.col("__sup") + F.col("__pred"))
    n = F.sum("__sup")
    return per.groupBy(*g).agg(
        (F.sum("__tp") / n).alias("accuracy"),
        (F.sum(prec * F.col("__sup")) / n).alias("precision_weighted"),
        (F.sum(rec * F.col("__sup")) / n).alias("recall_weighted"),
        (F.sum(f1 * F.col("__sup")) / n).alias("f1_weighted"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive=1,
            group_cols=()) -> DataFrame:
    """Tie-aware ROC-AUC per group (V5); NULL when a group has one class only."""
    g = list(group_cols)
    is_pos = (F.col(label) == positive)
    hist = (df.filter(F.col(score).isNotNull())
              .groupBy(*g, F.col(score).cast("double").alias("__s"))
              .agg(F.sum(F.when(is_pos, 1).otherwise(0)).cast("long").alias("__pos"),
                   F.sum(F.when(is_pos, 0).otherwise(1)).cast("long").alias("__neg")))
    cum = ordered_cumsum(hist, "__s", "__neg", g, out="__negcum")
    part = cum.select(*g, (F.col("__pos") * ((F.col("__negcum") - F.col("__neg")).cast("double")
                                            + F.lit(0.5) * F.col("__neg"))).alias("__u"),
                      "__pos", "__neg")
    tot = part.groupBy(*g).agg(F.sum("__u").alias("__U"), F.sum("__pos").alias("__P"),
                              F.sum("__neg").alias("__N"))
    auc = F.when((F.col("__P") > 0) & (F.col("__N") > 0),
                 F.col("__U") / (F.col("__P").cast("double") * F.col("__N")))
    return tot.select(*g, auc.alias("roc_auc"), F.col("__P").alias("n_pos"), F.col("__N").alias("n_neg"))


def roc_auc_ovr(df: DataFrame, label: str, prob_cols: dict, group_cols=()) -> DataFrame:
    """One-vs-rest ROC-AUC averaged with class prevalence weights (V6).

    ``prob_cols`` maps each class value to its score column; the per-class
    (is_class, score) pairs are produced by one explode over a single scan.
    """
    g = list(group_cols)
    y = F.col(label).cast("string")
    pairs = F.array(*[F.struct(F.lit(str(cls)).alias("cls"),
                               (y == F.lit(str(cls))).cast("int").alias("y"),
                               F.col(col).cast("double").alias("score"))
                      for cls, col in prob_cols.items()])
    stacked = df.select(*g, F.explode(pairs).alias("__s")).select(
        *g, F.col("__s.cls").alias("__cls"), F.col("__s.y").alias("__y"), F.col("__s.score").alias("__score"))
    per = roc_auc(stacked, "__y", "__score", 1, [*g, "__cls"])
    return per.groupBy(*g).agg(
        (F.sum(F.col("roc_auc") * F.col("n_pos")) / F.sum("n_pos")).alias("roc_auc_ovr_weighted"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       group_cols=()) -> DataFrame:
    """R2, MAE, RMSE in one pass (V7)."""
    y = F.col(label).cast("double")
    e = y - F.col(prediction).cast("double")
    agg = df.groupBy(*group_cols).agg(
        F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"),
        F.sum(e * e).alias("__sse"), (F.var_pop(y) * F.count(y)).alias("__sst"))
    r2 = F.when(F.col("__sst") > 0, F.lit(1.0) - F.col("__sse") / F.col("__sst")) \
        .when(F.col("__sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return agg.select(*group_cols, r2.alias("R2"), "MAE", "RMSE")


def back_transform(pred: Column) -> Column:
    """expm1 of a log1p-scale prediction, clipped at 0."""
    x = F.expm1(pred)
    return F.when(x > 0, x).otherwise(F.lit(0.0))
