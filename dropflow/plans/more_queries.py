"""Registered queries: box statistics, year unions, root tables, category
encoding, imputation/scaling, splits, evaluation metrics and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ANALYSIS_CODES, ANALYSIS_COUNTS, RATE, ROOT_DROP
from ..functions.categories import clean_category, year_from_name
from ..functions.features import FEATURE_NAMES
from ..functions.numeric import safe_divide
from ..functions.rates import with_rate
from ..operators.columns import drop_prefix, drop_present, keep_present
from ..operators.filters import course_predicate
from ..operators.metrics import (back_transform, classification_metrics, regression_metrics,
                                 roc_auc, roc_auc_ovr, weighted_metrics)
from ..operators.prep import ordinal_encode
from ..operators.split import split
from ..operators.stats import box_stats, column_modes_df, exact_quantiles, unpivot
from ..operators.union import union_by_name, union_years
from ..session import ensure_checkpoint_dir
from ..sources.testdata import table
from .common import TEST_DEGREE, TEST_NAME, courses, rated_courses, round_doubles
from .course_queries import feature_table, quartile_labelled
from .evaluate import top_k


# --- box statistics ----------------------------------------------------------

def q_box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate (R2, all courses) by course categories."""
    c = with_rate(courses(spark, sf_dir), "R2")
    return round_doubles(box_stats(c, RATE, ["TP_GRAU_ACADEMICO", "TP_REDE", "CO_REGIAO"]))


def q_box_stats_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.value by event_type."""
    e = table(spark, sf_dir, "events")
    return round_doubles(box_stats(e, "value", ["event_type"]))


# --- unions over years -------------------------------------------------------

def q_union_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as yearly tables with drifting columns, unioned by name.

    Even years lack ``o_orderpriority``, other years (and rows without a date) lack
    ``o_orderstatus``, as census years gain and lose columns; the union fills NULL. Years with the same
    columns share a frame, so the table is read twice however many years it holds.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice",
                                              "o_orderstatus", "o_orderpriority")
    year = F.year("o_orderdate")
    name = F.concat(F.lit("MICRODADOS_"), F.coalesce(year.cast("string"), F.lit("")), F.lit(".CSV"))
    even = F.coalesce(year % 2 == 0, F.lit(False))
    tagged = o.withColumn("ANO_BASE", year_from_name(name))
    frames = [tagged.filter(even).drop("o_orderdate", "o_orderpriority"),
              tagged.filter(~even).drop("o_orderdate", "o_orderstatus")]
    return round_doubles(union_by_name(frames))


def yearly_course_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature build per census year and the union of all years ("mega" table).

    A census year is the ship year of the lines. Instead of one plan per year
    glued by unions, the year is a grouping key of the same plan: lines are
    aggregated per (year, part), so every year is built by one shuffle.
    """
    from ..sources.testdata import course_view_by
    from .common import TEST_DEGREE as deg, TEST_NAME as nm
    from ..operators.filters import filter_courses
    from ..functions.features import add_features
    from ..operators.columns import drop_leakage
    from .common import course_filter
    base = course_view_by(spark, sf_dir, F.year("l_shipdate").cast("string").alias("ANO_BASE"),
                          part_filter=course_filter)
    base = filter_courses(base, deg, nm, 10)
    base = drop_present(drop_prefix(base, "NO_"), ["NU_ANO_CENSO", "SG_UF", "CO_IES"])
    return drop_leakage(add_features(with_rate(base, "R2")))


def q_mega_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(yearly_course_features(spark, sf_dir).select(
        "ANO_BASE", "CO_CURSO", "QT_ING", RATE, *FEATURE_NAMES))


# --- root filter tables ------------------------------------------------------

def root_full_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full filtered table of the root script: R1 percent rate, drops."""
    from ..sources.testdata import course_view
    from .common import course_filter
    c = course_view(spark, sf_dir, part_filter=course_filter)
    c = c.filter(course_predicate(c, TEST_DEGREE, TEST_NAME))
    rated = with_rate(c, "R1")
    return drop_present(drop_prefix(rated, "NO_"), ROOT_DROP)


def q_root_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(root_full_table(spark, sf_dir))


def q_analysis_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis table: present code columns + counts + rate."""
    full = root_full_table(spark, sf_dir)
    keep = ANALYSIS_CODES + [c for c in ANALYSIS_COUNTS if c not in ANALYSIS_CODES] + [RATE]
    return round_doubles(keep_present(full, keep))


def q_keep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the analysis keep-list not found in the course view."""
    _, missing = keep_present(courses(spark, sf_dir), ANALYSIS_CODES, report=True)
    return spark.createDataFrame([(m,) for m in missing], "missing_column string")


# --- categories ---------------------------------------------------------------

def q_clean_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents.lang / source as clean category strings."""
    d = table(spark, sf_dir, "documents")
    quoted = F.concat(F.lit(' "'), F.col("source"), F.lit('" '))
    return d.select("doc_id",
                    clean_category("lang").alias("lang_cat"),
                    clean_category(quoted, strip_quotes=True).alias("source_cat"),
                    clean_category(F.when(F.col("n_chars") % 7 != 0, F.col("lang")),
                                   null_token="VALOR_AUSENTE").alias("lang_or_missing"))


def q_ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicographic codes of lang and source fitted on documents (M4)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    enc, _ = ordinal_encode(d, ["lang", "source"])
    return enc.select("doc_id", F.col("lang__ord").cast("int").alias("lang_code"),
                      F.col("source__ord").cast("int").alias("source_code"))


def q_ordinal_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit codes on half the documents, apply to all: unseen sources -> -1 (M4)."""
    from ..operators.prep import apply_ordinal
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    fit_part = d.filter(~F.col("source").isin("src1", "src2", "src3"))
    _, model = ordinal_encode(fit_part, ["source"])
    enc = apply_ordinal(d.withColumn("source", clean_category("source")), model, ["source"])
    return enc.select("doc_id", F.col("source__ord").cast("int").alias("source_code"))


def q_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot position and width of documents.lang (M5): hot index = code, width = #values."""
    from ..operators.prep import Preprocess
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    model = Preprocess([], ["lang"], categorical="onehot").fit(d)
    out = model.transform(d)
    arr = F.col("__arr")
    from pyspark.ml.functions import vector_to_array
    out = out.withColumn("__arr", vector_to_array("features"))
    return out.select("doc_id", F.array_position(arr, 1.0).cast("int").alias("hot_position"),
                      F.size(arr).alias("width"))


# --- imputation and scaling ------------------------------------------------------

def _nulled_courses(spark, sf_dir):
    c = courses(spark, sf_dir)
    return c.select("CO_CURSO", "CO_REGIAO", "TP_REDE",
                    F.expr("nullif(QT_ING_PRETA, 0)").alias("QT_ING_PRETA"),
                    F.expr("nullif(QT_ING_60_MAIS, 0)").alias("QT_ING_60_MAIS"),
                    F.col("QT_INSCRITO_TOTAL"), F.col("QT_ING"))


IMPUTE_COLS = ["QT_ING_PRETA", "QT_ING_60_MAIS", "QT_INSCRITO_TOTAL", "QT_ING"]


def q_impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact column medians over non-null values, all columns in one job (A10/M2)."""
    long = unpivot(_nulled_courses(spark, sf_dir), IMPUTE_COLS, value_type="double")
    return round_doubles(exact_quantiles(long, "value", [0.5], ["variable"], names=["median"]))


def q_impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent value per column, ties to the smallest (A10/M5)."""
    c = _nulled_courses(spark, sf_dir).select(
        F.col("CO_REGIAO").cast("string").alias("CO_REGIAO"),
        F.col("TP_REDE").cast("string").alias("TP_REDE"),
        F.lpad(F.col("QT_ING_PRETA").cast("int").cast("string"), 3, "0").alias("QT_ING_PRETA"))
    return column_modes_df(c, ["CO_REGIAO", "TP_REDE", "QT_ING_PRETA"]).withColumnRenamed("n", "count")


def _scaled(c: DataFrame, numeric: str) -> DataFrame:
    """CO_CURSO and the numeric features that the fitted preprocessing gives."""
    from pyspark.ml.functions import vector_to_array
    from ..operators.prep import Preprocess
    out = Preprocess(IMPUTE_COLS, [], numeric=numeric).fit(c).transform(c).withColumn("__z", vector_to_array("features"))
    return round_doubles(out.select("CO_CURSO", *[F.col("__z")[i].alias(f"z_{k}") for i, k in enumerate(IMPUTE_COLS)]))


def q_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median-impute then population-std scaling of count columns by the shipped preprocessing."""
    return _scaled(_nulled_courses(spark, sf_dir), "median+scale")


def q_scale_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaling alone of count columns without missing values (M3)."""
    return _scaled(courses(spark, sf_dir).select("CO_CURSO", *IMPUTE_COLS), "scale")


def q_scale_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-impute then scaling (M1)."""
    return _scaled(_nulled_courses(spark, sf_dir), "zero+scale")


# --- splits ------------------------------------------------------------------

def q_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 80/20 split of all courses; sizes per side (M7)."""
    s = split(courses(spark, sf_dir), ["CO_CURSO"], 0.2, 42)
    return s.groupBy(F.when(F.col("is_test"), "test").otherwise("train").alias("side")) \
        .agg(F.count(F.lit(1)).alias("n"))


def q_stratified_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified split on the quartile class; sizes per class and side (M8)."""
    lab = quartile_labelled(spark, sf_dir)
    s = split(lab, ["CO_CURSO"], 0.2, 42, stratify="NIVEL_RISCO")
    return s.groupBy("NIVEL_RISCO", F.when(F.col("is_test"), "test").otherwise("train").alias("side")) \
        .agg(F.count(F.lit(1)).alias("n"))


def q_split_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified split of lines, whose part key repeats: rows, rows on a side, and exact test size per stratum (M7/M8)."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    s = split(li, None, 0.2, 42, stratify="l_returnflag")
    return s.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("is_test").alias("n_with_side"),
        F.countDistinct("l_orderkey", "l_linenumber").alias("n_lines"),
        F.sum(F.col("is_test").cast("long")).alias("n_test"))


def q_union_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two yearly frames with a keep-list and complete cases, tagged and unioned."""
    o = table(spark, sf_dir, "orders").withColumn(
        "gap", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))
    frames = {"1995": o.filter(F.year("o_orderdate") == 1995), "1996": o.filter(F.year("o_orderdate") == 1996).drop("o_clerk")}
    return round_doubles(union_years(frames, keep=["o_orderkey", "gap", "absent"], complete=True))


# --- evaluation metrics ------------------------------------------------------------

def _scored_documents(spark, sf_dir):
    """documents x labels: quality is the truth, n_chars the score, a length rule the prediction."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "inner")
    return j.withColumn("prediction", (F.col("n_chars") > 2000).cast("int"))


def q_cls_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, precision/recall/F1 of the positive class and ROC-AUC (V2/V3/V5)."""
    s = _scored_documents(spark, sf_dir)
    m = classification_metrics(s, "quality", "prediction")
    auc = roc_auc(s, "quality", "n_chars").select("roc_auc")
    return round_doubles(m.crossJoin(auc))


def q_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie-aware ROC-AUC per language, truth = quality, score = n_chars (V5)."""
    s = _scored_documents(spark, sf_dir)
    return round_doubles(roc_auc(s, "quality", "n_chars", group_cols=["lang"]))


def _quartile_scored(spark, sf_dir):
    """Feature table labelled with the quartile classes (one lineage, no self-join)."""
    from ..operators.labels import label_quartile
    out, _ = label_quartile(feature_table(spark, sf_dir))
    return out


SCORE_BY_CLASS = {"muito baixo risco": "FEAT_PCT_ING_FEM", "baixo risco": "FEAT_PCT_ING_JOVEM",
                  "alto risco": "FEAT_PCT_ING_BRANCA", "muito alto risco": "FEAT_PCT_VG_NOTURNO"}


def q_weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support-weighted P/R/F1 of a rule that predicts the class with the largest score (V4)."""
    s = _quartile_scored(spark, sf_dir)
    names = list(SCORE_BY_CLASS)
    best = None
    for i, cls in enumerate(names):
        v = F.col(SCORE_BY_CLASS[cls])
        cond = F.lit(True)
        for j, other in enumerate(names):
            if j != i:
                o = F.col(SCORE_BY_CLASS[other])
                cond = cond & ((v > o) if j < i else (v >= o))
        best = F.when(cond, cls) if best is None else best.when(cond, cls)
    s = s.withColumn("prediction", best.otherwise(names[0]))
    return round_doubles(weighted_metrics(s, "NIVEL_RISCO", "prediction"))


def q_roc_auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-vs-rest AUC weighted by prevalence (V6)."""
    s = _quartile_scored(spark, sf_dir)
    return round_doubles(roc_auc_ovr(s, "NIVEL_RISCO", SCORE_BY_CLASS))


def _reg_scored(spark, sf_dir):
    """Truth: the R2 rate; prediction: dropouts per entrant (a proxy rule)."""
    return rated_courses(spark, sf_dir, "R2").withColumn(
        "prediction", safe_divide(F.col("QT_SIT_DESVINCULADO"), F.col("QT_ING")))


def q_reg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(regression_metrics(_reg_scored(spark, sf_dir), RATE, "prediction"))


def q_reg_metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions made on the log1p scale, back-transformed with expm1 and clipped."""
    s = _reg_scored(spark, sf_dir)
    s = s.withColumn("pred_log", F.log1p(F.col("prediction")) - F.lit(0.05))
    s = s.withColumn("pred_back", back_transform(F.col("pred_log")))
    return round_doubles(regression_metrics(s, RATE, "pred_back"))


# --- importances and reports -----------------------------------------------------

NUMERIC_FEATURES = [f for f in FEATURE_NAMES if f != "FEAT_DOMINANCIA_MODALIDADE"]


def importance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance-like table per (Arquivo, Modelo): |covariance| of each feature with the rate,
    normalised to sum 1 ('cov'), and mean feature value normalised ('mean')."""
    f = yearly_course_features(spark, sf_dir)
    long = unpivot(f.select("ANO_BASE", RATE, *NUMERIC_FEATURES), NUMERIC_FEATURES,
                   id_cols=["ANO_BASE", RATE], var="Feature", value_type="double")
    stats = long.groupBy("ANO_BASE", "Feature").agg(
        F.abs(F.covar_pop("value", RATE)).alias("cov"), F.avg("value").alias("mean"))
    tall = stats.unpivot(["ANO_BASE", "Feature"], ["cov", "mean"], "Modelo", "raw")
    w = Window.partitionBy("ANO_BASE", "Modelo")
    tot = F.sum("raw").over(w)
    return tall.select(F.col("ANO_BASE").alias("Arquivo"), "Modelo", "Feature",
                       F.when(tot > 0, F.col("raw") / tot).otherwise(F.lit(0.0)).alias("Importance"))


def q_topk_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-5 features per (Arquivo, Modelo) by importance desc, name asc (O1/O2)."""
    imp = round_doubles(importance_table(spark, sf_dir))
    return top_k(imp, 5)


def metric_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression metric table per year (Arquivo) for two proxy models."""
    f = yearly_course_features(spark, sf_dir)
    proxy = f.withColumn("pred_jovem", F.col("FEAT_PCT_ING_JOVEM") * F.lit(0.5)) \
             .withColumn("pred_zero", F.lit(0.0))
    a = regression_metrics(proxy, RATE, "pred_jovem", ["ANO_BASE"]).withColumn("modelo", F.lit("jovem"))
    b = regression_metrics(proxy, RATE, "pred_zero", ["ANO_BASE"]).withColumn("modelo", F.lit("zero"))
    return union_by_name([a, b]).withColumnRenamed("ANO_BASE", "arquivo")


def q_collect_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidated report: tables tagged by path, long form, 4-decimal values."""
    t = metric_tables(spark, sf_dir).withColumn(
        "fonte", F.concat(F.lit("tabelas_analise/metricas_"), F.col("arquivo"), F.lit(".csv")))
    long = t.unpivot(["fonte", "arquivo", "modelo"], ["R2", "MAE", "RMSE"], "metrica", "valor")
    return long.withColumn("valor", F.rint(F.col("valor") * 1e4) / 1e4 + F.lit(0.0))


def q_metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric report job over written metric tables, a folder per year."""
    from ..session import scratch_table
    from ..sources.csv import write_table
    from .jobs import collect_metrics
    t = metric_tables(spark, sf_dir).withColumn("arquivo", F.concat(F.lit("cursos_"), "arquivo"))
    t = scratch_table(t.select("arquivo", "modelo", "R2", "MAE", "RMSE"), "metric-tables",
                      "arquivo string, modelo string, R2 double, MAE double, RMSE double")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    for r in t.select("arquivo").distinct().collect():  # one name per year
        write_table(t.filter(F.col("arquivo") == r[0]), f"{folder}/tabelas/metricas_{r[0]}.csv", fmt="csv", sep=";")
    return collect_metrics(spark, folder).drop("texto")


def q_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibility guard per year of the mega table: rows and classes."""
    from ..operators.filters import eligibility
    f = yearly_course_features(spark, sf_dir)
    return eligibility(f, ["ANO_BASE"], "FEAT_DOMINANCIA_MODALIDADE", min_rows=50)
