"""Registered queries over the course view: filters, rates, features, labels.

Each ``q_*`` takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the SQL oracle in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RATE, RESERVE_NUMERATORS
from ..functions.features import FEATURE_NAMES, add_features
from ..functions.numeric import to_numeric
from ..functions.rates import dropout_rate, with_rate
from ..operators.columns import drop_leakage, drop_prefix, drop_present
from ..operators.filters import complete_cases, course_predicate, filter_audit, filter_steps
from ..operators.labels import label_binary, label_code, label_quartile
from ..operators.stats import class_counts, class_weights, exact_quantiles, positive_ratio
from ..sources.testdata import table
from .common import (TEST_DEGREE, TEST_NAME, courses, filtered_courses, rated_courses,
                     round_doubles)


def q_filter_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered_courses(spark, sf_dir)


def q_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(courses(spark, sf_dir), TEST_DEGREE, TEST_NAME, 10)


def _root_courses(spark, sf_dir):
    """Root-script filter: degree and name only (the volume rule belongs to R1)."""
    from ..sources.testdata import course_view
    from .common import course_filter
    c = course_view(spark, sf_dir, part_filter=course_filter)
    return c.filter(course_predicate(c, TEST_DEGREE, TEST_NAME))


def _rate_query(kind: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        if kind in ("R2", "R3"):
            base = filtered_courses(spark, sf_dir)
        else:
            base = _root_courses(spark, sf_dir)
        return round_doubles(with_rate(base, kind).select("CO_CURSO", RATE))
    q.__name__ = f"q_rate_{kind.lower()}"
    return q


q_rate_r1 = _rate_query("R1")
q_rate_r2 = _rate_query("R2")
q_rate_r3 = _rate_query("R3")
q_rate_r4 = _rate_query("R4")
q_rate_r5 = _rate_query("R5")


def q_to_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coercion of text built from part attributes."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    texts = {
        "plain": size,
        "padded": F.concat(F.lit(" "), size, F.lit(" ")),
        "suffixed": F.concat(size, F.lit("d")),
        "scientific": F.concat(size, F.lit("e1")),
        "decimal_comma": F.concat(size, F.lit(",5")),
        "word": F.col("p_name"),
    }
    cols = [F.col("p_partkey")]
    for name, t in texts.items():
        cols.append(to_numeric(t).alias(f"n_{name}"))
    cols.append(F.coalesce(to_numeric(texts["suffixed"]), F.lit(0.0)).alias("n_suffixed_filled"))
    return round_doubles(p.select(*cols))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature build on the course view: filter, drop names/ids, rate, features, leakage drop."""
    base = filtered_courses(spark, sf_dir)
    base = drop_present(drop_prefix(base, "NO_"), ["NU_ANO_CENSO", "SG_UF", "CO_IES"])
    rated = with_rate(base, "R2")
    return drop_leakage(add_features(rated))


def q_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(feature_table(spark, sf_dir).select("CO_CURSO", RATE, *FEATURE_NAMES))


def q_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry A output columns (course codes, counts, rate, 19 features)."""
    return round_doubles(feature_table(spark, sf_dir))


def q_simple_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple filter variant: the feature build without engineered features."""
    from ..plans.jobs import build_course_features
    from ..config import StudyConfig
    view = courses(spark, sf_dir)
    cfg = StudyConfig(degree_code=TEST_DEGREE, course_name=TEST_NAME, min_volume=10)
    return round_doubles(build_course_features(view, cfg, simple=True))


def q_share_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share features summed per region: sums of per-course shares."""
    f = feature_table(spark, sf_dir)
    return round_doubles(f.groupBy("CO_REGIAO").agg(
        F.count(F.lit(1)).alias("n_courses"),
        F.sum("FEAT_PCT_ING_JOVEM").alias("sum_pct_jovem"),
        F.sum("FEAT_PCT_ING_PRETA_PARDA").alias("sum_pct_preta_parda"),
        F.sum("FEAT_INDICE_DIVERSIDADE").alias("sum_diversidade"),
        F.avg("FEAT_IDADE_MEDIA_ING").alias("avg_idade_media")))


# Counts of the view that stand in for the social columns it lacks.
SOCIAL_STANDINS = {"QT_ING_DEFICIENTE": "QT_ING_0_17", "QT_ING_RESERVA_VAGA": "QT_ING_FEM",
                   "QT_ING_FINANC": "QT_ING_18_24", "QT_ING_FIES": "QT_ING_BRANCA",
                   "QT_ING_PROUNII": "QT_ING_PRETA", "QT_ING_PROUNIP": "QT_ING_PARDA"}
SOCIAL_FEATURES = ["FEAT_PCT_ING_DEFICIENTE", "FEAT_PCT_ING_RESERVA_SOCIAL", "FEAT_PCT_ING_FINANC",
                   "FEAT_PCT_ING_COM_FIES", "FEAT_PCT_ING_PROUNI"]


def q_social_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five social shares on non-zero counts (each reserve column is one of the view's age bands)."""
    bands = ["QT_ING_0_17", "QT_ING_25_29", "QT_ING_30_34", "QT_ING_35_39", "QT_ING_40_49"]
    reserve = {c: bands[i % len(bands)] for i, c in enumerate(RESERVE_NUMERATORS)}
    c = courses(spark, sf_dir)
    c = c.withColumns({new: F.col(old) for new, old in (SOCIAL_STANDINS | reserve).items()})
    return round_doubles(add_features(c).select("CO_CURSO", *SOCIAL_FEATURES))


# --- thresholds and labels -------------------------------------------------

def q_threshold_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median thresholds of the three binary rules in one job (A1/A2/F8).

    One pass over the courses: each gives a (rule, rate) pair for every rule whose
    threshold population it belongs to, and the pairs go through one grouped
    exact-quantile job; a rule with no qualifying row gets 0.0.
    """
    c = _root_courses(spark, sf_dir)
    (r2, _), (r1, dense), (r4, valid) = (dropout_rate(c, kind) for kind in ("R2", "R1", "R4"))
    volume = F.col("QT_ING")
    built = filter_steps(c, TEST_DEGREE, TEST_NAME, 10)[-1][1]  # rows of the feature build
    rules = {"gt": (r2, built & (r2 > 0) & (volume >= 10)), "ge": (r1, dense & (r1 > 0) & (volume >= 1)),
             "all": (r4, valid)}
    pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.when(belongs, rate).alias(RATE))
                      for rule, (rate, belongs) in rules.items()])
    med = exact_quantiles(c.select(F.explode(pairs).alias("p")).select("p.*"), RATE, [0.5], ["rule"], names=["median"])
    pick = lambda r: F.coalesce(F.max(F.when(F.col("rule") == r, F.col("median"))), F.lit(0.0))
    return round_doubles(med.agg(pick("gt").alias("threshold_gt"), pick("ge").alias("threshold_ge"),
                                 pick("all").alias("threshold_all")))


def q_label_binary_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = label_binary(rated_courses(spark, sf_dir, "R2"), "NIVEL_RISCO", op=">", min_volume=10)
    return out.select("CO_CURSO", "NIVEL_RISCO")


def q_label_binary_ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = with_rate(_root_courses(spark, sf_dir), "R1")
    out, _ = label_binary(rated, "ALTO_RISCO", op=">=", min_volume=1)
    return out.select("CO_CURSO", "ALTO_RISCO")


def q_label_binary_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = with_rate(_root_courses(spark, sf_dir), "R4")
    out, _ = label_binary(rated, "ALTO_RISCO", op=">", min_volume=None, positive_only=False)
    return out.select("CO_CURSO", "ALTO_RISCO")


def q_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles of the rate over rate > 0 and QT_ING >= 10, one row."""
    r = rated_courses(spark, sf_dir, "R2")
    q = exact_quantiles(r, RATE, [0.25, 0.5, 0.75],
                        where=(F.col(RATE) > 0) & (F.col("QT_ING") >= 10), names=["q1", "q2", "q3"])
    return round_doubles(q)


def quartile_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = label_quartile(rated_courses(spark, sf_dir, "R2"))
    return out


def q_label_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quartile_labelled(spark, sf_dir)
    return out.select("CO_CURSO", "NIVEL_RISCO", label_code(F.col("NIVEL_RISCO")).alias("label_code"))


def q_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_counts(quartile_labelled(spark, sf_dir), "NIVEL_RISCO")


def q_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced weight per course and the negative/positive ratio of the binary label."""
    lab, _ = label_binary(rated_courses(spark, sf_dir, "R2"), "NIVEL_RISCO", op=">", min_volume=10)
    ratio = positive_ratio(lab, "NIVEL_RISCO")
    w = class_weights(lab.select("CO_CURSO", "NIVEL_RISCO"), "NIVEL_RISCO")
    return round_doubles(w.withColumn("pos_ratio", F.lit(float(ratio))))


def q_complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses kept after dropping rows with any NULL (zeros made NULL first)."""
    c = courses(spark, sf_dir)
    c = c.withColumn("QT_ING_PRETA", F.expr("nullif(QT_ING_PRETA, 0)")) \
         .withColumn("QT_ING_60_MAIS", F.expr("nullif(QT_ING_60_MAIS, 0)"))
    full = complete_cases(c)
    subset = complete_cases(c, ["QT_ING_PRETA", "QT_ING_0_17", "QT_NOT_PRESENT"])
    return full.select("CO_CURSO", F.lit("all").alias("rule")).unionByName(
        subset.select("CO_CURSO", F.lit("subset").alias("rule")))
