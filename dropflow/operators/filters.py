"""Row filters, filter audit and dataset eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CRITICAL_COLUMNS, ING
from ..functions.numeric import num


def complete_cases(df: DataFrame, subset=None) -> DataFrame:
    """Drop rows with a NULL in ``subset`` (present names only) or in any column (F1/F2)."""
    if subset is None:
        return df.dropna(how="any")
    present = [c for c in subset if c in df.columns]
    return df.dropna(how="any", subset=present) if present else df


def course_predicate(df: DataFrame, degree: int = 2, name: str = "LETRAS",
                     name_col: str = "NO_CURSO", degree_col: str = "TP_GRAU_ACADEMICO") -> Column:
    """Degree code equal to ``degree`` (coerced) and case-insensitive name match."""
    deg = num(df, degree_col) == F.lit(float(degree))
    has_name = F.coalesce(F.lower(F.col(name_col).cast("string")).contains(name.lower()),
                          F.lit(False))
    return F.coalesce(deg, F.lit(False)) & has_name


def filter_steps(df: DataFrame, degree: int = 2, name: str = "LETRAS",
                 min_entrants: int | None = 10, critical=CRITICAL_COLUMNS):
    """Named cumulative predicates of the feature-build filter, in order."""
    present = [c for c in (critical or []) if c in df.columns]
    complete = F.lit(True)
    for c in present:
        complete = complete & F.col(c).isNotNull()
    coercible = complete & num(df, ING).isNotNull()
    course = coercible & course_predicate(df, degree, name)
    steps = [("complete", complete), ("coercible", coercible), ("course", course)]
    if min_entrants is not None:
        steps.append(("volume", course & (num(df, ING) > F.lit(float(min_entrants)))))
    return steps


def filter_courses(df: DataFrame, degree: int = 2, name: str = "LETRAS",
                   min_entrants: int | None = 10, critical=CRITICAL_COLUMNS) -> DataFrame:
    """Critical-null drop, coercible entrants, degree + name, entrants > k."""
    return df.filter(filter_steps(df, degree, name, min_entrants, critical)[-1][1])


def filter_audit(df: DataFrame, degree: int = 2, name: str = "LETRAS",
                 min_entrants: int | None = 10, critical=CRITICAL_COLUMNS) -> DataFrame:
    """Rows surviving each filter step, computed in one pass."""
    steps = filter_steps(df, degree, name, min_entrants, critical)
    aggs = [F.count(F.lit(1)).alias("rows_in")]
    aggs += [F.sum(F.when(p, 1).otherwise(0)).cast("long").alias(f"rows_{n}") for n, p in steps]
    return df.agg(*aggs)


def check_eligible(df: DataFrame, label: str | None = None, min_rows: int = 50,
                   min_classes: int = 2) -> tuple[bool, str, int]:
    """Empty / fewer than ``min_rows`` / fewer than two classes -> not eligible."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if label is not None:
        aggs.append(F.countDistinct(label).alias("k"))
    r = df.agg(*aggs).first()
    n = int(r["n"])
    if n == 0:
        return False, "empty", n
    if n < min_rows:
        return False, f"fewer than {min_rows} rows", n
    if label is not None and int(r["k"]) < min_classes:
        return False, f"fewer than {min_classes} classes", n
    return True, "ok", n


def eligibility(df: DataFrame, group_cols, label: str | None = None, min_rows: int = 50,
                min_classes: int = 2) -> DataFrame:
    """``check_eligible`` for every group at once, as one aggregation."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if label is not None:
        aggs.append(F.countDistinct(label).alias("n_classes"))
    agg = df.groupBy(*group_cols).agg(*aggs)
    reason = F.when(F.col("n") == 0, "empty").when(F.col("n") < min_rows, f"fewer than {min_rows} rows")
    if label is not None:
        reason = reason.when(F.col("n_classes") < min_classes, f"fewer than {min_classes} classes")
    reason = reason.otherwise("ok")
    return agg.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "ok")
