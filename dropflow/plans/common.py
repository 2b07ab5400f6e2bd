"""Shared pieces of the registered queries: the filtered course table and
rounding of floating outputs (both the Spark side and the SQL oracle round
floating results to 6 decimals so equal values hash equally)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rates import with_rate
from ..operators.filters import course_predicate, filter_courses
from ..sources.testdata import course_view

# Course-view equivalents of the study's degree / name filters.
TEST_DEGREE = 2
TEST_NAME = "widget"
DIGITS = 6


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column (half-even on the scaled value)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            scale = float(10 ** digits)
            cols.append((F.rint(F.col(f.name) * scale) / scale).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course_view(spark, sf_dir)


def course_filter(part_df):
    """Degree + name predicate on the course attributes (prunes lines early)."""
    return course_predicate(part_df, TEST_DEGREE, TEST_NAME)


def filtered_courses(spark: SparkSession, sf_dir: str, min_entrants: int = 10) -> DataFrame:
    """Course view after the feature-build filters (degree, name, QT_ING > 10)."""
    view = course_view(spark, sf_dir, part_filter=course_filter)
    return filter_courses(view, TEST_DEGREE, TEST_NAME, min_entrants)


def rated_courses(spark: SparkSession, sf_dir: str, kind: str = "R2") -> DataFrame:
    return with_rate(filtered_courses(spark, sf_dir), kind)
