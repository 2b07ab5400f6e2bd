"""Target labelling: binary risk (median threshold) and quartile risk classes.

Thresholds are whole-table statistics computed by a distributed exact-quantile
job; only the resulting scalars reach the driver and re-enter the plan as
literals, so labelling itself is a narrow projection (no join, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import QUARTILE_LABELS, RATE
from .stats import rate_quartiles, rate_threshold

_OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def binary_label(rate_col, threshold: float, op: str = ">"):
    return F.when(_OPS[op](rate_col, F.lit(float(threshold))), 1).otherwise(0)


def label_binary(df: DataFrame, label: str = "ALTO_RISCO", rate: str = RATE, op: str = ">",
                 min_volume: int | None = 10, positive_only: bool = True,
                 threshold: float | None = None, drop_rate: bool = True):
    """Binary risk label over all rows; returns ``(df, threshold)``.

    ``op='>='`` with ``min_volume=1`` is the root scripts' rule, ``op='>'`` with
    ``min_volume=10`` the engineered-feature scripts' rule, and
    ``min_volume=None, positive_only=False`` the predictor's plain median.
    Rows whose rate is NULL are dropped first.
    """
    if op not in _OPS:
        raise ValueError(f"op must be one of {sorted(_OPS)}")
    base = df.filter(F.col(rate).isNotNull() & ~F.isnan(F.col(rate)))
    if threshold is None:
        threshold = rate_threshold(base, rate, min_volume=min_volume, positive_only=positive_only)
    out = base.withColumn(label, binary_label(F.col(rate), threshold, op))
    if drop_rate:
        out = out.drop(rate)
    return out, threshold


def quartile_class(rate_col, q1: float, q2: float, q3: float):
    """Right-closed bins (-inf,q1], (q1,q2], (q2,q3], (q3,inf)."""
    lo, mid, hi, top = QUARTILE_LABELS
    return (F.when(rate_col <= F.lit(q1), lo)
             .when(rate_col <= F.lit(q2), mid)
             .when(rate_col <= F.lit(q3), hi)
             .otherwise(top))


class DuplicateEdges(ValueError):
    """Quartile cuts are not strictly increasing: the dataset is skipped."""


def label_quartile(df: DataFrame, label: str = "NIVEL_RISCO", rate: str = RATE,
                   volume: str = "QT_ING", min_volume: int = 10, drop_rate: bool = True):
    """Quartile risk class; returns ``(df, (q1, q2, q3))`` (T4).

    Duplicate cut points raise ``DuplicateEdges`` (the reference skips such a
    dataset); an empty threshold population gives cuts (0, 0, 0), which are
    duplicates too.
    """
    base = df.filter(F.col(rate).isNotNull() & ~F.isnan(F.col(rate)))
    q1, q2, q3 = rate_quartiles(base, rate, volume, min_volume)
    if not (q1 < q2 < q3):
        raise DuplicateEdges(f"quartile cuts not increasing: {q1}, {q2}, {q3}")
    out = base.withColumn(label, quartile_class(F.col(rate), q1, q2, q3))
    if drop_rate:
        out = out.drop(rate)
    return out, (q1, q2, q3)


def label_code(label_col):
    """Alphabetical class code of a quartile label (T5): alto 0, baixo 1, muito alto 2, muito baixo 3."""
    expr = None
    for code, name in enumerate(sorted(QUARTILE_LABELS)):
        expr = F.when(label_col == name, code) if expr is None else expr.when(label_col == name, code)
    return expr
