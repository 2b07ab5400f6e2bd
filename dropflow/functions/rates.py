"""Dropout-rate definitions.

The reference computes five different rates; each kind returns the rate
expression and the row predicate tied to it (``None`` when no filter belongs
to the rate itself).

R1  percent, 100*(DESV+TRANS)/(ING-FALEC); den<=0 -> 0; 2 dp half-even; keep den>=10
R2  ratio, (DESV+TRANS)/(ING-FALEC); den 0 -> 0; negative -> 0 (volume filter upstream)
R3  same as R2 (simple filter, no engineered features)
R4  percent as R1 without rounding; den<=0 or den<min_mat -> NULL (row dropped)
R5  ratio (DESV+TRANS)/MAT; MAT<min_mat -> NULL (row dropped)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DESV, FALEC, ING, MAT, RATE, TRANS
from .numeric import clip_lower, col_or_zero, round_half_even

KINDS = ("R1", "R2", "R3", "R4", "R5")


def dropout_rate(df: DataFrame, kind: str = "R2", min_volume: int = 10,
                 min_mat: int = 1) -> tuple[Column, Column | None]:
    """Return ``(rate, keep_predicate)`` for one rate definition."""
    kind = kind.upper()
    numerator = col_or_zero(df, DESV) + col_or_zero(df, TRANS)
    if kind == "R5":
        mat = col_or_zero(df, MAT)
        rate = F.when((mat != 0) & (mat >= F.lit(min_mat)), numerator / mat)
        return rate, rate.isNotNull()
    den = col_or_zero(df, ING) - col_or_zero(df, FALEC)
    if kind == "R1":
        raw = F.when(den > 0, numerator * F.lit(100.0) / den).otherwise(F.lit(0.0))
        return round_half_even(raw, 2), den >= F.lit(min_volume)
    if kind in ("R2", "R3"):
        rate = clip_lower(F.coalesce(F.try_divide(numerator, den), F.lit(0.0)))
        return rate, None
    if kind == "R4":
        rate = F.when((den > 0) & (den >= F.lit(min_mat)), numerator / den * F.lit(100.0))
        return rate, rate.isNotNull()
    raise ValueError(f"unknown rate kind {kind!r}; expected one of {KINDS}")


def with_rate(df: DataFrame, kind: str = "R2", out: str = RATE, min_volume: int = 10,
              min_mat: int = 1, apply_filter: bool = True) -> DataFrame:
    """Add the rate column and, by default, apply the filter tied to it."""
    rate, keep = dropout_rate(df, kind, min_volume=min_volume, min_mat=min_mat)
    res = df.withColumn(out, rate)
    if apply_filter and keep is not None:
        # the predicate is re-derived from the source columns (not the new one)
        # so Catalyst can push it below the projection
        res = res.filter(keep)
    return res
