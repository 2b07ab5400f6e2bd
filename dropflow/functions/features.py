"""The nineteen engineered course features, as one projection.

All features are Column expressions added with a single ``withColumns`` so the
whole set compiles into one codegen'd projection (no temporary columns).
Missing source columns count as 0 (schema drift between census years).
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AGE_BANDS, MODALITY_SEATS, RACE_GROUPS, RESERVE_NUMERATORS
from .numeric import col_or_zero, num, safe_divide, safe_divide_cols

FEATURE_NAMES = [
    "FEAT_RATIO_CANDIDATO_VAGA", "FEAT_TAXA_OCUPACAO_VAGAS", "FEAT_PCT_ING_FEM",
    "FEAT_IDADE_MEDIA_ING", "FEAT_PCT_ING_JOVEM", "FEAT_PCT_ING_IDOSO",
    "FEAT_PCT_ING_PRETA_PARDA", "FEAT_PCT_ING_BRANCA", "FEAT_INDICE_DIVERSIDADE",
    "FEAT_PCT_ING_DEFICIENTE", "FEAT_PCT_ING_RESERVA_SOCIAL", "FEAT_PCT_ING_FINANC",
    "FEAT_PCT_ING_COM_FIES", "FEAT_PCT_ING_PROUNI", "FEAT_PCT_VG_EAD",
    "FEAT_PCT_VG_NOTURNO", "FEAT_DOMINANCIA_MODALIDADE", "FEAT_REGIAO_NORTE_NORDESTE",
    "FEAT_PUBLICA",
]


def _sum(cols: list[Column]) -> Column:
    return reduce(add, cols)


def share(df: DataFrame, numerators: list[str], denominator: str) -> Column:
    """Share of ``denominator`` taken by the summed numerators (missing -> 0).

    A single present numerator column is divided directly; a sum of columns is
    always formed (missing parts count 0). A missing denominator gives 0.
    """
    if len(numerators) == 1:
        return safe_divide_cols(df, numerators[0], denominator)
    if denominator not in df.columns:
        return F.lit(0.0)
    return safe_divide(_sum([col_or_zero(df, c) for c in numerators]), num(df, denominator))


def weighted_band_mean(df: DataFrame, bands=AGE_BANDS) -> Column:
    """Mean of band representatives weighted by band counts; no counts -> 0."""
    numerator = _sum([F.lit(float(w)) * col_or_zero(df, c) for c, w in bands])
    denominator = _sum([col_or_zero(df, c) for c, _ in bands])
    return safe_divide(numerator, denominator)


def diversity_index(df: DataFrame, groups=RACE_GROUPS, total: str = "QT_ING") -> Column:
    """1 - sum of squared group shares of ``total`` (all-zero shares -> 1.0)."""
    squares = [F.pow(safe_divide_cols(df, g, total), F.lit(2.0)) for g in groups]
    return F.lit(1.0) - _sum(squares)


def argmax_label(df: DataFrame, options=MODALITY_SEATS) -> Column:
    """Label of the largest column; ties go to the earliest option."""
    vals = [(col_or_zero(df, c), lab) for c, lab in options]
    expr = None
    for i, (v, lab) in enumerate(vals):
        others = [o for j, (o, _) in enumerate(vals) if j != i]
        # strictly greater than earlier options, at least equal to later ones
        cond = F.lit(True)
        for j, o in enumerate(others):
            cond = cond & ((v > o) if j < i else (v >= o))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(options[0][1]))


def feature_columns(df: DataFrame) -> dict[str, Column]:
    """The 19 features keyed by name, in the reference's order."""
    return {
        "FEAT_RATIO_CANDIDATO_VAGA": safe_divide_cols(df, "QT_INSCRITO_TOTAL", "QT_VG_TOTAL"),
        "FEAT_TAXA_OCUPACAO_VAGAS": safe_divide_cols(df, "QT_ING", "QT_VG_TOTAL"),
        "FEAT_PCT_ING_FEM": safe_divide_cols(df, "QT_ING_FEM", "QT_ING"),
        "FEAT_IDADE_MEDIA_ING": weighted_band_mean(df),
        "FEAT_PCT_ING_JOVEM": share(df, ["QT_ING_0_17", "QT_ING_18_24"], "QT_ING"),
        "FEAT_PCT_ING_IDOSO": share(df, ["QT_ING_50_59", "QT_ING_60_MAIS"], "QT_ING"),
        "FEAT_PCT_ING_PRETA_PARDA": share(df, ["QT_ING_PRETA", "QT_ING_PARDA"], "QT_ING"),
        "FEAT_PCT_ING_BRANCA": safe_divide_cols(df, "QT_ING_BRANCA", "QT_ING"),
        "FEAT_INDICE_DIVERSIDADE": diversity_index(df),
        "FEAT_PCT_ING_DEFICIENTE": safe_divide_cols(df, "QT_ING_DEFICIENTE", "QT_ING"),
        "FEAT_PCT_ING_RESERVA_SOCIAL": share(df, RESERVE_NUMERATORS, "QT_ING_RESERVA_VAGA"),
        "FEAT_PCT_ING_FINANC": safe_divide_cols(df, "QT_ING_FINANC", "QT_ING"),
        "FEAT_PCT_ING_COM_FIES": safe_divide_cols(df, "QT_ING_FIES", "QT_ING_FINANC"),
        "FEAT_PCT_ING_PROUNI": share(df, ["QT_ING_PROUNII", "QT_ING_PROUNIP"], "QT_ING"),
        "FEAT_PCT_VG_EAD": safe_divide_cols(df, "QT_VG_TOTAL_EAD", "QT_VG_TOTAL"),
        "FEAT_PCT_VG_NOTURNO": safe_divide_cols(df, "QT_VG_TOTAL_NOTURNO", "QT_VG_TOTAL"),
        "FEAT_DOMINANCIA_MODALIDADE": argmax_label(df),
        "FEAT_REGIAO_NORTE_NORDESTE": col_or_zero(df, "CO_REGIAO").isin(1.0, 2.0).cast("int"),
        "FEAT_PUBLICA": (col_or_zero(df, "TP_REDE") == F.lit(1.0)).cast("int"),
    }


def add_features(df: DataFrame, required=("CO_REGIAO", "TP_REDE")) -> DataFrame:
    """Append the 19 features. ``CO_REGIAO``/``TP_REDE`` are required columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns for features: {missing}")
    return df.withColumns(feature_columns(df))
