"""Projection operators (column roles, keep/drop lists, schema guards).

All of these only rewrite the projection; Catalyst prunes unused columns down
to the scan, so a narrow keep-list also narrows the Parquet/CSV read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KNOWN_CATEGORICAL, LEAKAGE_DROP, MODEL_IGNORE
from ..functions.numeric import is_numeric_type


def drop_prefix(df: DataFrame, prefix: str = "NO_") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def drop_present(df: DataFrame, cols) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return df.drop(*present) if present else df


def drop_leakage(df: DataFrame, cols=LEAKAGE_DROP) -> DataFrame:
    """Drop the rate's source counts once the rate exists."""
    return drop_present(df, cols)


def keep_present(df: DataFrame, keep, report: bool = False):
    """Select the ordered keep-list intersected with the schema.

    With ``report=True`` also return the names not found (P4b).
    """
    present = [c for c in keep if c in df.columns]
    out = df.select(*present)
    if report:
        return out, [c for c in keep if c not in df.columns]
    return out


def keep_except(df: DataFrame, exclude) -> DataFrame:
    ex = set(exclude)
    return df.select(*[c for c in df.columns if c not in ex])


def roles_by_type(df: DataFrame, exclude=()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) by Spark type."""
    ex = set(exclude)
    numeric, categorical = [], []
    for f in df.schema.fields:
        if f.name in ex:
            continue
        (numeric if is_numeric_type(f.dataType) else categorical).append(f.name)
    return numeric, categorical


def roles_by_prefix(df: DataFrame, numeric_prefixes=("QT_",), ignore=(), known_categorical=(),
                    exclude=()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) by name prefix (P6b/P6c); order follows the schema."""
    ig = set(ignore) | set(exclude)
    kc = set(known_categorical)
    numeric, categorical = [], []
    for c in df.columns:
        if c in ig:
            continue
        if c.startswith(tuple(numeric_prefixes)) and c not in kc:
            numeric.append(c)
        else:
            categorical.append(c)
    return numeric, categorical


def model_roles(df: DataFrame, target: str) -> tuple[list[str], list[str]]:
    """Roles used by the engineered-feature model scripts (QT_/FEAT_ numeric)."""
    return roles_by_prefix(df, ("QT_", "FEAT_"), ignore=MODEL_IGNORE,
                           known_categorical=KNOWN_CATEGORICAL, exclude=[target])


def reindex_columns(df: DataFrame, columns, dtype: str = "double") -> DataFrame:
    """Fixed column layout; missing names become typed NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(dtype).alias(c)
                       for c in columns])


def require_columns(df: DataFrame, cols) -> None:
    """Raise if any required column is absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def roles_table(spark, numeric, categorical) -> DataFrame:
    """Column-role table (name, role)."""
    rows = [(c, "numeric") for c in numeric] + [(c, "categorical") for c in categorical]
    return spark.createDataFrame(rows, "name string, role string")
