"""Numeric coercion and guarded arithmetic as JVM-side Column expressions.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Plain decimal / scientific notation with optional sign and surrounding blanks.
# ``try_cast`` alone would also accept Java suffixes such as '1d' or '1f'.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                  T.FloatType, T.DoubleType, T.DecimalType)


def _field_type(df: DataFrame, name: str):
    for f in df.schema.fields:
        if f.name == name:
            return f.dataType
    return None


def is_numeric_type(dtype) -> bool:
    return isinstance(dtype, _NUMERIC_TYPES)


def to_numeric(c: Column | str, dtype=None) -> Column:
    """Coerce to double; anything non-numeric (and NaN) becomes NULL.

    Pass the column's Spark type when known: numeric inputs skip the string
    round-trip, string inputs are guarded by ``NUMERIC_PATTERN``.
    """
    c = F.col(c) if isinstance(c, str) else c
    if dtype is not None and is_numeric_type(dtype):
        d = c.cast("double")
    else:
        s = c.cast("string")
        d = F.when(s.rlike(NUMERIC_PATTERN), F.trim(s).try_cast("double"))
    return F.nanvl(d, F.lit(None).cast("double"))


def num(df: DataFrame, name: str) -> Column:
    """Numeric view of an existing column (NULL where not coercible)."""
    return to_numeric(F.col(name), _field_type(df, name))


def col_or_zero(df: DataFrame, name: str) -> Column:
    """Coerced column with NULL -> 0; a column missing from the schema -> 0."""
    if name not in df.columns:
        return F.lit(0.0)
    return F.coalesce(num(df, name), F.lit(0.0))


def clip_lower(x: Column, lower: float = 0.0) -> Column:
    """``max(x, lower)`` keeping NULL; -0.0 is normalised to 0.0."""
    return F.when(x.isNull(), F.lit(None).cast("double")) \
        .when(x > F.lit(lower), x.cast("double")) \
        .otherwise(F.lit(float(lower)))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """num/den with num NULL->0, den NULL or 0 -> 0, negative result -> 0."""
    q = F.try_divide(F.coalesce(numerator.cast("double"), F.lit(0.0)),
                     denominator.cast("double"))
    return clip_lower(F.coalesce(q, F.lit(0.0)))


def safe_divide_cols(df: DataFrame, num_name: str, den_name: str) -> Column:
    """Share of two named columns; either column missing -> 0."""
    if num_name not in df.columns or den_name not in df.columns:
        return F.lit(0.0)
    return safe_divide(col_or_zero(df, num_name), num(df, den_name))


def round_half_even(x: Column, digits: int) -> Column:
    """NumPy-style rounding: ``rint(x * 10^d) / 10^d`` (ties to even on the scaled value)."""
    scale = float(10 ** digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def drop_uncoercible(df: DataFrame, *names: str) -> DataFrame:
    """Keep rows whose named columns coerce to a number."""
    cond = F.lit(True)
    for n in names:
        cond = cond & num(df, n).isNotNull()
    return df.filter(cond)
