"""String-side helpers: category cleaning and year extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token a NULL category becomes when forced to string (as the reference's
# string conversion does) and the sentinel its unrestricted evaluation intends.
NULL_AS_STRING = "nan"
MISSING_TOKEN = "VALOR_AUSENTE"
UNKNOWN_YEAR = "desconhecido"


def clean_category(c: Column | str, strip_quotes: bool = False,
                   null_token: str = NULL_AS_STRING) -> Column:
    """Category as string: optional quote strip + trim, NULL -> ``null_token``."""
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    if strip_quotes:
        s = F.trim(F.regexp_replace(s, '"', ""))
    return F.coalesce(s, F.lit(null_token))


def year_from_name(name: Column) -> Column:
    """All digits of a file name, or ``desconhecido`` when it has none."""
    digits = F.regexp_replace(name, r"[^0-9]", "")
    return F.when(digits == "", F.lit(UNKNOWN_YEAR)).otherwise(digits)
