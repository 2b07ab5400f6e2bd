"""Set operations: yearly tables into one, tagged result tables into one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import keep_present
from .filters import complete_cases


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Union-all by column name; columns missing from a frame become NULL."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_years(frames: dict[str, DataFrame], year_col: str = "ANO_BASE",
                keep=None, complete: bool = False) -> DataFrame:
    """Tag each yearly frame with its year, optionally project + drop incomplete rows, union."""
    parts = []
    for year, df in frames.items():
        if keep is not None:
            df = keep_present(df, keep)
        if complete:
            df = complete_cases(df)
        parts.append(df.withColumn(year_col, F.lit(str(year))))
    return union_by_name(parts)


def consolidate(tables: dict[str, DataFrame], tag: str = "Arquivo") -> DataFrame:
    """Union result tables (metrics or importances) with a dataset tag."""
    return union_by_name([df.withColumn(tag, F.lit(name)) for name, df in tables.items()])
