"""Exact-size, reproducible train/test splits.

Rows are ordered by a seeded 64-bit hash of the whole row (or of given key
columns) and the first ``ceil(test_size * n)`` rows of each stratum form the
test set. The hash of the whole row keeps rows apart that share a key (a course
repeats in every year); rows that are equal in every column are interchangeable,
so whichever of them is taken the sides hold the same rows. The position comes
from ``global_rank`` with the hash's top bits as buckets, so neither the whole
table nor a large class ever sits in one task. Unlike ``randomSplit``, the
result does not depend on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import global_rank

HASH_BUCKET_SHIFT = 48  # 64-bit hash -> 16-bit signed bucket, monotone in the hash


def row_hash(df: DataFrame, key_cols=None, seed: int = 42) -> Column:
    """Seeded hash of the key columns, or of every column (in name order)."""
    cols = sorted(df.columns) if key_cols is None else list(key_cols)
    # a NULL leaves a hash as it is, so it gets a token of its own: else a value could move to the next column unseen
    return F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in cols], F.lit(seed))


def split(df: DataFrame, key_cols=None, test_size: float = 0.2, seed: int = 42,
          stratify: str | None = None, out: str = "is_test") -> DataFrame:
    """Add boolean ``out``; exact per-stratum test size ``ceil(test_size * n)``.

    ``key_cols`` must identify a row if given; by default the whole row does.
    """
    key_cols = [key_cols] if isinstance(key_cols, str) else key_cols
    groups = [stratify] if stratify else []
    # two hashes: the second breaks the ties of the first
    h = df.withColumns({"__h": row_hash(df, key_cols, seed), "__h2": row_hash(df, key_cols, seed + 1)})
    # the hash is uniform: its top 16 bits are an order-preserving bucket with
    # 65,536 evenly filled values (no sketch needed), so each window task holds
    # about 1/65,536 of a stratum however large or skewed the strata are
    ranked = global_rank(h, ["__h", "__h2"], groups, out="__r",
                         bucket=F.shiftright(F.col("__h"), HASH_BUCKET_SHIFT))
    sizes = h.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")) if groups else \
        h.agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__k", F.ceil(F.col("__n") * F.lit(float(test_size))))
    # a row per stratum: adaptive execution broadcasts it from its measured size; one row without strata
    j = ranked.join(sizes, groups, "inner") if groups else ranked.crossJoin(F.broadcast(sizes))
    return j.withColumn(out, F.col("__r") < F.col("__k")).drop("__h", "__h2", "__r", "__n", "__k")


def test_count(n: int, test_size: float = 0.2) -> int:
    return int(math.ceil(n * test_size))


def train_test(df: DataFrame, key_cols=None, test_size: float = 0.2, seed: int = 42,
               stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides; callers that read them in separate jobs persist ``split`` first."""
    s = split(df, key_cols, test_size, seed, stratify)
    return s.filter(~F.col("is_test")).drop("is_test"), s.filter(F.col("is_test")).drop("is_test")
