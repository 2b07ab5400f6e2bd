"""Distributed running sums over a global order.

Exact quantiles, rank-based AUC and exact-size splits all need "how many rows
come before this one" over a sort order. A window with no (or a hot) partition
key runs in a single task, so instead:

1. per group, approximate quantiles of the leading order key give ``B - 1``
   bucket boundaries (a mergeable sketch, so a group holding a third of all
   rows is summarised map-side like any other);
2. each row's bucket is the number of boundaries below its key - a pure
   function of the row, identical in every branch of the plan and on every
   retry after an executor loss;
3. weights summed per (group, bucket) - at most ``B`` rows per group - become
   offsets through a small window;
4. the running sum inside each (group, bucket) - a ``1/B`` slice of the group -
   plus the offset is the global running sum.

Callers pre-aggregate duplicates of ``(group, order)`` into one weighted row
(map-side combine), so hot values never pile up in one bucket either.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BK = "__bk"


def _buckets(df: DataFrame, num_buckets: int | None) -> int:
    """As many slices of an order as the session has shuffle partitions: a group that holds all rows
    then spreads over every task, at any cluster size."""
    return max(2, int(num_buckets or df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _bucket_of(bounds: Column, key: Column, n: int) -> Column:
    """How many of ``n`` sorted bounds lie below ``key``: whole steps first, then inside one step."""
    step = max(1, math.isqrt(n))
    ends = F.filter(F.sequence(F.lit(step), F.lit(max(step, n)), F.lit(step)), lambda i: i <= F.size(bounds))
    whole = F.size(F.filter(ends, lambda i: F.get(bounds, i - 1) < key))
    inside = F.filter(F.slice(bounds, whole * step + 1, F.lit(step)), lambda x: x < key)
    return whole * step + F.size(inside)


def with_buckets(df: DataFrame, key, group_cols=(), num_buckets: int | None = None,
                 weight_col: str | None = None) -> DataFrame:
    """Add ``__bk``: an order-preserving bucket of ``key`` within each group.

    Naming the ``weight_col`` (counts, never negative) keeps this branch's input the
    same as its neighbours', so that adaptive execution computes it once.
    """
    group_cols = list(group_cols)
    b = _buckets(df, num_buckets)
    k = F.col(key).cast("double") if isinstance(key, str) else key.cast("double")
    probs = [i / b for i in range(1, b)]
    seen = df if weight_col is None else df.filter(F.col(weight_col) >= 0)
    bounds = seen.groupBy(*group_cols).agg(
        F.percentile_approx(k, probs, 10 * b).alias("__b"))
    if group_cols:
        # one row per group; adaptive execution broadcasts it from its measured
        # size (no extra counting job), a shuffle join handles many groups
        d = df.join(bounds, group_cols, "inner")
    else:
        # a single row of boundaries
        d = df.crossJoin(F.broadcast(bounds))
    return d.withColumn(_BK, _bucket_of(F.col("__b"), k, b - 1)).drop("__b")


def ordered_cumsum(df: DataFrame, order_cols, weight_col: str, group_cols=(),
                   out: str = "_cum", num_buckets: int | None = None,
                   bucket=None) -> DataFrame:
    """Add ``out`` = inclusive running sum of ``weight_col`` by ``order_cols`` within groups.

    The leading order column must be numeric. Rows must be unique on
    ``group_cols + order_cols`` for a deterministic result. ``bucket`` may
    supply an integer Column that is non-decreasing in the order (e.g. the
    top bits of a uniform hash); otherwise buckets come from per-group
    approximate quantiles.
    """
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    group_cols = list(group_cols)
    if bucket is not None:
        d = df.withColumn(_BK, bucket)
    else:
        d = with_buckets(df, order_cols[0], group_cols, num_buckets, weight_col)
    totals = d.groupBy(*group_cols, _BK).agg(F.sum(weight_col).alias("__pt"))
    before = Window.partitionBy(*group_cols).orderBy(_BK) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group_cols, _BK,
                            F.coalesce(F.sum("__pt").over(before), F.lit(0)).alias("__off"))
    if not group_cols:
        # at most B rows
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(*group_cols, _BK).orderBy(*order_cols) \
        .rowsBetween(Window.unboundedPreceding, 0)
    running = d.withColumn("__c", F.sum(weight_col).over(inside))
    return (running.join(offsets, [*group_cols, _BK], "inner")
                   .withColumn(out, F.col("__c") + F.col("__off"))
                   .drop(_BK, "__c", "__off"))


def global_rank(df: DataFrame, order_cols, group_cols=(), out: str = "_rank",
                num_buckets: int | None = None, bucket=None) -> DataFrame:
    """0-based row position by ``order_cols`` within groups (rows should be unique)."""
    w = df.withColumn("__one", F.lit(1).cast("long"))
    res = ordered_cumsum(w, order_cols, "__one", group_cols, out="__cum", num_buckets=num_buckets,
                         bucket=bucket)
    return res.withColumn(out, F.col("__cum") - F.lit(1)).drop("__one", "__cum")
