"""Aggregations: exact quantiles, thresholds, class counts/weights, box stats,
scaler and imputer statistics.

Exact (linearly interpolated) quantiles are computed without gathering a group
into one task: values are first reduced to a (value, count) histogram with a
map-side combine, then positioned with ``ordered_cumsum`` and only the rows
holding the two neighbouring order statistics are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import num
from .ordered import ordered_cumsum

def _pname(p: float) -> str:
    return "q" + ("%g" % (p * 100)).replace(".", "_")


def exact_quantiles(df: DataFrame, value: str | Column, probs, group_cols=(),
                    where: Column | None = None, names=None) -> DataFrame:
    """Exact quantiles (linear interpolation, like NumPy/pandas default).

    Returns one row per group with one double column per probability; groups
    with no non-null value are absent. NaN counts as missing.
    """
    return histogram_quantiles(histogram(df, value, group_cols, where), probs, group_cols, names)


def histogram(df: DataFrame, value: str | Column, group_cols=(), where: Column | None = None) -> DataFrame:
    """Rows per group and value (``__v``, ``__w``); NULL and NaN are left out. Everything about the order
    of a group's values can be read from it, so one shuffle serves several statistics."""
    v = F.col(value) if isinstance(value, str) else value
    src = df if where is None else df.filter(where)
    src = src.select(*group_cols, F.nanvl(v.cast("double"), F.lit(None).cast("double")).alias("__v"))
    return (src.filter(F.col("__v").isNotNull())
               .groupBy(*group_cols, "__v").agg(F.count(F.lit(1)).alias("__w")))


def histogram_quantiles(hist: DataFrame, probs, group_cols=(), names=None) -> DataFrame:
    """Exact quantiles of the groups of a :func:`histogram`."""
    group_cols = list(group_cols)
    names = list(names) if names else [_pname(p) for p in probs]
    cum = ordered_cumsum(hist, "__v", "__w", group_cols, out="__hi")
    totals = hist.groupBy(*group_cols).agg(F.sum("__w").alias("__n"))
    if not group_cols:
        totals = F.broadcast(totals)
    # rows cover positions [__hi - __w, __hi - 1]
    j = cum.join(totals, group_cols, "inner") if group_cols else cum.crossJoin(totals)
    j = j.withColumn("__lo", F.col("__hi") - F.col("__w"))
    covers = []
    aggs = []
    for p, name in zip(probs, names):
        h = (F.col("__n") - F.lit(1)).cast("double") * F.lit(float(p))
        k_lo = F.floor(h)
        k_hi = F.least(k_lo + F.lit(1), F.col("__n") - F.lit(1))
        has_lo = (F.col("__lo") <= k_lo) & (k_lo < F.col("__hi"))
        has_hi = (F.col("__lo") <= k_hi) & (k_hi < F.col("__hi"))
        covers += [has_lo, has_hi]
        aggs += [F.max(F.when(has_lo, F.col("__v"))).alias(f"__lo_{name}"),
                 F.max(F.when(has_hi, F.col("__v"))).alias(f"__hi_{name}"),
                 F.max(h - k_lo).alias(f"__f_{name}")]
    needed = covers[0]
    for c in covers[1:]:
        needed = needed | c
    picked = j.filter(needed).groupBy(*group_cols).agg(*aggs)
    outs = []
    for name in names:
        lo, hi, fr = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), F.col(f"__f_{name}")
        outs.append((lo + (hi - lo) * fr).alias(name))
    return picked.select(*group_cols, *outs)


def quantile_values(df: DataFrame, value, probs, where: Column | None = None,
                    default: float = 0.0) -> list[float]:
    """Whole-table exact quantiles as Python floats (one tiny row reaches the driver)."""
    rows = exact_quantiles(df, value, probs, where=where, names=[f"p{i}" for i in range(len(probs))]).collect()
    if not rows or any(x is None for x in rows[0]):
        return [default] * len(probs)
    return [float(x) for x in rows[0]]


def rate_threshold(df: DataFrame, rate: str = "TX_EVASAO", volume: str = "QT_ING",
                   min_volume: int | None = 10, positive_only: bool = True,
                   prob: float = 0.5) -> float:
    """Median of the rate over rows with rate > 0 and volume >= k (A1/A2/F8).

    ``min_volume=None, positive_only=False`` gives the plain median of all
    non-null rates. No qualifying row -> 0.0.
    """
    cond = F.lit(True)
    if positive_only:
        cond = cond & (F.col(rate) > 0)
    if min_volume is not None:
        cond = cond & (F.coalesce(num(df, volume), F.lit(0.0)) >= F.lit(float(min_volume)))
    return quantile_values(df, rate, [prob], where=cond)[0]


def rate_quartiles(df: DataFrame, rate: str = "TX_EVASAO", volume: str = "QT_ING",
                   min_volume: int = 10) -> tuple[float, float, float]:
    """(Q1, Q2, Q3) of the rate over rate > 0 and volume >= k (A3); none -> zeros."""
    cond = (F.col(rate) > 0) & (F.coalesce(num(df, volume), F.lit(0.0)) >= F.lit(float(min_volume)))
    q = quantile_values(df, rate, [0.25, 0.5, 0.75], where=cond)
    return q[0], q[1], q[2]


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class (A4)."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (k * n_c) attached to every row.

    The classes (a handful: the label's values) are counted once; the weights then enter as literals,
    so the table itself is neither joined nor shuffled by its few labels.
    """
    rows = class_counts(df, label).collect()
    total = sum(r["n"] for r in rows)
    weight = F.lit(None).cast("double")
    for r in rows:
        same = F.col(label).isNull() if r[label] is None else F.col(label) == F.lit(r[label])
        weight = F.when(same, F.lit(total / (len(rows) * r["n"]))).otherwise(weight)
    return df.withColumn(out, weight)


def positive_ratio(df: DataFrame, label: str) -> float:
    """count(label == 0) / count(label == 1) (A7); no positives -> 1.0."""
    r = df.agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg"),
               F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos")).first()
    return float(r["neg"]) / float(r["pos"]) if r["pos"] else 1.0


def unpivot(df: DataFrame, columns, id_cols=(), var: str = "variable", value: str = "value",
            value_type: str = "string") -> DataFrame:
    """Long form of ``columns`` (one row per input row and column)."""
    return df.unpivot(list(id_cols), [F.col(c).cast(value_type).alias(c) for c in columns], var, value)


def box_stats(df: DataFrame, value: str, categories, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Box-plot statistics of ``value`` for each category value of each column.

    Output: variable, category, n, q1, median, q3, iqr, lower_fence, upper_fence,
    whisker_low, whisker_high, n_outliers.
    """
    cats = [c for c in categories if c in df.columns]
    group = ["variable", "category"]
    long = (df.select(F.col(value).cast("double").alias("__val"), *cats)
              .unpivot(["__val"], [F.col(c).cast("string").alias(c) for c in cats], *group))
    # fences, whiskers and outliers all come from one (variable, category, value) histogram
    hist = histogram(long, "__val", group)
    q = histogram_quantiles(hist, list(probs), group, names=["q1", "median", "q3"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
         .withColumn("lower_fence", F.col("q1") - F.lit(1.5) * F.col("iqr")) \
         .withColumn("upper_fence", F.col("q3") + F.lit(1.5) * F.col("iqr"))
    # one row per (variable, category): adaptive execution broadcasts it when its measured size is small
    j = hist.join(q.withColumnsRenamed({c: f"__{c}" for c in group}),
                  (F.col("variable") == F.col("__variable")) & F.col("category").eqNullSafe(F.col("__category")))
    inside = (F.col("__v") >= F.col("lower_fence")) & (F.col("__v") <= F.col("upper_fence"))
    fixed = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"]
    return j.groupBy(*group).agg(
        F.sum("__w").alias("n"), *[F.first(c).alias(c) for c in fixed],
        F.min(F.when(inside, F.col("__v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__v"))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0).cast("long")).otherwise(F.col("__w"))).alias("n_outliers")).select(
        *group, "n", *fixed, "whisker_low", "whisker_high", "n_outliers")


def fit_scaler(df: DataFrame, columns) -> dict[str, tuple[float, float]]:
    """Mean and population std per column in one pass (A9); std 0 -> 1."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m{i}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}")]
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        m = r[f"m{i}"]
        s = r[f"s{i}"]
        out[c] = (0.0 if m is None else float(m), 1.0 if (s is None or s == 0.0) else float(s))
    return out


def column_medians(df: DataFrame, columns) -> dict[str, float | None]:
    """Exact median of each column (A10), one distributed job for all columns."""
    if not columns:
        return {}
    long = unpivot(df.select(*columns), columns, value_type="double")
    rows = exact_quantiles(long, "value", [0.5], ["variable"], names=["median"]).collect()
    got = {r["variable"]: r["median"] for r in rows}
    return {c: got.get(c) for c in columns}


def column_modes(df: DataFrame, columns) -> dict[str, str | None]:
    """Most frequent value per column, ties to the smallest (A10), all columns at once."""
    if not columns:
        return {}
    long = unpivot(df.select(*columns), columns).filter(F.col("value").isNotNull())
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("variable").agg(F.max("n").alias("n"))
    rows = counts.join(best, ["variable", "n"]).groupBy("variable") \
        .agg(F.min("value").alias("mode")).collect()
    got = {r["variable"]: r["mode"] for r in rows}
    return {c: got.get(c) for c in columns}


def column_modes_df(df: DataFrame, columns) -> DataFrame:
    """As ``column_modes`` but as a DataFrame (variable, mode, n)."""
    long = unpivot(df.select(*columns), columns).filter(F.col("value").isNotNull())
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("variable").agg(F.max("n").alias("n"))
    return counts.join(best, ["variable", "n"]).groupBy("variable", "n") \
        .agg(F.min("value").alias("mode"))
