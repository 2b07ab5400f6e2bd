"""Category vocabularies as distributed tables (M4, M5).

The distinct values of all columns are range-partitioned and sorted by (column,
value); a value's code is its place in its slice plus the sizes of the slices
before it. Neither the values nor their codes pass through the driver, which
sees one count per column. Encoding joins a column's values back: broadcast while
their count is at most ``BROADCAST_VALUES``, as a plain join (which adaptive
execution splits where values are skewed) beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_table
from .stats import unpivot

BROADCAST_VALUES = 100_000
UNKNOWN_CODE = -1.0

TABLE = "value string, code long, variable string"


class Vocabulary:
    """``table`` (variable, value, code) and the number of values of each column."""

    def __init__(self, table: DataFrame, sizes: dict[str, int]) -> None:
        self.table, self.sizes = table, sizes

    @classmethod
    def fit(cls, df: DataFrame, columns) -> "Vocabulary":
        """Codes of the string columns' values in code point order; nulls are no value."""
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        values = unpivot(df.select(*columns), columns).filter(F.col("value").isNotNull()).distinct()
        slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # a checkpoint fixes the slices, which come from sampled bounds
        placed = (values.repartitionByRange(slices, "variable", "value").withColumn("slice", F.spark_partition_id())
                  .checkpoint())
        sizes = placed.groupBy("variable", "slice").agg(F.count("*").alias("n"))
        before = Window.partitionBy("variable").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("variable", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        inside = Window.partitionBy("variable", "slice").orderBy("value")
        coded = placed.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["variable", "slice"])
        table = scratch_table(coded.select("value", (F.col("place") + F.col("offset")).alias("code"), "variable"),
                              "vocabulary", TABLE, partition_by="variable")
        found = dict(sizes.groupBy("variable").agg(F.sum("n")).collect())
        return cls(table, {c: found.get(c, 0) for c in columns})

    def encode(self, df: DataFrame, columns, suffix: str, unknown: float | None = UNKNOWN_CODE) -> DataFrame:
        """Add ``column + suffix``: the code as a double; other values get ``unknown`` (None: the number of values)."""
        for c in columns:
            own = self.table.filter(F.col("variable") == c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
            if self.sizes[c] <= BROADCAST_VALUES:
                own = F.broadcast(own)
            other = float(self.sizes[c]) if unknown is None else unknown
            df = (df.join(own, df[c] == F.col("__value"), "left")
                  .withColumn(c + suffix, F.coalesce(F.col("__code").cast("double"), F.lit(other))).drop("__value", "__code"))
        return df
