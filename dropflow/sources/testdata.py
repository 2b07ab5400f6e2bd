"""Readers for the driver's Parquet tables and the course-like view over them.

The census files themselves are not available, so the oracle-checked queries
run on a course view derived from ``lineitem`` and ``part``: one row per part
(course), with counts built from line attributes.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _flag(cond) -> "F.Column":
    return F.sum(F.when(cond, 1).otherwise(0))


def course_view(spark: SparkSession, sf_dir: str, part_filter=None) -> DataFrame:
    return course_view_by(spark, sf_dir, part_filter=part_filter)


def course_view_by(spark: SparkSession, sf_dir: str, by=None, part_filter=None) -> DataFrame:
    """Course-like view: lineitem aggregated per part (and optional key ``by``,
    e.g. a census year derived from the ship date), then joined to part.

    The aggregation is placed below the join (eager aggregation): lineitem is
    reduced to one partial row per part and map task before any shuffle, and
    the join then sees one row per part on each side, so a part holding a large
    share of lines never produces a hot join key.

    ``part_filter(part_df) -> Column`` restricts courses by their own
    attributes (name, degree). The qualifying keys also prune lineitem
    *before* the aggregation through a semi-join, which adaptive execution
    turns into a broadcast when the measured key set is small.
    """
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey"),
        F.col("p_partkey").alias("CO_CURSO"),
        F.col("p_name").alias("NO_CURSO"),
        (F.lit(1) + F.col("p_size") % 3).alias("TP_GRAU_ACADEMICO"),
        (F.lit(1) + F.col("p_partkey") % 5).alias("CO_REGIAO"),
        (F.lit(1) + F.col("p_size") % 2).alias("TP_REDE"),
    )
    if part_filter is not None:
        cond = part_filter(part)
        part = part.filter(cond)
        keys = part.select(F.col("p_partkey").alias("l_partkey"))
        # no hint and no counting job: adaptive execution broadcasts the keys if their measured size is small
        li = li.join(keys, "l_partkey", "left_semi")
    q = F.col("l_quantity")
    keys = [F.col("l_partkey").alias("p_partkey")] + ([by] if by is not None else [])
    per_part = li.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("QT_ING"),
        _flag(F.col("l_returnflag") == "R").alias("QT_SIT_DESVINCULADO"),
        _flag((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("QT_SIT_TRANSFERIDO"),
        _flag(F.col("l_discount") >= 0.1).alias("QT_SIT_FALECIDO"),
        _flag(F.col("l_linestatus") == "O").alias("QT_MAT"),
        _flag(F.col("l_linenumber") % 2 == 1).alias("QT_ING_FEM"),
        _flag(q <= 6).alias("QT_ING_0_17"),
        _flag((q > 6) & (q <= 30)).alias("QT_ING_18_24"),
        _flag((q > 30) & (q <= 36)).alias("QT_ING_25_29"),
        _flag((q > 36) & (q <= 40)).alias("QT_ING_30_34"),
        _flag((q > 40) & (q <= 43)).alias("QT_ING_35_39"),
        _flag((q > 43) & (q <= 46)).alias("QT_ING_40_49"),
        _flag((q > 46) & (q <= 48)).alias("QT_ING_50_59"),
        _flag(q > 48).alias("QT_ING_60_MAIS"),
        _flag(F.col("l_suppkey") % 6 == 0).alias("QT_ING_BRANCA"),
        _flag(F.col("l_suppkey") % 6 == 1).alias("QT_ING_PRETA"),
        _flag(F.col("l_suppkey") % 6 == 2).alias("QT_ING_PARDA"),
        _flag(F.col("l_suppkey") % 6 == 3).alias("QT_ING_AMARELA"),
        _flag(F.col("l_suppkey") % 6 == 4).alias("QT_ING_INDIGENA"),
        _flag(F.col("l_suppkey") % 3 == 0).alias("QT_VG_TOTAL_DIURNO"),
        _flag(F.col("l_suppkey") % 3 == 1).alias("QT_VG_TOTAL_NOTURNO"),
        _flag(F.col("l_suppkey") % 3 == 2).alias("QT_VG_TOTAL_EAD"),
        _flag(F.col("l_tax") >= 0.01).alias("QT_VG_TOTAL"),
        F.sum(q).alias("QT_INSCRITO_TOTAL"),
    )
    cols = ["CO_CURSO", "NO_CURSO", "TP_GRAU_ACADEMICO", "CO_REGIAO", "TP_REDE"] + \
        [c for c in per_part.columns if c != "p_partkey"]
    return part.join(per_part, "p_partkey", "inner").select(*cols)


# The same view as SQL text (Spark SQL and DuckDB both accept it); the oracle
# side of the driver contract inlines it as a CTE.
def course_view_sql(by_expr: str | None = None, by_alias: str | None = None) -> str:
    """Course view SQL, optionally grouped by an extra key (e.g. ship year)."""
    sql = COURSE_VIEW_SQL
    if by_expr is None:
        return sql
    sql = sql.replace("SELECT p_partkey AS CO_CURSO,", f"SELECT p_partkey AS CO_CURSO, {by_expr} AS {by_alias},", 1)
    return sql.replace("GROUP BY p_partkey, p_name, p_size", f"GROUP BY p_partkey, p_name, p_size, {by_expr}")


COURSE_VIEW_SQL = """
SELECT p_partkey AS CO_CURSO, p_name AS NO_CURSO, 1 + p_size % 3 AS TP_GRAU_ACADEMICO,
  1 + p_partkey % 5 AS CO_REGIAO, 1 + p_size % 2 AS TP_REDE,
  count(*) AS QT_ING,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS QT_SIT_DESVINCULADO,
  CAST(sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS QT_SIT_TRANSFERIDO,
  CAST(sum(CASE WHEN l_discount >= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS QT_SIT_FALECIDO,
  CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS QT_MAT,
  CAST(sum(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS QT_ING_FEM,
  CAST(sum(CASE WHEN l_quantity <= 6 THEN 1 ELSE 0 END) AS BIGINT) AS QT_ING_0_17,
  CAST(sum(CASE WHEN l_quantity > 6 AND l_quantity <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS QT_ING_18_24,
  CAST(sum(CASE WHEN l_quantity > 30 AND l_quantity <= 36 THEN 1 ELSE 0 END) AS BIGINT) AS QT_ING_25_29,
  CAST(sum(CASE WHEN l_quantity > 36 AND l_quantity <= 40 THEN 1 ELSE 0 END) AS BIGINT) AS QT_ING_30_34,
  CAST(sum(CASE WHEN l_quantity > 40 AND l_quantity <= 43 THEN 1 ELSE 0 END) AS BIGINT) AS QT_ING_35_39,
  CAST(sum(CASE WHEN l_quantity > 43 AND l_quantity <= 46 THEN 1 ELSE 0 END) AS BIGINT) AS QT_ING_40_49,
  CAST(sum(CASE WHEN l_quantity > 46 AND l_quantity <= 48 THEN 1 ELSE 0 END) AS BIGINT) AS QT_ING_50_59,
  CAST(sum(CASE WHEN l_quantity > 48 THEN 1 ELSE 0 END) AS BIGINT) AS QT_ING_60_MAIS,
  CAST(sum(CASE WHEN l_suppkey % 6 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS QT_ING_BRANCA,
  CAST(sum(CASE WHEN l_suppkey % 6 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS QT_ING_PRETA,
  CAST(sum(CASE WHEN l_suppkey % 6 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS QT_ING_PARDA,
  CAST(sum(CASE WHEN l_suppkey % 6 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS QT_ING_AMARELA,
  CAST(sum(CASE WHEN l_suppkey % 6 = 4 THEN 1 ELSE 0 END) AS BIGINT) AS QT_ING_INDIGENA,
  CAST(sum(CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS QT_VG_TOTAL_DIURNO,
  CAST(sum(CASE WHEN l_suppkey % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS QT_VG_TOTAL_NOTURNO,
  CAST(sum(CASE WHEN l_suppkey % 3 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS QT_VG_TOTAL_EAD,
  CAST(sum(CASE WHEN l_tax >= 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS QT_VG_TOTAL,
  sum(l_quantity) AS QT_INSCRITO_TOTAL
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_partkey, p_name, p_size
"""
