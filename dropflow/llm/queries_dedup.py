"""Queries of SimHash near-dedup and benchmark decontamination, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, simhash
from .common import documents


def op1_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def _words_sql(table: str, key: str) -> str:
    return (f"SELECT row_number() OVER () AS rid, {key}, regexp_extract_all(translate(COALESCE(text, ''), "
            r"'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws "
            f"FROM {table}")


OP9_SQL = f"""
WITH d AS MATERIALIZED ({_words_sql('documents', 'doc_id')}),
b AS ({_words_sql('benchmark', 'item_id')}),
bw AS MATERIALIZED (SELECT DISTINCT item_id, least(len(ws), {decontaminate.WINDOW}) AS n, ws[i:i + {decontaminate.WINDOW - 1}] AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {decontaminate.WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, ws[i:i + n - 1] AS w FROM (
  SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
m AS MATERIALIZED (SELECT rid, dw.i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w),
h AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS pos FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY encode(id)) AS ids
       FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
  sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)
"""

QUERIES = {"op1_simhash_vptree": op1_simhash_vptree, "op9_decontaminate": op9_decontaminate}
ORACLE = {"op9_decontaminate": OP9_SQL}
