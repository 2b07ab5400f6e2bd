"""Query of ranked lexical search and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import search
from .common import documents


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _terms_sql(table: str, key: str) -> str:
    return (f"SELECT row_number() OVER () AS rid, {key}, regexp_extract_all(translate(text, "
            r"'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws "
            f"FROM {table}")


OP13_SQL = f"""
WITH d AS MATERIALIZED ({_terms_sql('documents', 'doc_id')}),
i AS (SELECT DISTINCT item_id, unnest(ws) AS term FROM ({_terms_sql('benchmark', 'item_id')})),
sized AS (SELECT rid, doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sized),
ms AS (SELECT rid, doc_id, 100 - 90 + ((90 * n * docs) // terms) AS m FROM sized, s),
tfs AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY rid, term),
ws AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), s),
scores AS (SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM i JOIN tfs USING (term) JOIN ws USING (term) JOIN ms USING (rid) GROUP BY item_id, rid, doc_id),
ranks AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank,
  doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= {search.TOP}
"""

QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLE = {"op13_ranked_search": OP13_SQL}
