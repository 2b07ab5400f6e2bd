"""Queries of the host rules and of mixing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, quality
from .common import documents


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.planned_documents(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_SPACE = r"[\x20\x09-\x0D]"

COUNTS_SQL = rf"""
  SELECT rid, doc_id, source, len(ws)::BIGINT AS n_words,
    COALESCE(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(regexp_extract_all(t, '!'))::BIGINT AS n_marks,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, ws
  FROM (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
          list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
        FROM (SELECT row_number() OVER () AS rid, doc_id, source, COALESCE(text, '') AS t FROM documents))
"""



def _beyond_sql(limits: dict) -> str:
    n = "greatest(n_words, 1)"
    return (f"(n_symbols > {n} * {limits['symbols']}::DOUBLE OR n_marks > {n} * {limits['marks']}::DOUBLE "
            f"OR n_dup_lines > greatest(n_lines, 1) * {limits['dup_lines']}::DOUBLE "
            f"OR word_chars / {n} < {limits['shortest']}::DOUBLE OR word_chars / {n} > {limits['longest']}::DOUBLE)")


OP5_SQL = f"""
WITH counted AS MATERIALIZED ({COUNTS_SQL}),
grams AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
          FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM counted WHERE len(ws) >= 3)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM grams) WHERE n > 1),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + o AS pos FROM dup, range(3) r(o)) GROUP BY rid),
f AS (SELECT c.* EXCLUDE (ws), COALESCE(rep.n, 0)::BIGINT AS n_repeat_words FROM counted c LEFT JOIN rep USING (rid)),
g AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed,
        {_beyond_sql(quality.SOFT)} AS soft, {_beyond_sql(quality.FAR)} AS far
      FROM f),
hosts AS (SELECT source, count(*) FILTER (NOT base_failed) AS n, (count(*) FILTER (soft AND NOT base_failed))::DOUBLE AS k
          FROM g GROUP BY source),
t AS (SELECT count(*) AS hosts, sum(n)::DOUBLE AS n, sum(k) / sum(n) AS m,
        sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) AS v FROM hosts WHERE n > 0),
p AS (SELECT m, CASE WHEN hosts < 2 THEN {quality.PRIOR_MIN} WHEN v > 0
        THEN least(greatest(m * (1 - m) / v - 1, {quality.PRIOR_MIN}), {quality.PRIOR_MAX}) ELSE {quality.PRIOR_MAX} END AS w FROM t),
verdicts AS (SELECT source, COALESCE((k + m * w) / (n + w) > m * {quality.WORSE}, false) AS strict FROM hosts, p)
SELECT g.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT far AND NOT (soft AND strict) AS kept
FROM g JOIN verdicts ON g.source IS NOT DISTINCT FROM verdicts.source
"""

OP10_PLAN_SQL = rf"""
sized AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS key
  FROM documents),
src AS (SELECT source, sum(size)::DOUBLE AS s, count(*) FILTER (size > 0) AS filled FROM sized GROUP BY source),
weighed AS (SELECT source, s, filled, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM src),
filled AS (SELECT *, 3 * s / w AS r, sum(s) OVER () AS total,
             COALESCE(sum(3 * s) OVER (ORDER BY 3 * s / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(w) OVER (ORDER BY 3 * s / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM weighed),
level AS (SELECT arg_min((total - held) / free, r) AS level FROM filled WHERE (total - held) / free <= r),
plan AS (SELECT *, target - whole * source_size AS rest, s / filled AS ordinary
  FROM (SELECT source, s, filled, s::BIGINT AS source_size, least(3 * s, w * level) AS target,
          CASE WHEN s > 0 THEN floor(least(3 * s, w * level) / s) ELSE 0 END AS whole FROM weighed, level)),
keys AS MATERIALIZED (SELECT source, key, sum(size)::BIGINT AS own FROM sized GROUP BY source, key),
walk AS (
  SELECT source, rest, ordinary, source_size AS open_words, []::BIGINT[] AS settled, []::BIGINT[] AS pinned, NULL::BIGINT AS cut FROM plan WHERE rest > 0
  UNION ALL
  SELECT source, CASE WHEN pin THEN rest - own ELSE rest END, ordinary,
    CASE WHEN ends IS NULL THEN open_words - own ELSE open_words END, CASE WHEN ends IS NULL THEN list_append(settled, key) ELSE settled END,
    CASE WHEN pin THEN list_append(pinned, key) ELSE pinned END, CASE WHEN pin AND rest - own <= 0 THEN -1 ELSE ends END
  FROM (SELECT *, ends IS NULL AND inside AND (own <= rest + ordinary OR own - rest <= rest - (open_words - own)) AS pin
    FROM (SELECT *, CASE WHEN upto < rest THEN {mixing.LAST_KEY} WHEN inside AND upto - rest <= ordinary THEN key
            WHEN NOT inside AND rest - (upto - own) <= ordinary THEN key - 1 END AS ends
      FROM (SELECT *, rest - (upto - own) >= own / 2.0 AS inside
        FROM (SELECT w.source, w.rest, w.ordinary, w.open_words, w.settled, w.pinned, k.key, k.own,
                sum(k.own) OVER (PARTITION BY w.source ORDER BY k.key) AS upto,
                row_number() OVER (PARTITION BY w.source ORDER BY k.key DESC) AS from_end
              FROM walk w JOIN keys k ON w.source IS NOT DISTINCT FROM k.source AND NOT list_contains(w.settled, k.key)
              WHERE w.cut IS NULL)
        WHERE (upto >= rest AND upto - own < rest) OR (from_end = 1 AND upto < rest))))),
ended AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY source ORDER BY len(settled) DESC, cut DESC NULLS LAST) = 1),
mixed AS (SELECT d.*, source_size, target, (whole + CASE WHEN list_contains(pinned, key)
    OR (key <= cut AND NOT list_contains(settled, key)) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM sized d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
  LEFT JOIN ended ON d.source IS NOT DISTINCT FROM ended.source)
"""

OP10_SQL = f"""
WITH RECURSIVE {OP10_PLAN_SQL}
SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed
"""

QUERIES = {"op5_host_rules": op5_host_rules, "op10_mix_sources": op10_mix_sources}
ORACLE = {"op5_host_rules": OP5_SQL, "op10_mix_sources": OP10_SQL}
