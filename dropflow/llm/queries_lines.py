"""Queries of line dedup and licence scans, with their SQL (brute force over words, no hashes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licenses, lines
from .common import documents


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.summary(documents(spark, sf_dir))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


OP6_SQL = rf"""
WITH keyed AS (SELECT doc_id, text, COALESCE(('0x' || substr(md5(text), 1, 15))::BIGINT, 0) AS k FROM documents),
l AS MATERIALIZED (SELECT doc_id, k, line_no, ws FROM (
    SELECT doc_id, k, i - 1 AS line_no, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS ws
    FROM (SELECT doc_id, k, ls, unnest(range(1, len(ls) + 1)) AS i
          FROM (SELECT doc_id, k, string_split(COALESCE(text, ''), chr(10)) AS ls FROM keyed))) WHERE len(ws) > 0),
p AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY doc_id NULLS LAST, k, line_no) AS place FROM l),
d AS MATERIALIZED (SELECT ws, min(place) AS place FROM p GROUP BY ws),
v AS MATERIALIZED (SELECT place, g, list_concat(ws[1:g], ws[g + 2:]) AS rest
      FROM (SELECT *, unnest(range(0, len(ws))) AS g FROM d WHERE len(ws) >= {lines.MIN_WORDS})),
near AS (
  SELECT place FROM (SELECT place, min(place) OVER (PARTITION BY rest, g) AS m FROM v) WHERE m < place
  UNION SELECT v.place FROM v JOIN d ON v.rest = d.ws WHERE d.place < v.place AND len(d.ws) >= {lines.MIN_WORDS}
  UNION SELECT d.place FROM v JOIN d ON v.rest = d.ws WHERE v.place < d.place AND len(d.ws) >= {lines.MIN_WORDS}),
j AS (SELECT DISTINCT p.doc_id, p.k, p.line_no, CASE WHEN p.place > d.place THEN 'exact' WHEN near.place IS NOT NULL THEN 'near' END AS kind
      FROM p JOIN d USING (ws) LEFT JOIN near ON near.place = d.place),
s AS (SELECT doc_id, k, count(*) FILTER (kind = 'exact')::BIGINT AS n_exact, count(*) FILTER (kind = 'near')::BIGINT AS n_near,
        list(line_no::INT ORDER BY line_no) AS dropped FROM j WHERE kind IS NOT NULL GROUP BY doc_id, k)
SELECT keyed.doc_id,
  len(list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
  COALESCE(n_exact, 0)::BIGINT AS n_exact, COALESCE(n_near, 0)::BIGINT AS n_near, COALESCE(dropped, []::INT[]) AS dropped
FROM keyed LEFT JOIN s ON keyed.doc_id IS NOT DISTINCT FROM s.doc_id AND keyed.k = s.k
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = r"regexp_extract_all(lower(COALESCE(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_VALUES = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licenses.TEMPLATES)

OP8_SQL = rf"""
WITH t AS (SELECT template, ws, len(ws) - 4 AS size FROM (SELECT template, {_WORDS} AS ws FROM (VALUES {_VALUES}) x(template, text))),
ts AS (SELECT DISTINCT template, size, ws[i:i + 4] AS s FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM t)),
n AS (SELECT template, count(*) AS distinct_size FROM ts GROUP BY template),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
ds AS (SELECT rid, doc_id, i - 1 AS pos, ws[i:i + 4] AS s FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
m AS MATERIALIZED (SELECT rid, doc_id, pos, s, template, size FROM ds JOIN ts USING (s)),
w AS (SELECT rid, doc_id, template, pos // size - o AS stretch, s, pos FROM m, range(2) r(o) WHERE pos // size - o >= 0),
c AS (SELECT rid, doc_id, template, stretch, count(DISTINCT s) AS k, min(pos) AS f, max(pos) AS l FROM w GROUP BY ALL),
f AS (SELECT c.*, k / distinct_size AS containment FROM c JOIN n USING (template) WHERE k / distinct_size >= {licenses.CONTAINMENT}),
b AS (SELECT *, row_number() OVER (PARTITION BY rid, template ORDER BY containment DESC, f, l) AS nth FROM f)
SELECT doc_id, template, containment, f::BIGINT AS first_word, (l + 4)::BIGINT AS last_word FROM b WHERE nth = 1
"""

QUERIES = {"op6_line_dedup": op6_line_dedup, "op8_licence_scan": op8_licence_scan}
ORACLE = {"op6_line_dedup": OP6_SQL, "op8_licence_scan": OP8_SQL}
