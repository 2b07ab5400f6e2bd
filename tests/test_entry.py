"""Driver contract: entry smoke, registry consistency, oracle agreement on a sample."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from dropflow.sources.testdata import TABLES

from paths import SF001

FAST = ["q_filter_courses", "q_rate_r1", "q_features", "q_quartiles", "q_label_quartile",
        "q_box_stats_events", "q_union_years", "q_ordinal_unseen", "q_roc_auc", "q_topk_importance"]


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["NIVEL_RISCO", "n"]
    assert df.count() >= 0


def test_every_sql_entry_has_a_query():
    qs, oracle = queries(), oracle_sql()
    assert set(oracle) <= set(qs)
    rows_only = {n for n in set(qs) - set(oracle) if n.startswith("q_")}
    assert not rows_only  # every query of the census engine has SQL


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    def norm(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(tuple(repr(norm(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_oracle_agreement_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    sdf = queries()[name](spark, SF001)
    res = con.execute(oracle_sql()[name])
    o_cols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(o_cols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(o_cols, res.fetchall())
