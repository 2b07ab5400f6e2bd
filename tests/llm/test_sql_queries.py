"""Queries with SQL: nulls, empty and long texts, ties, repeats, clashing names and empty tables."""

import pytest

from dropflow.llm.registry import llm_oracles, llm_queries

from fixtures import comparable, sql_rows, write_tables

NAMES = sorted(llm_oracles())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("tables")))


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("empty")), empty=True)


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, tables, name):
    df = llm_queries()[name](spark, tables)
    columns, rows = sql_rows(tables, llm_oracles()[name])
    assert sorted(df.columns) == sorted(columns)
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == comparable(columns, rows)


@pytest.mark.parametrize("name", sorted(set(llm_queries()) - {"op2_chat_masks"}))
def test_empty_tables(spark, empty_tables, name):
    assert llm_queries()[name](spark, empty_tables).collect() == []


def test_empty_chat_table_leaves_the_added_conversation(spark, empty_tables):
    rows = llm_queries()["op2_chat_masks"](spark, empty_tables).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in rows] == [(-7, 2, 26)]
