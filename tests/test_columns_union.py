"""Projection operators and year unions."""

import pytest
from pyspark.sql import functions as F

from dropflow.operators.columns import (drop_leakage, drop_prefix, keep_except, keep_present,
                                        model_roles, reindex_columns, require_columns,
                                        roles_by_prefix, roles_by_type)
from dropflow.operators.union import consolidate, union_years


@pytest.fixture()
def wide(spark):
    return spark.createDataFrame(
        [(1, "x", 10.0, 5, 2, "LETRAS", 0.5)],
        "CO_CURSO int, NO_UF string, QT_ING double, QT_SIT_DESVINCULADO int, TP_REDE int, NO_CURSO string, FEAT_A double")


def test_drops_keeps_and_roles(wide):
    assert drop_prefix(wide, "NO_").columns == ["CO_CURSO", "QT_ING", "QT_SIT_DESVINCULADO", "TP_REDE", "FEAT_A"]
    assert "QT_SIT_DESVINCULADO" not in drop_leakage(wide).columns
    kept, missing = keep_present(wide, ["TP_REDE", "IN_CAPITAL", "QT_ING"], report=True)
    assert kept.columns == ["TP_REDE", "QT_ING"] and missing == ["IN_CAPITAL"]
    assert keep_except(wide, ["NO_UF", "NO_CURSO", "ABSENT"]).columns == \
        ["CO_CURSO", "QT_ING", "QT_SIT_DESVINCULADO", "TP_REDE", "FEAT_A"]
    num, cat = roles_by_type(wide)
    assert num == ["CO_CURSO", "QT_ING", "QT_SIT_DESVINCULADO", "TP_REDE", "FEAT_A"]
    assert cat == ["NO_UF", "NO_CURSO"]
    num, cat = roles_by_prefix(wide, ("QT_",))
    assert num == ["QT_ING", "QT_SIT_DESVINCULADO"] and "FEAT_A" in cat
    num, cat = model_roles(wide, target="QT_SIT_DESVINCULADO")
    assert num == ["QT_ING", "FEAT_A"] and "CO_CURSO" not in cat


def test_reindex_and_required(wide):
    out = reindex_columns(wide, ["QT_ING", "R2", "CO_CURSO"])
    assert out.columns == ["QT_ING", "R2", "CO_CURSO"] and out.first()["R2"] is None
    require_columns(wide, ["QT_ING"])
    with pytest.raises(ValueError):
        require_columns(wide, ["QT_ING", "CO_REGIAO"])


def test_union_years_keep_complete_and_consolidate(spark):
    a = spark.createDataFrame([(1, 2.0, "x"), (2, None, "y")], "k int, QT_ING double, extra string")
    b = spark.createDataFrame([(3, 4.0)], "k int, QT_ING double")
    u = union_years({"2022": a, "2023": b})
    assert u.count() == 3 and u.filter(F.col("extra").isNull()).count() == 1
    assert sorted(r["ANO_BASE"] for r in u.collect()) == ["2022", "2022", "2023"]
    v = union_years({"2022": a, "2023": b}, keep=["k", "QT_ING"], complete=True)
    assert v.columns == ["k", "QT_ING", "ANO_BASE"] and v.count() == 2
    c = consolidate({"m1": b, "m2": b})
    assert sorted(r["Arquivo"] for r in c.collect()) == ["m1", "m2"]
