"""Hand-worked goldens for scalar expressions (FIXTURES.md section 4)."""

import math

import pytest
from pyspark.sql import functions as F

from dropflow.functions.categories import clean_category, year_from_name
from dropflow.functions.features import add_features, argmax_label, diversity_index, weighted_band_mean
from dropflow.functions.numeric import col_or_zero, round_half_even, safe_divide, to_numeric
from dropflow.functions.rates import dropout_rate, with_rate

RATE_ROWS = [
    # QT_ING, DESV, TRANS, FALEC, MAT
    ("100", "10", "5", "0", "20"),
    ("30", "15", "5", "0", "0"),
    ("12", "3", "0", "3", "20"),
    ("10", "1", "0", "0", "20"),
    ("11", "20", "0", "0", "20"),
    ("11", "2", "1", "11", "20"),
    ("11", "2", "1", "15", "20"),
    ("abc", "1", "0", "0", "20"),
]
COLS = ["QT_ING", "QT_SIT_DESVINCULADO", "QT_SIT_TRANSFERIDO", "QT_SIT_FALECIDO", "QT_MAT"]


@pytest.fixture()
def rates_df(spark):
    return spark.createDataFrame([(i,) + r for i, r in enumerate(RATE_ROWS)], ["id"] + COLS)


def _rates(df, kind):
    out = with_rate(df, kind).select("id", "TX_EVASAO").orderBy("id").collect()
    return {r["id"]: r["TX_EVASAO"] for r in out}


def test_rate_r1(rates_df):
    got = _rates(rates_df, "R1")
    assert got == {0: 15.0, 1: 66.67, 3: 10.0, 4: 181.82}


def test_rate_r2(rates_df):
    got = _rates(rates_df, "R2")
    assert got[0] == pytest.approx(0.15)
    assert got[1] == pytest.approx(2 / 3)
    assert got[2] == pytest.approx(1 / 3)
    assert got[4] == pytest.approx(20 / 11)
    assert got[5] == 0.0 and got[6] == 0.0
    assert math.copysign(1.0, got[6]) == 1.0  # clipped to +0.0, not -0.0


def test_rate_r4_drops_bad_denominators(rates_df):
    got = _rates(rates_df, "R4")
    # den 0 (row 5), negative (row 6) and non-numeric entrants (row 7 -> 0) drop out
    assert set(got) == {0, 1, 2, 3, 4}
    assert got[1] == pytest.approx(200 / 3)
    assert got[2] == pytest.approx(100 / 3)

def test_rate_r5(spark):
    df = spark.createDataFrame([(1, "20", "3", "1"), (2, "0", "3", "1")], ["id", "QT_MAT", "QT_SIT_DESVINCULADO", "QT_SIT_TRANSFERIDO"])
    got = {r["id"]: r["TX_EVASAO"] for r in with_rate(df, "R5").collect()}
    assert got == {1: pytest.approx(0.2)}


def test_safe_divide_and_missing(spark):
    df = spark.createDataFrame([(6.0, 4.0), (3.0, 0.0), (3.0, None), (None, 5.0), (-3.0, 5.0)], "n double, d double")
    got = [r[0] for r in df.select(safe_divide(F.col("n"), F.col("d"))).collect()]
    assert got == [1.5, 0.0, 0.0, 0.0, 0.0]
    assert df.select(col_or_zero(df, "absent")).first()[0] == 0.0


def test_to_numeric(spark):
    vals = [" 12 ", "1e3", "1d", "1,5", "", "NA", "-2.5", ".5"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(to_numeric("s")).collect()]
    assert got == [12.0, 1000.0, None, None, None, None, -2.5, 0.5]


def test_round_half_even(spark):
    vals = [0.125, 2.675, 2.665, 66.665, 1.005, 12.345]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(round_half_even(F.col("x"), 2)).collect()]
    assert got == [0.12, 2.68, 2.66, 66.67, 1.0, 12.34]


def test_argmax_diversity_age(spark):
    rows = [(0, 0, 0), (5, 5, 1), (0, 3, 3), (1, 2, 9)]
    df = spark.createDataFrame(rows, "QT_VG_TOTAL_DIURNO int, QT_VG_TOTAL_NOTURNO int, QT_VG_TOTAL_EAD int")
    assert [r[0] for r in df.select(argmax_label(df)).collect()] == ["DIURNO", "DIURNO", "NOTURNO", "EAD"]
    d = spark.createDataFrame([(10, 10, 0, 0, 0, 0), (10, 5, 5, 0, 0, 0), (10, 0, 0, 0, 0, 0)],
                              "QT_ING int, QT_ING_BRANCA int, QT_ING_PRETA int, QT_ING_PARDA int, QT_ING_AMARELA int, QT_ING_INDIGENA int")
    assert [r[0] for r in d.select(diversity_index(d)).collect()] == [0.0, 0.5, 1.0]
    a = spark.createDataFrame([(1, 1), (0, 0)], "QT_ING_0_17 int, QT_ING_60_MAIS int")
    assert [r[0] for r in a.select(weighted_band_mean(a)).collect()] == [41.0, 0.0]


def test_add_features_requires_region_and_network(spark):
    df = spark.createDataFrame([(10,)], "QT_ING int")
    with pytest.raises(ValueError):
        add_features(df)
    ok = spark.createDataFrame([(10, 1, 1)], "QT_ING int, CO_REGIAO int, TP_REDE int")
    row = add_features(ok).first()
    assert row["FEAT_REGIAO_NORTE_NORDESTE"] == 1 and row["FEAT_PUBLICA"] == 1
    assert row["FEAT_PCT_ING_RESERVA_SOCIAL"] == 0.0  # denominator missing -> 0


def test_year_and_categories(spark):
    df = spark.createDataFrame([("MICRODADOS_CADASTRO_CURSOS_2022.CSV",), ("curso.csv",)], "f string")
    assert [r[0] for r in df.select(year_from_name(F.col("f"))).collect()] == ["2022", "desconhecido"]
    c = spark.createDataFrame([(' "a" ',), (None,)], "c string")
    assert [r[0] for r in c.select(clean_category("c", strip_quotes=True)).collect()] == ["a", "nan"]
