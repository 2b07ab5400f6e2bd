"""One part owns a third of all lines: the course view and the exact
quantiles stay correct (checked against pandas) with the hot key present."""

import os

import numpy as np
import pandas as pd
import pytest

from dropflow.operators.stats import exact_quantiles
from dropflow.sources.testdata import course_view


@pytest.fixture(scope="module")
def skewed_dir():
    import tempfile
    d = tempfile.mkdtemp(prefix="dropflow-skew-")
    rng = np.random.default_rng(11)
    n = 30000
    partkey = rng.integers(1, 200, n)
    partkey[: n // 3] = 7                      # the hot part
    li = pd.DataFrame({
        "l_orderkey": np.arange(n), "l_partkey": partkey, "l_suppkey": rng.integers(1, 50, n),
        "l_linenumber": rng.integers(1, 8, n).astype("int32"),
        "l_quantity": rng.integers(1, 51, n).astype(float), "l_extendedprice": rng.random(n),
        "l_discount": rng.integers(0, 11, n) / 100.0, "l_tax": rng.integers(0, 9, n) / 100.0,
        "l_returnflag": rng.choice(["R", "A", "N"], n), "l_linestatus": rng.choice(["O", "F"], n),
        "l_shipdate": pd.Timestamp("1995-01-01")})
    part = pd.DataFrame({"p_partkey": np.arange(1, 200), "p_name": [f"widget {i}" for i in range(1, 200)],
                         "p_brand": "b", "p_type": "t", "p_size": rng.integers(1, 50, 199).astype("int32"),
                         "p_retailprice": 1.0})
    li.to_parquet(os.path.join(d, "lineitem.parquet"))
    part.to_parquet(os.path.join(d, "part.parquet"))
    return d, li, part


def test_course_view_with_hot_part(spark, skewed_dir):
    d, li, part = skewed_dir
    got = course_view(spark, d).toPandas().set_index("CO_CURSO")
    exp = li.groupby("l_partkey").agg(QT_ING=("l_orderkey", "size"),
                                      DESV=("l_returnflag", lambda s: (s == "R").sum()),
                                      INSC=("l_quantity", "sum"))
    assert len(got) == len(exp)
    assert got.loc[7, "QT_ING"] == exp.loc[7, "QT_ING"] >= 10000
    assert (got["QT_ING"].sort_index().values == exp["QT_ING"].sort_index().values).all()
    assert (got["QT_SIT_DESVINCULADO"].sort_index().values == exp["DESV"].sort_index().values).all()
    assert np.allclose(got["QT_INSCRITO_TOTAL"].sort_index().values, exp["INSC"].sort_index().values)


def test_quantiles_of_hot_group(spark, skewed_dir):
    _, li, _ = skewed_dir
    df = spark.createDataFrame(li[["l_partkey", "l_quantity", "l_discount"]])
    probs = [0.25, 0.5, 0.75]
    q = exact_quantiles(df, "l_discount", probs, ["l_partkey"], names=["a", "b", "c"]).toPandas()
    hot = q[q["l_partkey"] == 7].iloc[0]
    expected = np.quantile(li.loc[li["l_partkey"] == 7, "l_discount"], probs)
    assert [hot["a"], hot["b"], hot["c"]] == pytest.approx(list(expected), abs=1e-12)
    whole = exact_quantiles(df, "l_quantity", probs, names=["a", "b", "c"]).first()
    assert list(whole) == pytest.approx(list(np.quantile(li["l_quantity"], probs)), abs=1e-12)
