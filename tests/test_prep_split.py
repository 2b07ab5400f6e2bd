"""Encoding, preprocessing and split invariants."""

import math

import pytest
from pyspark.sql import functions as F

from dropflow.operators.prep import Preprocess, apply_ordinal, ordinal_encode
from dropflow.operators.split import split
from dropflow.functions.categories import clean_category


def test_ordinal_codes_and_unseen(spark):
    fit = spark.createDataFrame([("2",), ("10",), ("1",)], "c string")
    enc, model = ordinal_encode(fit, ["c"])
    assert {r["c"]: r["c__ord"] for r in enc.collect()} == {"1": 0.0, "10": 1.0, "2": 2.0}
    new = spark.createDataFrame([("10",), ("7",)], "c string").withColumn("c", clean_category("c"))
    assert [r["c__ord"] for r in apply_ordinal(new, model, ["c"]).collect()] == [1.0, -1.0]


def test_preprocess_scaling_uses_population_std(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (3.0, None)], "a double, c string")
    model = Preprocess(["a"], ["c"], numeric="scale", categorical="ordinal").fit(df)
    rows = model.transform(df).select("features").collect()
    std = math.sqrt(2 / 3)
    assert [r[0][0] for r in rows] == pytest.approx([-1 / std, 0.0, 1 / std])
    assert [r[0][1] for r in rows] == [1.0, 2.0, 0.0]  # 'nan' < 'x' < 'y'


def test_preprocess_median_impute_and_onehot(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, "x"), (10.0, "z")], "a double, c string")
    model = Preprocess(["a"], ["c"], numeric="median+scale", categorical="onehot").fit(df)
    assert model.num_fill == {"a": 3.0}
    out = model.transform(spark.createDataFrame([(None, "w")], "a double, c string")).select("features").first()[0]
    assert len(out) == 1 + 3 and list(out.toArray()[1:]) == [0.0, 0.0, 0.0]  # unseen -> zeros


def test_split_sizes_exact_and_deterministic(spark):
    df = spark.range(0, 1003).withColumn("y", (F.col("id") % 3).cast("int"))
    s = split(df, ["id"], 0.2, 42)
    assert s.filter("is_test").count() == math.ceil(1003 * 0.2)
    again = split(df.repartition(7), ["id"], 0.2, 42)
    a = {r["id"] for r in s.filter("is_test").select("id").collect()}
    b = {r["id"] for r in again.filter("is_test").select("id").collect()}
    assert a == b
    st = split(df, ["id"], 0.2, 42, stratify="y")
    sizes = {r["y"]: r["n"] for r in st.filter("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    full = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert sizes == {k: math.ceil(v * 0.2) for k, v in full.items()}


def test_split_of_repeated_keys_is_disjoint_complete_and_exact(spark):
    # seven key values and many equal rows: the whole row, not the key, decides
    df = spark.range(0, 2000).select((F.col("id") % 7).alias("key"), (F.col("id") % 500).alias("v"), (F.col("id") % 2).alias("y"))
    flagged = split(df, None, 0.2, 42, stratify="y")
    a = flagged.groupBy("key", "v", "y").count()
    assert a.agg(F.sum("count")).first()[0] == 2000
    sizes = {r["y"]: r["n"] for r in flagged.filter("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 200, 1: 200}
    again = split(df.repartition(5), None, 0.2, 42, stratify="y").filter("is_test").drop("is_test")
    assert flagged.filter("is_test").drop("is_test").exceptAll(again).count() == 0


def test_mlp_regressor_learns_saves_and_reloads(spark, tmp_dir):
    from pyspark.ml.feature import VectorAssembler
    from dropflow.operators.mlp import MLPModel, MLPRegressor
    df = spark.range(0, 400).select((F.col("id") / 200 - 1).alias("a")).withColumn("label", F.col("a") * 2 + 0.5)
    data = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    model = MLPRegressor(hidden=(8,), activation="relu", max_iter=60, learning_rate=0.05).fit(data)
    got = model.transform(data)
    assert got.agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0] < 0.1
    model.write().overwrite().save(tmp_dir + "/mlp")
    back = MLPModel.load(tmp_dir + "/mlp").transform(data)
    assert [r["prediction"] for r in back.collect()] == [r["prediction"] for r in got.collect()]


def test_class_weights_do_not_shuffle_rows(spark):
    from dropflow.operators.stats import class_weights
    df = spark.range(0, 10).withColumn("y", (F.col("id") < 3).cast("int"))
    w = class_weights(df, "y")
    assert "Exchange" not in w._jdf.queryExecution().executedPlan().toString()
    assert {r["y"]: r["weight"] for r in w.collect()} == pytest.approx({0: 10 / 14, 1: 10 / 6})


def test_checkpoint_folder_is_required_off_local():
    from dropflow.session import is_local
    assert is_local("local") and is_local("local[4]") and not is_local("local-cluster[2,1,1024]") and not is_local("yarn")
