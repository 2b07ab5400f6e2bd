"""Vocabularies without the driver, and pipelines that score raw rows after loading."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from dropflow.operators.mlp import MLPRegressor
from dropflow.operators.prep import Preprocess
from dropflow.operators.vocabulary import Vocabulary


def raw_table(spark, n=400):
    return spark.range(n).select(
        F.when(F.col("id") % 7 != 0, F.col("id") % 50).cast("double").alias("QT_ING"),
        (F.col("id") % 11).cast("double").alias("QT_MAT"),
        F.when(F.col("id") % 13 != 0, F.concat(F.lit("é"), F.col("id") % 5)).alias("SG_UF"),
        (F.col("id") % 3).cast("string").alias("TP_REDE"),
        (F.col("id") % 50 * 0.01).alias("label"))


@pytest.mark.parametrize("numeric, categorical", [("zero+scale", "ordinal"), ("median+scale", "onehot")])
def test_loaded_pipeline_scores_raw_rows_alike(spark, tmp_dir, numeric, categorical):
    data = raw_table(spark)
    prep = Preprocess(["QT_ING", "QT_MAT"], ["SG_UF", "TP_REDE"], numeric=numeric, categorical=categorical).fit(data)
    model = MLPRegressor(hidden=(6,), activation="tanh", max_iter=15).fit(prep.transform(data))
    pipeline = PipelineModel([prep, model])
    new = raw_table(spark, 60).unionByName(spark.createDataFrame([(None, None, "unseen", "9", 0.0)], data.schema))
    want = sorted(r[0] for r in pipeline.transform(new).select("prediction").collect())
    path = f"{tmp_dir}/pipeline"
    pipeline.write().overwrite().save(path)
    pipeline.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    assert sorted(r[0] for r in loaded.transform(new).select("prediction").collect()) == pytest.approx(want, rel=1e-9)
    names = {r["Feature"] for r in loaded.stages[0].feature_names(spark).collect()}
    assert names >= {"QT_ING", "SG_UF=é0", "TP_REDE=2", "SG_UF=nan"} if categorical == "onehot" else names == {
        "QT_ING", "QT_MAT", "SG_UF", "TP_REDE"}
    new.write.parquet(f"{tmp_dir}/new")
    script = ("import sys; from dropflow.session import get_session; from pyspark.ml import PipelineModel; "
              "s = get_session('local[2]'); p = PipelineModel.load(sys.argv[1]).transform(s.read.parquet(sys.argv[2])); "
              "print('GOT', sorted(r[0] for r in p.select('prediction').collect()))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", script, path, f"{tmp_dir}/new"], capture_output=True, text=True, timeout=300,
                         cwd=root, env=os.environ | {"PYTHONPATH": root})
    assert "GOT " in out.stdout, out.stderr[-2000:]
    assert json.loads(out.stdout.split("GOT ")[1]) == pytest.approx(want, rel=1e-9)


def test_a_million_values_stay_off_the_driver(spark):
    data = spark.range(1_000_000).select(F.concat(F.lit("v"), F.col("id")).alias("a"), (F.col("id") % 10).cast("string").alias("b"))
    made = Vocabulary.fit(data, ["a", "b"])
    assert made.sizes == {"a": 1_000_000, "b": 10}
    coded = made.encode(data, ["a", "b"], "__c")
    r = coded.agg(F.countDistinct("a__c"), F.min("a__c"), F.max("a__c"), F.sum((F.col("b").cast("double") != F.col("b__c")).cast("int"))).first()
    assert tuple(r) == (1_000_000, 0.0, 999_999.0, 0)
    order = coded.filter("a IN ('v0', 'v1', 'v10', 'v99999', 'v999999')").orderBy("a__c").select("a")
    assert [x["a"] for x in order.collect()] == ["v0", "v1", "v10", "v99999", "v999999"]


def test_empty_vocabulary_is_all_unknown(spark):
    none = spark.createDataFrame([], "c string")
    made = Vocabulary.fit(none, ["c"])
    assert made.sizes == {"c": 0}
    assert made.encode(spark.createDataFrame([("x",), (None,)], "c string"), ["c"], "__c").filter("c__c = -1").count() == 2
