"""Queries of the trained models (tested by held-out accuracy and brute-force base scores)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, language_model
from .common import documents


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    network = language_id.train(language_id.training_rows(docs.select("doc_id", "text", "lang")))
    found = language_id.predict(docs.select("doc_id", "text"), network)
    return found.select("doc_id", (language_model.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir)).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.col("train_tokens"), "base_score", "score")


QUERIES = {"op4_byte_cnn": op4_byte_cnn, "op7_maxent_lm": op7_maxent_lm}
ORACLE: dict[str, str] = {}
