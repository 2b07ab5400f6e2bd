"""Query of the token files (a tokenizer is not SQL-expressible; tests round-trip and compare ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import documents


def word_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def digest(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(tokens.tokenized(documents(spark, sf_dir), word_bpe()))


QUERIES = {"op3_token_files": op3_token_files}
ORACLE: dict[str, str] = {}
