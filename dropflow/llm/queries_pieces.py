"""Query of SentencePiece encoding and decoding (tests compare it with the library on whole texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sentencepieces
from .common import documents


def piece_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op12_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = piece_bpe()
    encoded = sentencepieces.encoded(documents(spark, sf_dir).select("doc_id", "text"), path)
    texts = sentencepieces.decoded(encoded.select("doc_id", "ids"), path)
    return texts.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_sentencepieces": op12_sentencepieces}
ORACLE: dict[str, str] = {}
