"""A training corpus in five stages, each calling one operator of ``dropflow.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes it as Parquet to the shared checkpoint folder and rereads it as the next
stage's documents. All stages but the last keep the columns of ``documents``.

1. quality rules: rejected documents go;
2. SimHash near-dedup: one document of each group stays;
3. benchmark decontamination: documents with a hit window go;
4. mixing: documents repeat, or go, as their source's target asks;
5. token files: the corpus is written as token ids and read back; one row per
   document (repeated documents have a row each) with its place and checksum.

Defined cases (nulls, empty texts and tables, repeats, ties, clashing column
names) are those of the operators; an empty stage makes all later ones empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropflow.llm import decontaminate, mixing, quality, simhash, tokens
from dropflow.llm.common import documents, written
from dropflow.llm.queries_tokens import word_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.tokenized(docs, word_bpe()).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_files),
]

#: The fingerprints and the tokenizer are not SQL-expressible; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower(), codec="snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
