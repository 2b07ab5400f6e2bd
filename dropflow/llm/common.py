"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dropflow.session import ensure_checkpoint_dir

#: White space of the word rule ``[^\x20\x09-\x0D]+`` (Java and Python syntax).
SPACE = r"[\x20\x09-\x0D]"

#: A table with at most this many rows (counted first) may be broadcast.
BROADCAST_ROWS = 100_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def workers_import(spark: SparkSession) -> None:
    """Let Python workers started on this machine import the package from where the driver did.

    Executors elsewhere get the package as any Spark job's code, with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array."""
    return F.array_remove(F.split(text, SPACE + "+", -1), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder (for tables that columns are pruned from)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: a lineage cut that prunes columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through the store that holds it."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def joined_small(df: DataFrame, small: DataFrame, rows: int, on, how: str = "left") -> DataFrame:
    """Join against a table whose rows were counted: broadcast it up to BROADCAST_ROWS, else shuffle."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)
