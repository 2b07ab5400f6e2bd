"""Delimited-file scans, file discovery and table sinks.

Census files are ``;``-separated, ISO-8859-1, and their columns drift from
year to year, so each file is scanned on its own (a directory read with
differing headers would silently misalign columns) and the per-file plans are
unioned by name. Every scan is string-typed; numeric coercion happens in
column expressions (``functions.numeric``) or, for inferred scans, after one
aggregation that decides each column's type.
"""

from __future__ import annotations

import fnmatch
import posixpath
from urllib.parse import unquote, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import NA_TOKENS
from ..functions.numeric import NUMERIC_PATTERN

LATIN1 = "ISO-8859-1"
INTEGER_PATTERN = r"^[+-]?\d+$"


def list_tables(spark: SparkSession, directory: str, pattern: str = "*.csv",
                case_insensitive: bool = False, recursive: bool = False,
                prefix: str | None = None, exclude_dirs=()) -> list[str]:
    """Sorted file paths under ``directory`` matching ``pattern`` (S6a-S6e).

    Listing goes through Spark's file index (binaryFile source, content not
    read), so it works on any Hadoop-compatible file system.
    """
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    try:
        files = reader.load(directory).select("path")
    except AnalysisException as e:  # a missing folder holds no tables; other failures are the caller's to see
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    base = _plain(directory)
    paths = [r[0] for r in files.collect()]  # one row per file: bounded by the listing
    out = []
    excluded = set(exclude_dirs)
    for p in paths:
        name = posixpath.basename(p)
        inside = _plain(p)
        # only folders below the start folder are pruned
        parts = inside[len(base):].split("/")[:-1] if inside.startswith(base) else inside.split("/")[:-1]
        if excluded and any(d in excluded for d in parts):
            continue
        n, pat = (name.lower(), pattern.lower()) if case_insensitive else (name, pattern)
        if not fnmatch.fnmatchcase(n, pat):
            continue
        if prefix is not None and not (name.lower() if case_insensitive else name).startswith(
                prefix.lower() if case_insensitive else prefix):
            continue
        out.append(p)
    return sorted(out)


def _plain(path: str) -> str:
    """A path without scheme and authority, percent-decoded, without a slash at its end."""
    return unquote(urlsplit(path).path if "://" in path or path.startswith("file:") else path).rstrip("/")


def normalise_missing(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    """Turn the reader's missing-value tokens into NULL in string columns."""
    toks = list(tokens)
    exprs = {f.name: F.when(F.col(f.name).isin(toks), F.lit(None).cast("string")).otherwise(F.col(f.name))
             for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns(exprs) if exprs else df


def infer_schema(df: DataFrame) -> T.StructType:
    """Types of a string-scanned table decided by one aggregation job: a column
    whose values are all plain integers (no NULL) is long, all numeric is
    double, anything else stays string (as a value-typing reader would)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs += [F.sum(F.when(x.isNotNull() & ~x.rlike(NUMERIC_PATTERN), 1).otherwise(0)).alias(f"bad{i}"),
                 F.sum(F.when(x.isNotNull() & ~x.rlike(INTEGER_PATTERN), 1).otherwise(0)).alias(f"frac{i}"),
                 F.count(x).alias(f"n{i}")]
    aggs.append(F.count(F.lit(1)).alias("__rows"))
    r = df.agg(*aggs).first()
    fields = []
    for f in df.schema.fields:
        t = f.dataType
        if f.name in cols:
            i = cols.index(f.name)
            if r[f"n{i}"] > 0 and r[f"bad{i}"] == 0:
                integral = r[f"frac{i}"] == 0 and r[f"n{i}"] == r["__rows"]
                t = T.LongType() if integral else T.DoubleType()
        fields.append(T.StructField(f.name, t, True))
    return T.StructType(fields)


def infer_types(df: DataFrame) -> DataFrame:
    """Cast a string-typed table to the types ``infer_schema`` decides."""
    schema = infer_schema(df)
    casts = {f.name: F.col(f.name).cast("double").cast(f.dataType)
             for f in schema.fields if not isinstance(f.dataType, T.StringType)}
    return df.withColumns(casts) if casts else df


def _reader(spark, sep, encoding):
    return (spark.read.option("header", "true").option("sep", sep).option("encoding", encoding)
            .option("quote", '"').option("escape", '"').option("inferSchema", "false")
            .option("mode", "PERMISSIVE"))


def _is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every line of a text file is valid UTF-8, judged on its bytes."""
    return spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count() == 0


def scan_csv(spark: SparkSession, path: str, sep: str = ";", encoding: str = LATIN1,
             infer: bool = False, usecols=None, with_source: bool = False) -> DataFrame:
    """Scan one delimited file as strings.

    ``encoding='auto'`` reads UTF-8 and falls back to ISO-8859-1 when a line's
    bytes are not valid UTF-8 (one pass over the lines decides; a replacement
    character that is really in the text is no such sign).
    ``usecols`` projects (pruned by the CSV reader). ``with_source`` adds the
    file name as ``__source``.
    """
    if encoding == "auto":
        bad = not _is_utf8(spark, path)
        encoding = LATIN1 if bad else "UTF-8"
    elif encoding.lower().replace("-", "") in ("latin1", "iso88591"):
        encoding = LATIN1
    df = _reader(spark, sep, encoding).csv(path)
    if usecols is not None:
        df = df.select(*[c for c in usecols if c in df.columns])
    df = normalise_missing(df)
    if infer:
        schema = infer_schema(df)
        if usecols is None:
            # re-scan with the decided schema (same file, same column order):
            # typed columns come from the reader, not from a projection of casts
            df = normalise_missing(_reader(spark, sep, encoding).schema(schema).csv(path))
        else:
            df = infer_types(df)  # the projection is already narrow
    if with_source:
        df = df.withColumn("__source", F.col("_metadata.file_name"))
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sep: str = ";",
                encoding: str = "UTF-8", partition_by=None, mode: str = "overwrite",
                header: bool = True) -> None:
    """Write a table (S8-S13). Partitioned writes overwrite only the partitions
    present in ``df`` (re-running one year replaces that year alone)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(
            *([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        enc = LATIN1 if encoding.lower().replace("-", "") in ("latin1", "iso88591") else encoding
        w.option("header", str(header).lower()).option("sep", sep).option("encoding", enc) \
         .option("quote", '"').option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               string_partitions=("ANO_BASE", "arquivo_base")) -> DataFrame:
    """Read a written table; Parquet schemas of different years are merged by
    name. Partition discovery types ``ANO_BASE=2022`` as a number, so the
    listed partition columns are turned back into strings."""
    if fmt == "parquet":
        df = spark.read.option("mergeSchema", "true").parquet(path)
    else:
        df = _reader(spark, ";", "UTF-8").csv(path)
    casts = {c: F.col(c).cast("string") for c in string_partitions if c in df.columns}
    return df.withColumns(casts) if casts else df


def split_by_role(df: DataFrame, numeric, categorical) -> tuple[DataFrame, DataFrame]:
    """Numeric and categorical value blocks of a table."""
    return df.select(*numeric), df.select(*categorical)
