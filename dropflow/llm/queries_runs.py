"""Query of periodic run detection (tests compare it with a plain search for runs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs
from .common import documents, text_or_empty, words

#: A text whose id hash is a multiple of this gets repeated words.
REPEATED_EVERY = 10


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the texts the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hashed = docs.select("doc_id", text_or_empty().alias("text"), h.alias("h"))
    chosen = hashed.withColumn("ws", F.when(F.expr(f"h % {REPEATED_EVERY} = 0"), words(F.col("text"))))
    placed = (chosen.withColumn("n", F.size("ws").cast("long"))
              .withColumn("g", F.expr(f"h div {REPEATED_EVERY}"))
              .withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
              .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)")))
    repeated = F.expr("concat_ws(' ', transform(ws, (w, i) -> CASE WHEN i >= a THEN ws[CAST(a + (i - a) % p AS INT)] ELSE w END))")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def _number(run: Column) -> Column:
    return F.concat(F.concat_ws(",", *[run[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_repeats(documents(spark, sf_dir)))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", _number)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLE: dict[str, str] = {}
