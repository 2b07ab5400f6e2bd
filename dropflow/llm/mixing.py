"""Mixing sources to target weights by capped water-filling.

Every source gets a target number of words proportional to its weight, at most
``max_epochs`` times its own size; what a clamped source cannot take is shared
again by weight among the others until no source is above its cap. A document
is then taken ``floor(target / size of the source)`` whole times, and one more
time if it lies in the source's seeded sample for the fractional epoch.

The sample follows the order of a seeded hash of (doc_id, text). A document is
in if its middle lies before the end of the missing words. A long one across the
end would miss the target by more than an ordinary document (the source's mean):
it is settled by itself (in, if its middle lies before the end and it is no
longer than the missing words, or misses them by less than the others would
without it; else out), and the order of the others then ends where it fills what
is left. Each crossing is found in two steps, so that no
source is ever sorted as a whole: sums per (source, leading 16 bits of the hash),
then the single bucket that holds it. Only DataFrame operations are used.

Defined cases: null or empty text: size 0, taken like any other but adds no
words; null source: a source of its own, last in order; rows with equal
(doc_id, text) share a hash, so their fractional copies are taken or left
together; an empty table gives an empty result; if no text has a word, every
target is 0 and nothing is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, joined_small, text_or_empty, words

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
SEED = "mix-1"

#: The order key has 60 bits; its leading 16 bits are the bucket.
LOW_BITS = 44
LAST_KEY = (1 << 60) - 1


def order_key(seed: str, doc_id: str = "doc_id", text: str = "text") -> Column:
    """Seeded 60-bit key of a row, the same in any SQL engine with md5."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(doc_id).cast("string"), F.col(text)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One narrow row per document: doc_id, source, size in words, order key."""
    return docs.select("doc_id", "source", F.size(words(text_or_empty())).cast("long").alias("size"),
                       order_key(seed).alias("key"))


def numbered_sources(sources: DataFrame) -> DataFrame:
    """Number sources by code point, null last, without one task holding all of them."""
    ordered = checkpoint(sources.withColumn("absent", F.col("source").isNull())
                         .repartitionByRange("absent", "source")
                         .withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ordered.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
               .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("part").orderBy("absent", "source")
    return (ordered.join(F.broadcast(offsets), "part")
            .withColumn("rank", F.col("offset") + F.row_number().over(inside) - 1)
            .drop("part", "offset", "absent"))


def water_level(sources: DataFrame, max_epochs: float) -> float | None:
    """Words per unit of weight once every clamped source's excess is shared again.

    Each round is one aggregation that returns a row; it stops when no further
    source is clamped. None: all sources are at their cap.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    level, clamped_before = None, -1
    while True:
        clamped = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        row = sources.agg(F.sum("source_size").alias("total"),
                          F.sum(F.when(clamped, cap)).alias("held"),
                          F.sum(F.when(~clamped, F.col("weight"))).alias("weight"),
                          F.sum(clamped.cast("long")).alias("n")).first()
        if row["total"] is None or row["weight"] is None:
            return None
        if row["n"] == clamped_before:
            return level
        clamped_before = row["n"]
        level = (row["total"] - (row["held"] or 0.0)) / row["weight"]


def source_plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS,
                max_epochs: float = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """Per source: source, source_size, target, whole (epochs), cut, settled and pinned (of the fractional epoch,
    see :func:`_cuts`).

    ``sizes`` is a materialised :func:`measured` table; returns the plan and its row count.
    """
    listed = numbered_sources(sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("filled")))
    per_rank = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                            (F.col("rank") % len(weights) + 1).cast("int"))
    listed = checkpoint(listed.withColumn("weight", per_rank))
    level = water_level(listed, max_epochs)
    cap = F.col("source_size") * F.lit(max_epochs)
    target = cap if level is None else F.least(cap, F.col("weight") * F.lit(level))
    size = F.col("source_size")
    planned = (listed.withColumn("target", target)
               .withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)))
               .withColumn("rest", F.col("target") - F.col("whole") * size)
               .select("source", "source_size", "target", "whole", "rest", F.try_divide(size, F.col("filled")).alias("ordinary")))
    planned = checkpoint(planned)
    n_sources = planned.count()
    return planned.join(_cuts(sizes, planned, n_sources).withColumnRenamed("source", "cut_source"),
                        F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source"), n_sources


def _cuts(sizes: DataFrame, planned: DataFrame, n_sources: int) -> DataFrame:
    """Per source with a fractional epoch: the last order key that it takes, and the keys settled by themselves.

    ``pinned`` keys are in, the other ``settled`` ones are out, whatever the cut. A round settles one long
    document of every source that has one across its end.
    """
    none = F.array().cast("array<bigint>")
    state = checkpoint(planned.filter("rest > 0").select(
        "source", "rest", "ordinary", F.col("source_size").alias("open_words"), none.alias("settled"), none.alias("pinned"), F.lit(None).cast("long").alias("cut")))
    while state.filter("cut IS NULL").limit(1).count():
        found = _crossing(sizes, state.filter("cut IS NULL"), n_sources)
        joined = joined_small(state, found, n_sources, F.col("source").eqNullSafe(F.col("x_source")))
        size, missing = F.col("x_words"), F.col("rest") - F.col("x_before")
        inside = missing >= size / 2
        cut = (F.when(F.col("cut").isNotNull(), F.col("cut")).when(F.col("x_key").isNull(), F.lit(LAST_KEY))
               .when(inside & (size - missing <= F.col("ordinary")), F.col("x_key"))
               .when(~inside & (missing <= F.col("ordinary")), F.col("x_key") - 1))
        long = cut.isNull()
        short = F.col("rest") - (F.col("open_words") - size)  # of the others alone
        pin = long & inside & ((size <= F.col("rest") + F.col("ordinary")) | (size - F.col("rest") <= short))
        state = checkpoint(joined.select(
            "source", F.when(pin, F.col("rest") - size).otherwise(F.col("rest")).alias("rest"), "ordinary",
            F.when(long, F.col("open_words") - size).otherwise(F.col("open_words")).alias("open_words"),
            F.when(long, F.concat("settled", F.array("x_key"))).otherwise(F.col("settled")).alias("settled"),
            F.when(pin, F.concat("pinned", F.array("x_key"))).otherwise(F.col("pinned")).alias("pinned"),
            F.when(pin & (F.col("rest") - size <= 0), F.lit(-1).cast("long")).otherwise(cut).alias("cut")))
    return state.select("source", "cut", "settled", "pinned")


def _crossing(sizes: DataFrame, open_: DataFrame, n_sources: int) -> DataFrame:
    """Per open source: the key, settled ones aside, at which the words reach ``rest``, and the words before it.

    Sums per bucket (the key's top bits) find the bucket, then only that bucket is ordered.
    """
    bucket = F.shiftright("key", LOW_BITS)
    ends = open_.select(F.col("source").alias("p_source"), "settled", "rest")
    left = joined_small(sizes, ends, n_sources, F.col("source").eqNullSafe(F.col("p_source"))
                        & ~F.array_contains("settled", F.col("key")), "inner")
    left = left.select("source", "key", "size", "rest", bucket.alias("bucket"))
    totals = left.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("bucket")  # 65,536 rows a source at most
    crossing = (totals.withColumn("upto", F.sum("words").over(along))
                .filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
                .select(F.col("source").alias("c_source"), F.col("bucket").alias("c_bucket"),
                        (F.col("upto") - F.col("words")).alias("before")))
    slice_ = joined_small(left, crossing, n_sources,
                          F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("c_bucket")), "inner")
    keys = slice_.groupBy("source", "bucket", "key", "before", "rest").agg(F.sum("size").alias("words"))
    inside = Window.partitionBy("source").orderBy("key")
    upto = keys.withColumn("upto", F.col("before") + F.sum("words").over(inside))
    return (upto.filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
            .select(F.col("source").alias("x_source"), F.col("key").alias("x_key"),
                    (F.col("upto") - F.col("words")).alias("x_before"), F.col("words").alias("x_words")))


def copies(p: str = "") -> Column:
    c = lambda name: F.col(p + name)
    taken = F.array_contains(c("pinned"), c("key")) | ((c("key") <= c("cut")) & ~F.array_contains(c("settled"), c("key")))
    return (F.coalesce(c("whole"), F.lit(0)) + F.when(taken, F.lit(1)).otherwise(F.lit(0))).cast("long")


def planned_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS,
                      seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and copies of every document."""
    sizes = checkpoint(measured(docs, seed))
    plan, n = source_plan(sizes, weights, max_epochs)
    plan = checkpoint(plan).withColumnRenamed("source", "p_source")
    return (joined_small(sizes, plan, n, F.col("source").eqNullSafe(F.col("p_source")))
            .select("doc_id", "size", "source_size", "target", copies().alias("copies")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS,
        seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document repeated as often as the plan takes it, same columns.

    The second scan needs only a row's hash and its source's plan row, so texts are never shuffled
    (beyond ``BROADCAST_ROWS`` sources the plan is joined by a shuffle instead).
    """
    sizes = checkpoint(measured(docs, seed))
    plan, n = source_plan(sizes, weights, max_epochs)
    plan = checkpoint(plan).select(*[F.col(c).alias(f"__{c}") for c in ("source", "whole", "cut", "settled", "pinned")])
    keyed = docs.withColumn("__key", order_key(seed))
    out = joined_small(keyed, plan, n, docs["source"].eqNullSafe(F.col("__source")))
    return (out.withColumn("__copies", copies("__").cast("int")).filter("__copies > 0")
            .withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
