"""Host-level quality rules with an empirical beta prior.

Per document: counts over the whole text, two *base* rules that always reject,
and rules of form with two limits, ``SOFT`` and ``FAR``. A document beyond a far
limit is rejected anywhere, one within the soft limits is kept anywhere; between
them its host decides. Per host (the source of a document): the documents that
pass the base rules, how many of them are beyond a soft limit, that rate shrunk
towards the corpus by a beta prior fitted to the hosts by moments, and a verdict:
a host is *strict* if its shrunk rate is over ``WORSE`` times the corpus rate. On
strict hosts the soft limits hold, on the others the far ones.

Everything is DataFrame code. A document's counts come from its own row
(arrays inside the row, no shuffle); only one narrow row a document goes into
the host aggregation, which is pre-aggregated, so a host that holds a third of
all documents is a few rows per task.

Defined cases: null text: no words, all counts 0, fails the base rule; null
source: a host of its own; repeated rows count each; an empty table gives an
empty result; one host alone: the prior carries one document's weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, joined_small, text_or_empty, words, written

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: A host whose shrunk rate is more than this many times the corpus rate is strict.
WORSE = 1.05
#: Limits of form: symbols and exclamation marks per word, repeated lines per line, mean word length.
SOFT = dict(symbols=0.25, marks=0.25, dup_lines=0.5, shortest=2.0, longest=15.0)
FAR = dict(symbols=0.5, marks=0.5, dup_lines=0.8, shortest=1.5, longest=25.0)
#: Bounds of the prior's weight in documents.
PRIOR_MIN, PRIOR_MAX = 1.0, 10_000.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks")


def with_counts(docs: DataFrame, text: Column, p: str = "__") -> DataFrame:
    """Add the counts of a text, each as column ``p + name``."""
    c = lambda name: F.col(p + name)
    d = docs.withColumn(p + "text", text)
    d = d.withColumns({
        p + "words": words(c("text")),
        p + "lines": F.filter(F.split(c("text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        p + "n_symbols": (F.size(F.split(c("text"), r"[#*$%&|<>]", -1)) - 1).cast("long"),
        p + "n_marks": (F.size(F.split(c("text"), r"!", -1)) - 1).cast("long"),
    })
    w = c("words")
    # a 3-word window is its chained 64-bit hash; windows start at positions 0 .. n - 3
    d = d.withColumns({
        p + "n_words": F.size(w).cast("long"),
        p + "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        p + "n_lines": F.size(c("lines")).cast("long"),
        p + "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
        p + "windows": F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
                                   lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
    })
    # only a text with a repeated window is sorted by (hash, position)
    repeats = F.size(F.array_distinct(c("windows"))) < F.size(c("windows"))
    d = d.withColumn(p + "sorted", F.when(repeats, F.sort_array(
        F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = c("sorted")
    again = lambda x, k: (F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))
                          | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
    d = d.withColumn(p + "at", F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"])))
    at = c("at")
    covered = F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda acc, i: F.struct(i.alias("last"),
                                                  (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
                          lambda acc: acc["n"])
    return (d.withColumn(p + "n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
            .drop(*[p + x for x in ("text", "words", "lines", "windows", "sorted", "at")]))


def base_failed(p: str = "__") -> Column:
    c = lambda name: F.col(p + name)
    return (c("n_words") < MIN_WORDS) | (c("n_repeat_words") * 100 > c("n_words") * MAX_REPEAT_PCT)


def beyond(limits: dict, p: str = "__") -> Column:
    """Whether a document's form is beyond one of the limits."""
    c = lambda name: F.col(p + name)
    n = F.greatest(c("n_words"), F.lit(1))
    mean = c("word_chars") / n
    return ((c("n_symbols") > n * limits["symbols"])                                       # symbols in place of prose
            | (c("n_marks") > n * limits["marks"])                                         # shouting
            | (c("n_dup_lines") > F.greatest(c("n_lines"), F.lit(1)) * limits["dup_lines"])  # the same lines again
            | (mean < limits["shortest"]) | (mean > limits["longest"]))                    # no words


def host_verdicts(flags: DataFrame, worse: float = WORSE) -> tuple[DataFrame, int]:
    """host, n_docs, n_failed, rate (shrunk), strict; and the number of hosts.

    ``flags`` has host, judged and failed (booleans). The prior's mean is the corpus rate m; its weight
    comes from the spread of the hosts' rates: m(1-m)/v - 1 with v their variance weighted by documents.
    """
    hosts = checkpoint(flags.groupBy("host").agg(F.sum(F.col("judged").cast("long")).alias("n_docs"),
                                                 F.sum((F.col("judged") & F.col("failed")).cast("long")).alias("n_failed")))
    n, k = F.col("n_docs"), F.col("n_failed")
    judged = n > 0
    t = hosts.agg(F.count("*").alias("hosts"), F.sum(judged.cast("long")).alias("judged"), F.sum("n_docs").alias("n"),
                  F.sum("n_failed").alias("k"), F.sum(F.when(judged, k * k / n)).alias("kk")).first()
    if not t["n"]:
        return hosts.select("host", "n_docs", "n_failed", F.lit(0.0).alias("rate"), F.lit(False).alias("strict")), t["hosts"]
    m = t["k"] / t["n"]
    v = t["kk"] / t["n"] - m * m
    weight = min(max(m * (1 - m) / v - 1, PRIOR_MIN), PRIOR_MAX) if v > 0 else PRIOR_MAX
    weight = weight if t["judged"] > 1 else PRIOR_MIN
    rate = (k + F.lit(m * weight)) / (n + F.lit(weight))
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"),
                        (rate > F.lit(m * worse)).alias("strict")), t["hosts"]


def with_verdicts(counted: DataFrame, source: str = "source", worse: float = WORSE,
                  p: str = "__") -> DataFrame:
    """Join host verdicts to a materialised table of counts; adds base_failed and kept (prefixed)."""
    bad = base_failed(p)
    flagged = counted.select(F.col(source).alias("host"), (~bad).alias("judged"), beyond(SOFT, p).alias("failed"))
    verdicts, n = host_verdicts(flagged, worse)
    small = verdicts.select(F.col("host").alias(p + "host"), F.col("strict").alias(p + "strict"))
    out = joined_small(counted, small, n, counted[source].eqNullSafe(F.col(p + "host")))
    return out.withColumns({p + "base_failed": bad,
                            p + "kept": ~bad & ~beyond(FAR, p) & ~(beyond(SOFT, p) & F.col(p + "strict"))}
                           ).drop(p + "host", p + "strict")


def judged(docs: DataFrame, worse: float = WORSE) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    narrow = with_counts(docs.select("doc_id", "source", F.col("text").alias("__raw")), F.coalesce("__raw", F.lit("")))
    narrow = checkpoint(narrow.drop("__raw"))
    out = with_verdicts(narrow, worse=worse)
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in COUNTS],
                      F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, worse: float = WORSE) -> DataFrame:
    """The documents that are kept, same columns.

    Counts are the costly part, so rows and counts are written once; the host
    aggregation then reads only its narrow columns and the filter reads the rows.
    """
    counted = written(with_counts(docs, text_or_empty()), "quality")
    return with_verdicts(counted, worse=worse).filter("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])
