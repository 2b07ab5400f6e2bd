"""Line dedup by a deletion-neighbourhood join.

A line is its words joined by single spaces; lines without a word are no
lines here and always stay. Two lines are the same up to the edit bound if one
word is replaced, inserted or deleted, and both have at least ``MIN_WORDS``
words (so they keep 7 of 8 words or more); shorter lines must be equal. A line
goes if an earlier line, by (doc_id, text key, line number), is the same up to
the bound. The text key, 60 bits of the text's hash, tells documents of equal or
missing ids apart.

1. Every line becomes a narrow row: its 64-bit hash, its place and the hashes
   of its halves. Equal lines meet by hash; the earliest place is kept.
2. An edit of one word leaves the first or the last half of the shorter line
   whole, so only lines that share a half with another line can have a
   partner. This filter is exact and drops most lines before step 3.
3. Those lines emit their deletion neighbourhood: the line itself and the line
   without each of its words, as hashed keys. Lines with the same word left
   out at the same place differ by a replacement there; a line equal to
   another one's variant differs by an insertion.
4. Keys are aggregated to their earliest member, never expanded to pairs, so a
   variant shared by a third of all lines costs a row for each line.
5. The edit of a line and its earliest partner is verified on the words.

DataFrame operations only. Defined cases: null text: no lines; rows with equal
doc_id and equal text are one document, whose lines at equal numbers are the
same place (each keeps what the document keeps); rows with equal or no doc_id
and different texts are documents of their own; a null doc_id comes last in
order; ties do not exist between places; empty table: empty result. The
variants of a line of n words take work in proportion to n * n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, text_or_empty, words, written

MIN_WORDS = 8


def _hash_words(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def text_key(text: str = "text") -> Column:
    """60 bits of the text's md5, the same in any SQL engine with md5; 0 without a text."""
    return F.coalesce(F.conv(F.substring(F.md5(F.col(text)), 1, 15), 16, 10).cast("long"), F.lit(0).cast("long"))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no (from 0), words of every line that has a word."""
    keyed = docs.select("doc_id", text_key().alias("text_key"), text_or_empty().alias("text"))  # a key a text, not a line
    split = keyed.select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return split.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text_key", "line_no", words(F.col("line")).alias("words"))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key", "line_no")


def _of_document(df: DataFrame, id_column: str, key_column: str) -> Column:
    return df["doc_id"].eqNullSafe(F.col(id_column)) & (text_key() == F.col(key_column))


def halves(hashes: Column) -> Column:
    """Keys of the first and last floor(n/2) and floor((n-1)/2) words."""
    n = F.size(hashes)
    keys = []
    for p in (F.floor(n / 2), F.floor((n - 1) / 2)):
        p = p.cast("int")
        keys += [F.xxhash64(F.lit(1), p, F.slice(hashes, F.lit(1), p)), F.xxhash64(F.lit(2), p, F.slice(hashes, n - p + 1, p))]
    return F.when(n >= MIN_WORDS, F.array_distinct(F.array(*keys))).otherwise(F.array().cast("array<bigint>"))


def _without(array: Column, i: Column) -> Column:
    """The array without element i (from 0); -1: all of it."""
    return F.when(i < 0, array).otherwise(F.concat(F.slice(array, F.lit(1), F.greatest(i, F.lit(0))),
                                                   F.slice(array, F.greatest(i, F.lit(0)) + 2, F.size(array))))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, kind ('exact' or 'near') of every line that goes."""
    docs = docs.select("doc_id", "text")
    hashed = numbered_lines(docs).select("doc_id", "text_key", "line_no", _hash_words(F.col("words")).alias("hashes"))
    lines = written(hashed.select("doc_id", "text_key", "line_no", F.xxhash64("hashes").alias("line"), halves(F.col("hashes")).alias("halves")),
                    "lines")
    firsts = checkpoint(lines.groupBy("line").agg(F.min(_place()).alias("first")))
    near = near_lines(docs, lines, firsts)
    judged = (lines.select("doc_id", "text_key", "line_no", "line").distinct().join(firsts, "line").join(near, "line", "left")
              .withColumn("kind", F.when(_place() > F.col("first"), F.lit("exact")).when(F.col("near"), F.lit("near"))))
    return judged.filter("kind is not null").select("doc_id", "text_key", "line_no", "kind")


def near_lines(docs: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(line, near) for every distinct line that an earlier, different line is near to."""
    keyed = lines.select("line", F.explode("halves").alias("half"))
    shared = (keyed.groupBy("half").agg(F.min("line").alias("low"), F.max("line").alias("high"))
              .filter("low <> high").select("half"))
    sharing = keyed.join(shared, "half", "left_semi").select("line").distinct()
    wanted = firsts.join(sharing, "line", "left_semi").select("line", "first")
    # the words of these lines, from the document of their first place
    by_doc = wanted.groupBy("first.doc_id", "first.text_key").agg(
        F.collect_set(F.struct(F.col("first.line_no").alias("line_no"), "line")).alias("wanted"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "w_doc_id", "text_key": "w_text_key"})
    texts = (docs.join(by_doc, _of_document(docs, "w_doc_id", "w_text_key"))
             .withColumn("lines", F.split(text_or_empty(), "\n", -1))
             .select("doc_id", F.col("w_text_key").alias("text_key"), "lines", F.explode("wanted").alias("w"))
             .select("doc_id", "text_key", F.col("w.line_no").alias("line_no"), F.col("w.line").alias("line"),
                     words(F.coalesce(F.get("lines", F.col("w.line_no")), F.lit(""))).alias("words"))
             .withColumn("hashes", _hash_words(F.col("words"))).filter(F.xxhash64("hashes") == F.col("line"))
             .dropDuplicates(["line"]))
    texts = written(texts.select("line", _place().alias("first"), "words", "hashes"), "near-lines")
    n = F.size("hashes")
    out = F.explode(F.sequence(F.lit(-1), n - 1))
    variants = checkpoint(texts.select("line", "first", n.alias("n"), "hashes", out.alias("gap"))
                          .select("line", "first", "gap", F.when(F.col("gap") < 0, F.col("n")).otherwise(F.col("n") - 1).alias("left"),
                                  F.xxhash64(_without(F.col("hashes"), F.col("gap"))).alias("key")))
    low = F.min(F.struct("first", "line", "gap")).alias("low")
    # a word replaced: the same words left with the gap at the same place
    gaps = variants.filter("gap >= 0")
    replaced = gaps.groupBy("key", "left", "gap").agg(low, F.count("*").alias("members")).filter("members > 1")
    a = gaps.join(replaced.drop("members"), ["key", "left", "gap"])
    # a word inserted: one line is what is left of the other
    whole = variants.filter("gap < 0").select("key", "left", F.struct("first", "line", "gap").alias("low"))
    b = gaps.join(whole, ["key", "left"])
    c = variants.filter("gap < 0").join(gaps.groupBy("key", "left").agg(low), ["key", "left"])
    columns = ["line", "first", "gap", "low"]
    candidates = (a.select(*columns).union(b.select(*columns)).union(c.select(*columns))
                  .filter((F.col("low.first") < F.col("first")) & (F.col("low.line") != F.col("line"))))
    partner = candidates.groupBy("line").agg(F.min(F.struct("low", "gap")).alias("p")).select(
        "line", "p.gap", F.col("p.low.line").alias("other"), F.col("p.low.gap").alias("other_gap"))
    mine = texts.select("line", F.col("words").alias("words"))
    other = texts.select(F.col("line").alias("other"), F.col("words").alias("other_words"))
    checked = partner.join(mine, "line").join(other, "other")
    same = _without(F.col("words"), F.col("gap")) == _without(F.col("other_words"), F.col("other_gap"))
    one_edit = (F.size("words") >= MIN_WORDS) & (F.size("other_words") >= MIN_WORDS)
    return checked.filter(same & one_edit).select("line", F.lit(True).alias("near"))


def summary(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_exact, n_near, dropped (sorted line numbers)."""
    dropped = dropped_lines(docs).groupBy("doc_id", "text_key").agg(
        F.sum((F.col("kind") == "exact").cast("long")).alias("n_exact"),
        F.sum((F.col("kind") == "near").cast("long")).alias("n_near"),
        F.sort_array(F.collect_list("line_no")).alias("dropped")).withColumnsRenamed({"doc_id": "d_doc_id", "text_key": "d_text_key"})
    has_word = F.filter(F.split(text_or_empty(), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select("doc_id", text_key().alias("text_key"), F.size(has_word).cast("long").alias("n_lines"))
    same = F.col("doc_id").eqNullSafe(F.col("d_doc_id")) & (F.col("text_key") == F.col("d_text_key"))
    return counted.join(dropped, same, "left").select(
        "doc_id", "n_lines", F.coalesce("n_exact", F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with the lines that go cut out of their texts; same columns."""
    dropped = dropped_lines(docs).groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("__drop"))
    dropped = dropped.withColumnsRenamed({"doc_id": "__id", "text_key": "__text_key"})
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    cut = F.array_join(F.transform(kept, lambda i: F.get(F.col("__lines"), i)), "\n")
    joined = docs.withColumn("__lines", lines).join(dropped, _of_document(docs, "__id", "__text_key"), "left")
    return (joined.withColumn("__text", F.when(F.col("__drop").isNull() | F.col("text").isNull(), F.col("text")).otherwise(cut))
            .select(*[F.col("__text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]))
