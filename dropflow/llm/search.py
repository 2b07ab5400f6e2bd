"""Ranked lexical search over bags of words, each distinct bag scored once.

Terms are runs of ASCII letters and digits and non-ASCII characters, A-Z
lower-cased. Only the terms of the items (the stated query set) matter, so a
document shrinks to its bag: term numbers of the item vocabulary with their
counts, and m, which stands for its length. Bags are hashed, equal hashes are
told apart by the whole bag and m, and each class is scored once:

    score(item) = sum over the item's terms of w * ((10^9 * tf) div (1000 * tf + 8 * m))
    w = floor(1000 * ln((2 N + 2) / (2 df + 1)))
    m = 10 + (90 * n * N) div L

with N documents that have a term, L terms in all, n terms of the document, df
documents that hold the term. All terms count in N, L and n.

Ranking a class by its smallest doc_id suffices: of classes with equal scores
the one with the smaller first member comes first, so an item's ``top`` best
documents lie in its ``top`` best classes, and of each class no more than its
``top`` smallest ids can be among them. So a class of any size is a window
limit per task and class, classes are scored in tasks that keep ``top`` classes
an item, and only the winners are expanded by ascending doc_id.

Items come to the driver in blocks of at most ``BLOCK_CHARS`` characters; one
block is one broadcast vocabulary and one scan of the documents, so no item is
dropped and a task's memory is bounded.

Defined cases: a null or empty text or item has no terms and is never ranked;
repeated item_ids are one item with the terms of all its rows; an item without
an id is ranked under null; each input row is a document of its own, so
repeated rows rank one after the other; a document without an id comes after
all others of its score; fewer than ``top`` scoring documents give fewer ranks;
empty tables give an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import texts
from .common import workers_import, written
from .decontaminate import item_words

TOP = 10
BLOCK_CHARS = 1_000_000

#: Cells (classes x items) and postings scored at a time.
CELLS = 1_000_000

_BAG = T.StructType([T.StructField("n", T.LongType()), T.StructField("bag", T.BinaryType())])


def item_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(item_id, its distinct terms) in blocks of bounded text; rows of one id stay together."""
    rows = (items.groupBy("item_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
            .orderBy("item_id").toLocalIterator())
    block, chars = [], 0
    for item, text in rows:
        if block and chars + len(text) > limit:
            yield block
            block, chars = [], 0
        terms = sorted(set(item_words(text.encode())))
        if terms:
            block.append((item, terms))
            chars += len(text)
    if block:
        yield block


def bag_of(words: list[bytes], vocabulary: dict[bytes, int]) -> bytes:
    """(term number, count) pairs by term number, as little-endian 32-bit pairs."""
    known = [i for i in map(vocabulary.get, words) if i is not None]
    if not known:
        return b""
    terms, counts = np.unique(np.array(known, np.uint32), return_counts=True)
    return np.stack((terms, counts.astype(np.uint32)), 1).astype("<u4").tobytes()


_SHARED: dict[str, object] = {}


def _cached(key: str, build):
    """A value built once in each Python worker; only the last one is kept."""
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = build()
    return _SHARED[key]


def bags(docs: DataFrame, vocabulary: list[bytes], id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, n (all terms) and the bag of each document that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = uuid.uuid4().hex
    read = docs.select(F.col(id_column).alias("doc_id"), F.col(column).alias("text"))
    schema = T.StructType([read.schema["doc_id"], *_BAG.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _cached(key, lambda: {w: i for i, w in enumerate(shared.value)})
        for batch in batches:
            sizes, found, kept = [], [], []
            for row, text in enumerate(texts(batch)):
                words = item_words(text)
                if words:
                    kept.append(row)
                    sizes.append(len(words))
                    found.append(bag_of(words, number))
            ids = batch.column("doc_id").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(found, pa.binary())],
                                             names=["doc_id", "n", "bag"])

    return read.mapInArrow(run, schema)


def document_counts(found: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term; tasks send one array each, summed term by term."""
    schema = "term int, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch.column("bag").to_pylist()), "<u4")
            total += np.bincount(pairs[::2], minlength=terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["term", "docs"])

    out = np.zeros(terms, np.int64)
    for term, docs in found.select("bag").mapInArrow(run, schema).groupBy("term").agg(F.sum("docs")).collect():
        out[term] = docs
    return out


def classes(found: DataFrame, documents: int, terms: int, top: int) -> DataFrame:
    """One row per distinct (bag, m): m, the bag and its ``top`` smallest ids in order."""
    m = F.expr(f"10 + (90 * n * {documents}L) div {terms}L")
    told = found.filter(F.length("bag") > 0).select("doc_id", "bag", m.alias("m"))
    hashed = told.withColumn("h", F.xxhash64("bag", "m"))
    member = Window.partitionBy("h", "bag", "m").orderBy(F.col("doc_id").asc_nulls_last())
    first = hashed.withColumn("place", F.row_number().over(member)).filter(F.col("place") <= top)
    return first.groupBy("h", "bag", "m").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "doc_id"))), lambda s: s["doc_id"]).alias("members"))


class Postings:
    """The items that hold each term, as one flat array with bounds."""

    def __init__(self, items: list[list[int]], weight: np.ndarray) -> None:
        term = np.concatenate([np.asarray(t, np.int64) for t in items])
        item = np.repeat(np.arange(len(items)), [len(t) for t in items])
        self.count = np.bincount(term, minlength=len(weight))
        self.begin = np.cumsum(self.count) - self.count
        self.item = item[np.argsort(term, kind="stable")]
        self.items, self.weight = len(items), weight

    def blocks(self, m: np.ndarray, bags: list[bytes], cells: int = CELLS) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, scores of row x item) over runs of bags with a bounded number of cells and postings.

        Sums are whole numbers far below 2^53, so adding them as doubles is exact.
        """
        pairs = np.frombuffer(b"".join(bags), "<u4").astype(np.int64).reshape(-1, 2)
        sizes = np.array([len(b) // 8 for b in bags])
        ends = np.cumsum(sizes)
        row, term, tf = np.repeat(np.arange(len(bags)), sizes), pairs[:, 0], pairs[:, 1]
        value = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        work = np.concatenate(([0], np.cumsum(self.count[term])))[ends]   # postings up to each row's end
        first = 0
        while first < len(bags):
            done = work[first - 1] if first else 0
            last = max(first + 1, min(first + max(1, cells // self.items), int(np.searchsorted(work, done + cells, "right"))))
            a, b = (ends[first - 1] if first else 0), ends[last - 1]
            times = self.count[term[a:b]]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            item = self.item[np.repeat(self.begin[term[a:b]], times) + within]
            cell = np.repeat((row[a:b] - first) * self.items, times) + item
            score = np.bincount(cell, np.repeat(value[a:b], times), minlength=(last - first) * self.items)
            yield first, score.reshape(-1, self.items)
            first = last


def _best(scored: DataFrame, items: list[list[int]], weight: np.ndarray, top: int, id_type: T.DataType) -> DataFrame:
    """Each task's ``top`` best classes an item: item number, score and members."""
    shared = scored.sparkSession.sparkContext.broadcast((items, weight))
    key = uuid.uuid4().hex
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType()),
                           T.StructField("members", T.ArrayType(id_type))])

    def order(found: tuple) -> tuple:             # by score, then smallest id, no id last
        score, members = found
        return (-score, True) if members[0] is None else (-score, False, members[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings = _cached(key, lambda: Postings(*shared.value))
        kept: list[list[tuple]] = [[] for _ in range(postings.items)]
        floor = np.ones(postings.items)           # a class below this cannot enter an item's list
        kind = None
        for batch in batches:
            members = batch.column("members")
            kind = members.type
            for first, score in postings.blocks(batch.column("m").to_numpy(), batch.column("bag").to_pylist()):
                entering = score >= floor
                for i in np.flatnonzero(entering.any(0)).tolist():
                    rows = np.flatnonzero(entering[:, i])
                    values = score[rows, i]
                    if len(rows) > top:           # with all ties of the last place
                        rows = rows[values >= np.partition(values, -top)[-top]]
                    new = [(int(score[r, i]), members[first + r].as_py()) for r in rows.tolist()]
                    kept[i] = sorted(kept[i] + new, key=order)[:top]
                    if len(kept[i]) == top:
                        floor[i] = kept[i][-1][0]
        if kind is not None:
            item, score, ids = zip(*[(i, s, m) for i, found in enumerate(kept) for s, m in found] or [(None, None, None)])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(ids, kind)],
                                             names=["item", "score", "members"])

    return scored.select("m", "bag", "members").mapInArrow(run, schema).filter("item IS NOT NULL")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item."""
    spark = docs.sparkSession
    workers_import(spark)
    schema = T.StructType([items.schema["item_id"], T.StructField("rank", T.IntegerType()),
                           docs.schema["doc_id"], T.StructField("score", T.LongType())])
    out = None
    for block in item_blocks(items, block_chars):
        vocabulary = sorted({w for _, terms in block for w in terms})
        number = {w: i for i, w in enumerate(vocabulary)}
        found = written(bags(docs, vocabulary), "bags")
        total = found.agg(F.count("*"), F.sum("n")).first()
        if not total[0]:
            continue
        held = document_counts(found, len(vocabulary))
        weight = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * d + 1))) for d in held.tolist()], np.int64)
        best = _best(classes(found, total[0], total[1], top), [[number[w] for w in terms] for _, terms in block],
                     weight, top, docs.schema["doc_id"].dataType)
        one = (best.select("item", "score", F.explode("members").alias("doc_id"))
               .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(
                   F.desc("score"), F.col("doc_id").asc_nulls_last())))
               .filter(F.col("rank") <= top))
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)],
                                      T.StructType([T.StructField("item", T.IntegerType()), items.schema["item_id"]]))
        part = one.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
