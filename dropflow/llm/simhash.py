"""SimHash near-duplicates found with vantage-point trees.

A fingerprint has 64 bits, each the majority over the XXH64 values of a text's
3-word shingles. Documents whose fingerprints differ in at most ``max_bits``
bits are linked; a group is a connected component of links.

1. Fingerprints are computed from whole texts inside tasks, equal ones meet in
   one row (fingerprint, smallest doc_id), so exact copies cost one node.
2. A vantage-point tree is built on the driver from a bounded sample of
   fingerprints (``SAMPLE``): every inner node has a vantage point and a
   radius, the median distance of its sample. Its leaves are the shards.
3. Every fingerprint goes to its home leaf, and as a query to each other leaf
   (of higher number) that the triangle bound cannot exclude: with distance d
   to the vantage point, the inside (distance < r) is needed if
   d - max_bits < r, the outside if d + max_bits >= r. So every linked pair
   meets in the home leaf of one of the two.
4. A shard's task goes on with the same tree on its own rows, compares what
   reaches a leaf exactly, and returns a star forest (fingerprint, smallest
   linked fingerprint), never the pairs.
5. Stars of all shards are joined to components by alternating star
   contraction on DataFrames, cutting the lineage with checkpoints.

The sample only shapes the tree; every fingerprint is searched and no
candidate is dropped. Defined cases: null or empty text: fingerprint 0, linked
like any other; repeated rows and ids: all rows of a fingerprint are in one
group; rows without an id get their group's id; a group without any id has a
null id; empty table: empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import appended, pieces, texts, with_new
from .common import checkpoint, workers_import, written

SHINGLE = 3
MAX_BITS = 2
HASH_SEED = 42
#: Fingerprints that shape the tree; the rows of a shard aimed at; rows of a leaf that is compared directly.
SAMPLE = 16_384
SHARD_ROWS = 4_096
LEAF_ROWS = 128
#: Bytes of a text, and shingles, that are handled at a time.
TEXT_CHUNK = 4 << 20
SHINGLE_CHUNK = 1 << 16

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_lists(data: bytes, size: int = TEXT_CHUNK) -> Iterator[list[bytes]]:
    """Words of a text, cut at white space into chunks so that a very long text stays bounded."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.start() if found else len(data)
        yield data[start:end].split()
        start = end


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = HASH_SEED) -> int:
    """64-bit SimHash of a UTF-8 text."""
    counts, total, carry = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for chunk in word_lists(data.lower()):
        w = carry + chunk
        if len(w) < shingle:
            carry = w
            continue
        joined = b" ".join(w)
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        a, b = starts[: len(w) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
        for i in range(0, len(a), SHINGLE_CHUNK):
            h = np.array([digest(joined[s:e], seed) for s, e in zip(a[i:i + SHINGLE_CHUNK], b[i:i + SHINGLE_CHUNK])],
                         np.uint64)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
            total += len(h)
        carry = w[len(w) - shingle + 1:]
    if not total:
        return digest(b" ".join(carry), seed) if carry else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, name: str = "__fp") -> DataFrame:
    """Append the fingerprint as a signed long; all columns stay."""
    workers_import(docs.sparkSession)
    schema = with_new(docs, (name, T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                fps = np.array([fingerprint(t) for t in texts(part)], np.uint64).view(np.int64)
                yield appended(part, schema, {name: pa.array(fps, pa.int64())})

    return docs.mapInArrow(run, schema)


# ---- vantage-point tree -------------------------------------------------

def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _vantage(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """The vantage point of a few candidates with the widest spread, and the median radius; None if all are alike."""
    best = None
    step = max(1, len(points) // 1024)
    seen = points[::step]
    for v in points[:: max(1, len(points) // 5)][:5]:
        d = distance(seen, v)
        r = int(np.median(d))
        inside = int((d < r).sum())
        if not inside:
            r += 1
            inside = int((d < r).sum())
        if inside == len(seen):
            continue
        # how many queries both sides would see, and how uneven the sides are
        both = int(((d >= r - MAX_BITS) & (d <= r + MAX_BITS - 1)).sum())
        cost = both + abs(2 * inside - len(seen))
        if best is None or cost < best[0]:
            best = (cost, v, r)
    return best and (best[1], best[2])


def build_tree(sample: np.ndarray, leaves: int) -> list[tuple]:
    """Nodes (vantage, radius, inside, outside), or (leaf number,); node 0 is the root."""
    nodes: list[tuple] = []
    numbers = iter(range(1 << 30))

    def grow(points: np.ndarray, want: float) -> int:
        at = len(nodes)
        nodes.append(())
        split = _vantage(points) if want > 1.5 and len(points) > 8 else None
        if split is None:
            nodes[at] = (next(numbers),)
            return at
        v, r = split
        inner = distance(points, v) < r
        share = inner.mean()
        left = grow(points[inner], want * share)
        nodes[at] = (int(v), r, left, grow(points[~inner], want * (1 - share)))
        return at

    grow(sample, leaves)
    return nodes


def route(nodes: list[tuple], fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home?) of every leaf that the triangle bound leaves open for each fingerprint."""
    rows, leaves, homes = [], [], []
    stack = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        at, idx, home = stack.pop()
        if not len(idx):
            continue
        node = nodes[at]
        if len(node) == 1:
            rows.append(idx)
            leaves.append(np.full(len(idx), node[0], np.int32))
            homes.append(home)
            continue
        v, r, inside, outside = node
        d = distance(fps[idx], np.uint64(v))
        inner = d < r
        to_in, to_out = d - max_bits < r, d + max_bits >= r
        stack.append((inside, idx[to_in], (home & inner)[to_in]))
        stack.append((outside, idx[to_out], (home & ~inner)[to_out]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    row, leaf, home = np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)
    home_leaf = np.zeros(len(fps), np.int32)
    home_leaf[row[home]] = leaf[home]
    use = home | (leaf > home_leaf[row])
    return row[use], leaf[use], home[use]


# ---- inside a shard -----------------------------------------------------

class Forest:
    """Smallest-label union of numbered nodes, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = self.label[a], self.label[b]
            differ = la != lb
            if not differ.any():
                return
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            low = np.minimum(la, lb)
            np.minimum.at(self.label, la, low)
            np.minimum.at(self.label, lb, low)
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def link_shard(fps: np.ndarray, home: np.ndarray, max_bits: int) -> np.ndarray:
    """Labels (positions of the smallest member) of rows linked through a home row of this shard.

    Queries walk the tree of the home rows; what reaches a leaf is compared in blocks.
    """
    order = np.argsort(fps, kind="stable")
    fps, home = fps[order], home[order]
    forest = Forest(len(fps))
    stack = [(np.flatnonzero(home), np.arange(len(fps)))]
    while stack:
        points, queries = stack.pop()
        if not len(points) or not len(queries):
            continue
        split = _vantage(fps[points]) if len(points) > LEAF_ROWS else None
        if split is None:
            step = max(1, (1 << 21) // len(points))
            for i in range(0, len(queries), step):
                q = queries[i:i + step]
                near = distance(fps[q][:, None], fps[points][None, :]) <= max_bits
                x, y = np.nonzero(near)
                x, y = q[x], points[y]
                keep = x != y
                forest.join(x[keep], y[keep])
            continue
        v, r = split
        dp, dq = distance(fps[points], v), distance(fps[queries], v)
        stack.append((points[dp < r], queries[dq - max_bits < r]))
        stack.append((points[dp >= r], queries[dq + max_bits >= r]))
    label = np.empty(len(fps), np.int64)
    label[order] = order[forest.label]
    return label


def links(nodes: DataFrame, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS,
          sample_rows: int = SAMPLE) -> DataFrame:
    """Star forests (a, b) over a table of distinct fingerprints ``fp``: a is linked to the smaller b."""
    spark = nodes.sparkSession
    n = nodes.count()
    sample = np.array([r["fp"] for r in nodes.select("fp").orderBy(F.xxhash64("fp")).limit(sample_rows).collect()],
                      np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(build_tree(sample, max(1, min(n / shard_rows, sample_rows / 8))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column("fp")).view(np.uint64)
            row, leaf, home = route(tree.value, fps, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(fps[row].view(np.int64)),
                                              pa.array(home)], names=["leaf", "fp", "home"])

    def shard(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        label = link_shard(fps, table.column("home").to_numpy(zero_copy_only=False), max_bits)
        child = np.flatnonzero(label != np.arange(len(label)))
        a, b = fps[child].view(np.int64), fps[label[child]].view(np.int64)
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    dealt = nodes.select("fp").mapInArrow(deal, "leaf int, fp long, home boolean")
    return dealt.groupBy("leaf").applyInArrow(shard, "a long, b long")


# ---- components ---------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root the smallest node of its component.

    Alternating star contraction: every node's larger neighbours, then its smaller ones, are hung on
    the smallest. Minima are pre-aggregated, and a node with very many edges is a skewed join key that
    adaptive execution splits. Stops when a round changes nothing.
    """
    edges = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(lowest, "a")
        new = hung.select("a", F.col("m").alias("b")).union(
            hung.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = checkpoint(new)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == now:
            break
        seen = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def fingerprint_groups(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, low_id, root) of every distinct fingerprint of a materialised table (doc_id, fp).

    low_id is the fingerprint's smallest doc_id, root names its component.
    """
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("low_id")))
    labels = components(links(nodes, max_bits))
    return checkpoint(nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", "low_id", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp (signed long) and component_id of every document."""
    fps = checkpoint(with_fingerprints(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"))
    groups = fingerprint_groups(fps, max_bits)
    ids = groups.groupBy("root").agg(F.min("low_id").alias("component_id"))
    return fps.join(groups.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group: one with the smallest doc_id (ties: the smallest fingerprint); same columns."""
    rows = written(with_fingerprints(docs, "__fp"), "simhash")
    groups = fingerprint_groups(rows.select("doc_id", F.col("__fp").alias("fp")), max_bits)
    stay = (groups.groupBy("root").agg(F.min(F.struct(F.col("low_id").isNull(), "low_id", "fp")).alias("k"))
            .select(F.col("k.fp").alias("__kfp"), F.col("k.low_id").alias("__kid")))
    kept = rows.join(stay, (F.col("__fp") == F.col("__kfp")) & F.col("doc_id").eqNullSafe(F.col("__kid")))
    first = Window.partitionBy("__kfp").orderBy(F.lit(0))  # rows that repeat the kept one
    return (kept.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
