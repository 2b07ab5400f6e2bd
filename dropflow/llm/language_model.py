"""Hashed maximum-entropy language model with a class-factored softmax.

P(token | context) = P(class of token | context) * P(token | its class, context).

* Classes: the end of a text, the most frequent words (a class each), and
  groups of the other words by their ending. Every word has one class, so the
  product is a distribution over all words plus, in each ending group, one
  unknown word.
* P(class | context) is a softmax over sums of weights of hashed features: the
  word before (bigram), the word two before (skip), and the pair of the two
  classes before (trigram of classes).
* P(token | class, context): the class's words are the leaves of a binary tree
  (first bits of the word's hash, then its rank by count among the words that
  share them), so each word has a leaf of its own. A node's choice is a
  logistic model: the log ratio of the counts (c + 1) below its two sides, plus
  weights of (node, word before) and (node, word two before), hashed. Without
  those weights the product is (c + 1) / (class tokens + class words + 1);
  unknown words take the remaining 1 of it in every context.

How it runs: texts become blocks of token streams over a block's own
dictionary, so a word is one row a block in every shuffle however often it
occurs. Counts come from those rows over all training texts; joined back, each
block has the counts and classes of its words. Training reads every training
token once, in two rounds over halves of the blocks: a task starts from the
current weights, makes Adagrad steps on batches of tokens, and the tasks' weights
are averaged in two reduction steps, each over the tokens that touched it.
The weights of the nodes grow with the counted words: they are a table keyed by
group of nodes and chunk, and as nodes share nothing, a pass over the blocks
trains or scores one group of at most ``2 ** GROUP_BITS`` weights (mostly all).
Only the class weights, one group and the tree's top reach the driver. Scoring
reads the blocks again in batches.

Defined cases: null or empty text: the end token alone; a null doc_id counts
as the empty string for the fold (a training row); repeated rows count each;
no training text: counts and weights are zero; empty table: empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import texts
from .common import scratch_path, written
from .simhash import word_lists

#: Classes: 0 the end, then frequent words, then endings of plain and of punctuated words.
FREQUENT, ENDINGS, MARKED = 15, 24, 8
CLASSES = 1 + FREQUENT + ENDINGS + MARKED
#: Weight rows: bigram buckets, skip buckets, pairs of classes.
BUCKET_BITS = 13
BUCKETS = 1 << BUCKET_BITS
#: Bits of a class, and of a word's place in its block (beside 39 bits of block number).
CLASS_BITS, PLACE_BITS = 6, 24
WEIGHT_ROWS = 2 * BUCKETS + CLASSES * CLASSES
#: A block ends at so many tokens (a longer text is a block of its own).
BLOCK_TOKENS = 1 << 21
BATCH = 1 << 14
#: Tokens of a batch and rows of weights whose numbers fit in a core's cache, and rows that are summed without a call for each column.
PART, PIECE, SHORT = 1 << 11, 1 << 8, 8
ROUNDS = 2
RATE = 0.3
#: Rows of weights that are reduced together, and first-level groups of tasks.
CHUNK_ROWS, FIRST_LEVEL = 1 << 10, 64
END_HASH = -1
#: Words below one node of the tree's top on average, and levels below it (a word's rank there has so many bits).
SUBTREE_WORDS, DEEP = 256, 12
#: Neighbouring nodes of the top whose words are worked out in one group (bits).
SPAN_BITS = 6
#: Counted words per weight of the nodes, least and most weights of a group (bits), and training tokens per weight in a task.
WORDS_PER_WEIGHT, LEAST_BITS, GROUP_BITS, TOKENS_PER_WEIGHT = 4, 16, 22, 4
TREE_BATCH, TREE_RATE, TREE_PRIOR = 1 << 16, 0.3, 16.0
#: Log ratios of the deep nodes (the right side has the rarer words) are kept as codes of these values.
RATIOS = np.array([-4 * x - 8 * x * x for x in np.linspace(0, 1, 256)], np.float32)

_MARKS = b".,;:!?"


def fold(doc_id: str = "doc_id", folds: int = 7) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def ending_class(word: bytes) -> int:
    """The class of a word that is not among the frequent ones."""
    stem = word.rstrip(_MARKS)
    code = zlib.crc32(stem[-3:])
    return 1 + FREQUENT + (code % ENDINGS if stem == word else ENDINGS + code % MARKED)


def to_planes(ids: np.ndarray) -> bytes:
    """uint32 as four byte planes (small values compress to little)."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


# ---- blocks -------------------------------------------------------------

def blocks(docs: DataFrame) -> DataFrame:
    """Token streams: docs has doc_id, text, held_out; one row a block.

    words: 64-bit hashes of the block's words, most frequent first (the end is ``END_HASH``);
    counts: their training tokens in the block; endings: their ending classes; stream: positions in words.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)),
        T.StructField("held_out", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("stream", T.BinaryType()), T.StructField("words", T.BinaryType()),
        T.StructField("counts", T.BinaryType()), T.StructField("endings", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 16
        key_type = None
        ids = _Numbers()
        streams: list[np.ndarray] = []
        keys: list = []
        held: list[bool] = []
        lengths: list[int] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, total, ids
            stream = np.concatenate(streams)
            freq = np.bincount(stream, minlength=len(ids) + 1)
            order = np.argsort(-freq, kind="stable")
            order = order[freq[order] > 0]
            rank = np.zeros(len(freq), np.uint32)
            rank[order] = np.arange(len(order))
            train = np.repeat(~np.array(held), lengths)
            counts = np.bincount(rank[stream[train]], minlength=len(order))
            names = [b""] + list(ids)
            hashes = np.array([END_HASH if i == 0 else _signed(xxhash.xxh64_intdigest(names[i])) for i in order.tolist()], np.int64)
            endings = np.array([0 if i == 0 else ending_class(names[i]) for i in order.tolist()], np.uint8)
            row = [pa.array([number], pa.int64()), pa.array([keys], pa.list_(key_type)), pa.array([held], pa.list_(pa.bool_())),
                   pa.array([lengths], pa.list_(pa.int64())),
                   *(pa.array([x], pa.binary()) for x in (pa.compress(to_planes(rank[stream]), "zstd", asbytes=True), hashes.tobytes(),
                                                          counts.astype("<i8").tobytes(), endings.tobytes()))]
            out = pa.RecordBatch.from_arrays(row, names=schema.names)
            number, total, ids = number + 1, 0, _Numbers()
            streams.clear(), keys.clear(), held.clear(), lengths.clear()
            return out

        for batch in batches:
            key_type = batch.schema.field("doc_id").type
            for key, out_, data in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts(batch)):
                parts = []
                for chunk in word_lists(data.lower()):
                    parts.append(np.fromiter(map(ids.__getitem__, chunk), np.uint32, len(chunk)))
                parts.append(np.zeros(1, np.uint32))
                streams.extend(parts)
                n = sum(map(len, parts))
                keys.append(key), held.append(out_), lengths.append(n)
                total += n
                if total >= BLOCK_TOKENS:
                    yield flush()
        if keys:
            yield flush()

    return docs.mapInArrow(run, schema)


class _Numbers(dict):
    """Words by number from 1, in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def _signed(h: int) -> int:
    h = h - (1 << 64) if h >> 63 else h
    return h if h != END_HASH else 0


def _dictionary(blocks_: DataFrame) -> DataFrame:
    """A row for each word of each block: word, at (block and place), told (training tokens and ending class).

    Pairs of small numbers are packed into one long each, as these rows are what the shuffles carry.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = np.frombuffer(batch.column("words")[i].as_py(), "<i8")
                counts = np.frombuffer(batch.column("counts")[i].as_py(), "<i8")
                endings = np.frombuffer(batch.column("endings")[i].as_py(), np.uint8)
                at = (batch.column("block")[i].as_py() << PLACE_BITS) + np.arange(len(words), dtype=np.int64)
                told = counts << CLASS_BITS | endings
                for s in range(0, len(words), 50_000):
                    part = slice(s, s + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(words[part], pa.int64()), pa.array(at[part]), pa.array(told[part])],
                                                     names=["word", "at", "told"])

    return blocks_.select("block", "words", "counts", "endings").mapInArrow(run, "word long, at long, told long")


def _gathered(table: pa.Table) -> pa.Table:
    """The rows (block, at, told) of a block as one row of arrays in order of the places."""
    at = table.column("at").to_numpy()
    place, count = at & ((1 << PLACE_BITS) - 1), len(at)
    code, told = np.empty(count, np.int64), np.empty(count, np.int64)
    code[place], told[place] = at >> PLACE_BITS, table.column("told").to_numpy()
    rank = told >> CLASS_BITS & ((1 << DEEP) - 1)
    arrays = ((told >> (CLASS_BITS + DEEP)).tobytes(), to_planes(code), (told & ((1 << CLASS_BITS) - 1)).astype(np.uint8).tobytes(),
              to_planes(rank))
    return pa.table([table.column("block").slice(0, 1)] + [pa.array([a], pa.binary()) for a in arrays],
                    names=["block", "c", "code", "class", "rank"])


# ---- the tree of a class's words ------------------------------------------

def _log_ratios(mass: np.ndarray) -> list[np.ndarray]:
    """Per level from the root: log(mass of the right side / of the left), nan where a side is empty; mass: [.., 2 ** levels]."""
    levels = []
    while mass.shape[-1] > 1:
        left, right = mass[..., 0::2], mass[..., 1::2]
        with np.errstate(divide="ignore", invalid="ignore"):
            levels.append(np.where((left > 0) & (right > 0), np.log(right / left), np.nan).astype(np.float32))
        mass = left + right
    return levels[::-1]


def _subtree(table: pa.Table) -> pa.Table:
    """Words of one class below some nodes of the top: told with the rank by count; a node's first word has the codes of its nodes.

    Byte r of the codes belongs to the node whose right side begins at rank r. Subtrees of as many levels are worked out at once.
    """
    word, c, prefix = (table.column(k).to_numpy() for k in ("word", "c", "prefix"))
    rank, known = np.zeros(len(word), np.int64), c > 0
    order = np.lexsort((word, -c, prefix))
    order = order[known[order]]
    first = np.flatnonzero(np.diff(prefix[order], prepend=-1))
    size = np.diff(first, append=len(order))
    if size.max(initial=0) > 1 << DEEP:
        raise ValueError(f"more than {1 << DEEP} words below one node")
    rank[order] = np.arange(len(order)) - np.repeat(first, size)
    codes = np.zeros(len(order), np.uint8)
    levels = np.ceil(np.log2(size)).astype(np.int64)
    middles = (RATIOS[1:] + RATIOS[:-1])[::-1] / 2
    for deep in np.unique(levels).tolist():
        own = np.flatnonzero(levels == deep)
        nth = np.repeat(np.arange(len(own)), size[own])
        at = np.repeat(first[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(len(nth))
        place = rank[order[at]]
        mass = np.zeros((len(own), 1 << deep))
        mass[nth, place] = c[order[at]] + 1.0
        nodes = np.zeros(mass.shape, np.uint8)
        for j, ratio in enumerate(_log_ratios(mass)):
            nodes[:, (1 << deep - 1 - j)::1 << deep - j] = len(RATIOS) - 1 - np.searchsorted(middles, np.nan_to_num(ratio))
        codes[at] = nodes[nth, place]
    told = c << (CLASS_BITS + DEEP) | rank << CLASS_BITS | table.column("class").to_numpy().astype(np.int64)
    held: list[bytes | None] = [None] * len(word)
    for f, n in zip(first.tolist(), size.tolist()):
        held[order[f]] = codes[f:f + n].tobytes()
    return pa.table({"word": table.column("word"), "told": told, "class": table.column("class"), "prefix": table.column("prefix"),
                     "codes": pa.array(held, pa.binary())})


class Tree:
    """The counted choices: log ratios of the top's nodes, and the codes of a group of subtrees (of all: groups = 1)."""

    def __init__(self, top: list[np.ndarray], rows: list[tuple[int, int, bytes]], code_bits: int, group: int = 0, groups: int = 1):
        self.top, self.code_bits, self.group, self.groups = top, code_bits, group, groups
        self.sizes = np.zeros((CLASSES, 1 << len(top)), np.int32)
        self.starts = np.zeros(self.sizes.shape, np.int64)
        at = 0
        for cls, prefix, codes in rows:
            self.sizes[cls, prefix], self.starts[cls, prefix] = len(codes), at
            at += len(codes)
        self.codes = np.frombuffer(b"".join(r[2] for r in rows) or b"\0", np.uint8)

    def prefix(self, code: np.ndarray) -> np.ndarray:
        return code.astype(np.int64) >> (self.code_bits - len(self.top))

    def words(self, code: np.ndarray, classes: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Hashes of words as contexts; a counted word is told by class, prefix and rank, others by their code."""
        known = counts > 0
        own = np.where(known, self.prefix(code) << DEEP | ranks, code).astype(np.uint32)
        return _mixed(own, classes + np.where(known, np.uint32(64), np.uint32(0)))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; the list is emptied."""
    out = np.concatenate(parts)
    parts.clear()
    return out


class Choices:
    """The choices on the paths of a block's words, as flat arrays: node (hashed), side (1 right, -1 left), base (log odds of the side)."""

    def __init__(self, code, classes, counts, ranks, tree: Tree):
        levels, sizes, nodes, sides, bases = len(tree.top), [], [], [], []
        for s in range(0, len(code), 1 << 15):
            at = slice(s, s + (1 << 15))
            cls, prefix, rank = classes[at].astype(np.uint32), tree.prefix(code[at]), ranks[at].astype(np.int64)
            known = counts[at] > 0
            base = np.zeros((len(cls), levels + DEEP), np.float32)
            right, real = np.zeros(base.shape, bool), np.zeros(base.shape, bool)
            node = np.zeros(base.shape, np.uint32)
            for j in range(levels):
                above = prefix >> (levels - j)
                base[:, j], right[:, j] = tree.top[j][cls, above], prefix >> (levels - 1 - j) & 1
                real[:, j] = known & ~np.isnan(base[:, j])
                if tree.groups > 1:
                    real[:, j] &= (above * CLASSES + cls) % tree.groups == tree.group
                node[:, j] = _mixed(above.astype(np.uint32), cls * np.uint32(64) + np.uint32(j))
            size, start = tree.sizes[cls, prefix], tree.starts[cls, prefix]  # no sizes: a subtree of another group
            for j in range(DEEP):
                bit = DEEP - 1 - j
                turn = (rank >> (bit + 1) << (bit + 1)) + (1 << bit)
                w = np.flatnonzero(known & (turn < size))
                if len(w):
                    k = levels + j
                    real[w, k], base[w, k], right[w, k] = True, RATIOS[tree.codes[start[w] + turn[w]]], rank[w] >> bit & 1
                    node[w, k] = _mixed((prefix[w] << DEEP | turn[w]).astype(np.uint32), cls[w] * np.uint32(64) + np.uint32(63))
            side = np.where(right[real], np.int8(1), np.int8(-1))
            sizes.append(real.sum(axis=1, dtype=np.int32)), nodes.append(node[real]), sides.append(side), bases.append(side * base[real])
        self.sizes, self.node, self.side, self.base = (_joined(x) for x in (sizes, nodes, sides, bases))
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes

    def of(self, words: np.ndarray, before: np.ndarray, bits: int) -> tuple:
        """The choices of tokens: (number of choices of each, side, base, indices of both weights); before: hashes of both contexts."""
        size = self.sizes.take(words)
        ends = np.cumsum(size, dtype=np.intp)
        at = np.repeat(self.starts.take(words) - (ends - size), size)  # native indices: others are converted by every gather
        at += np.arange(len(at))
        node = self.node.take(at)
        index = np.empty((2, len(at)), np.uint32)
        for k in (0, 1):
            np.bitwise_xor(node, np.repeat(before[k], size), out=index[k])
        index *= np.uint32(0x9E3779B1)
        index >>= np.uint32(32 - bits)
        return size, self.side.take(at).astype(np.float32), self.base.take(at), index.astype(np.intp)


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = (x ^ y * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F)


def contexts(words: np.ndarray, stream: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the word before and of the word two before each token (0 before the start of a text); words: ``Tree.words``."""
    starts = np.cumsum(lengths) - lengths
    one, two = (_mixed(words, np.uint32([k]))[stream] for k in (1, 2))
    before = np.zeros((2, len(stream)), np.uint32)
    before[0, 1:], before[1, 2:] = one[:-1], two[:-2]
    before[0, starts] = before[1, starts] = 0
    before[1, starts[lengths > 1] + 1] = 0
    return before


def choice_odds(tree: np.ndarray, side: np.ndarray, base: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Log odds of the sides taken."""
    odds = tree.take(index[0])
    odds += tree.take(index[1])
    odds *= side
    odds += base
    return odds


def _choice_parts(tree: np.ndarray, choices: Choices, words: np.ndarray, before: np.ndarray) -> Iterator[tuple]:
    """(choices of each token, side, odds, index) of the choices of some tokens, a part that fits in a core's cache at a time."""
    bits = len(tree).bit_length() - 1
    for i in range(0, len(words), PART):
        size, side, base, index = choices.of(words[i:i + PART], before[:, i:i + PART], bits)
        yield size, side, choice_odds(tree, side, base, index), index


def train_tree(tree: np.ndarray, squares: np.ndarray, touched: np.ndarray, choices: Choices, words: np.ndarray,
               before: np.ndarray) -> None:
    """One Adagrad step on the choices of a batch of tokens, in place."""
    count, at = int(choices.sizes.take(words).sum()), 0
    miss, index = np.empty(count), np.empty((2, count), np.intp)
    for _, side, odds, i in _choice_parts(tree, choices, words, before):
        np.exp(odds, out=odds)
        odds += np.float32(1.0)
        np.divide(side, odds, out=side)
        miss[at:at + len(side)] = side
        index[:, at:at + len(side)] = i
        at += len(side)
    g = np.bincount(index[0], miss, len(tree))
    g += np.bincount(index[1], miss, len(tree))
    g = g.astype(np.float32)
    np.add(touched, np.bincount(index.reshape(-1), minlength=len(tree)), out=touched, casting="unsafe")
    scale = g * g
    squares += scale
    np.add(squares, np.float32(TREE_PRIOR), out=scale)
    np.sqrt(scale, out=scale)
    g *= np.float32(TREE_RATE)
    g /= scale
    tree += g


def tree_logs(tree: np.ndarray, choices: Choices, words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sum of the log probabilities of each token's choices (natural logarithm)."""
    out, total, at = np.empty(len(words)), 0.0, 0
    for size, _, odds, _ in _choice_parts(tree, choices, words, before):
        np.negative(odds, out=odds)
        np.exp(odds, out=odds)
        np.log1p(odds, out=odds)
        logs = np.empty(len(odds) + 1)                        # running sums go on from the part before
        logs[0] = total
        np.negative(odds, out=logs[1:])
        np.cumsum(logs, out=logs)
        ends = np.cumsum(size)
        out[at:at + len(size)] = logs[ends] - logs[ends - size]
        total, at = logs[-1], at + len(size)
    return out


# ---- the model ----------------------------------------------------------

def features(buckets: np.ndarray, classes: np.ndarray, stream: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of weights of each token, its class); no context crosses the start of a text."""
    cls = classes[stream].astype(np.int32)
    starts = np.cumsum(lengths) - lengths
    b, rows = buckets[stream].astype(np.int32), np.zeros((3, len(stream)), np.uint16)
    b1, b2 = np.zeros(len(b), np.int32), np.zeros(len(b), np.int32)
    c1, c2 = np.zeros(len(b), np.int32), np.zeros(len(b), np.int32)
    b1[1:], c1[1:] = b[:-1], cls[:-1]
    b2[2:], c2[2:] = b[:-2], cls[:-2]
    b1[starts] = c1[starts] = 0  # the end of nothing stands before a text
    second = starts[lengths > 1] + 1
    for at in (starts, second):
        b2[at] = c2[at] = 0
    rows[0], rows[1], rows[2] = b1, BUCKETS + b2, 2 * BUCKETS + c1 * CLASSES + c2
    return rows, cls


def _class_parts(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of weights less the greatest, logarithm of the sum of their powers), whose difference is log P(class)."""
    z = weights.take(rows[0], axis=0)
    z += weights.take(rows[1], axis=0)
    z += weights.take(rows[2], axis=0)
    z -= z.T.copy().max(axis=0)[:, None]                      # column after column, without a call a row
    return z, np.log(np.exp(z).sum(axis=1, keepdims=True))


def class_logs(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """log P(class) for a batch of tokens (natural logarithm)."""
    z, total = _class_parts(weights, rows)
    z -= total
    return z


def own_class_logs(weights: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log P(class) of each token's own class, a part of the tokens that fits in a core's cache at a time."""
    out = np.empty(len(cls), np.float32)
    for i in range(0, len(cls), PART):
        c = cls[i:i + PART]
        z, total = _class_parts(weights, rows[:, i:i + PART])
        out[i:i + PART] = z[np.arange(len(c)), c] - total[:, 0]
    return out


def segment_sums(g: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``np.add.reduceat(g[order], first, axis=0)``, to the last bit, without a call a segment and column for short segments."""
    size = np.diff(first, append=len(order))
    out = g.take(order[first], axis=0)
    long = size > SHORT
    if long.any():
        begin = np.cumsum(size[long]) - size[long]
        out[long] = np.add.reduceat(g.take(order[np.repeat(long, size)], axis=0), begin, axis=0)
    short = np.flatnonzero((size > 1) & ~long)
    short = short[np.argsort(-size[short], kind="stable")]
    for i in range(0, len(short), PIECE):
        own = short[i:i + PIECE]
        at, n = first[own], size[own]
        rest = g.take(order[at + 1], axis=0)              # the first row is added to the sum of the others, as reduceat does
        for j in range(2, n[0]):
            m = np.count_nonzero(n > j)
            rest[:m] += g.take(order[at[:m] + j], axis=0)
        rest += out.take(own, axis=0)
        whole_rows(out)[own] = whole_rows(rest)
    return out


def whole_rows(a: np.ndarray) -> np.ndarray:
    """The rows of a matrix as one item each, which are set at once instead of a number at a time."""
    return a.view(np.dtype((np.void, a.shape[1] * a.itemsize)))[:, 0]


def train_on(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> None:
    """One Adagrad step on a batch of tokens, in place."""
    g = np.empty((len(cls), weights.shape[1]), weights.dtype)
    for i in range(0, len(cls), PART):
        np.exp(class_logs(weights, rows[:, i:i + PART]), out=g[i:i + PART])
    g[np.arange(len(cls)), cls] -= 1.0
    for r in rows:
        order = np.argsort(r, kind="stable")  # radix sort of 16-bit rows
        sorted_ = r[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        touched = sorted_[first].astype(np.intp)
        step = segment_sums(g, order, first)
        for i in range(0, len(touched), PIECE):
            at, own = touched[i:i + PIECE], step[i:i + PIECE]
            sums = squares.take(at, axis=0)
            sums += own * own
            whole_rows(squares)[at] = whole_rows(sums)
            sums += sums.dtype.type(1e-6)
            own *= own.dtype.type(RATE)
            own /= np.sqrt(sums, out=sums)
            moved = weights.take(at, axis=0)
            moved -= own
            whole_rows(weights)[at] = whole_rows(moved)


def _packed(part: np.ndarray, touched: np.ndarray) -> tuple[bytes, bytes]:
    """Weights as 16-bit floats; tokens that touched each row as 8 log2(n + 1) in a byte."""
    return part.astype("<f2").tobytes(), np.rint(8 * np.log2(touched + 1.0)).clip(0, 255).astype(np.uint8).tobytes()


def _averaged(table: pa.Table) -> pa.Table:
    """The average of parts of weights, each row over the tokens that touched it (untouched rows stay)."""
    total = kept = tokens = None
    for part, n in zip(table.column("part"), table.column("touched")):
        n = np.exp2(np.frombuffer(n.as_py(), np.uint8) / 8.0) - 1.0
        part = np.frombuffer(part.as_py(), "<f2").reshape(len(n), -1).astype(np.float64)
        if total is None:
            total, kept, tokens = np.zeros_like(part), part, np.zeros(len(n))
        total += part * n[:, None]
        tokens += n
    mean = np.where(tokens[:, None] > 0, total / np.maximum(tokens, 1e-9)[:, None], kept)
    part, n = _packed(mean, tokens)
    first = table.slice(0, 1)
    return pa.table({"chunk": first.column("chunk"), "salt": first.column("salt"), "part": pa.array([part], pa.binary()),
                     "touched": pa.array([n], pa.binary())})


def _trained(resolved: DataFrame, weights: np.ndarray | None, tree: np.ndarray, counted: Tree) -> DataFrame:
    """One round on a group of nodes (and the class weights, if given): local steps on every block, then the averages.

    Returns (chunk, salt, part, touched); chunks of class weights count from 0, those of the nodes from -1 down.
    """
    shared = resolved.sparkSession.sparkContext.broadcast((weights, tree, counted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t, counted = shared.value
        t = t.copy()
        t_sq, t_n = np.zeros_like(t), np.zeros(len(t), np.uint32)
        if w is not None:
            w, sq, w_n = w.copy(), np.zeros_like(w), np.zeros(len(w), np.int64)
        tokens = 0
        for code, classes, counts, ranks, stream, lengths, held, _ in _opened(batches):
            train = np.flatnonzero(np.repeat(~held, lengths))
            if w is not None:
                rows, cls = features((code & np.uint32(BUCKETS - 1)).astype(np.uint16), classes, stream, lengths)
                for i in range(0, len(train), BATCH):
                    k = train[i:i + BATCH]
                    train_on(w, sq, rows[:, k], cls[k])
                    w_n += np.bincount(rows[:, k].ravel(), minlength=len(w))
                del rows, cls  # the choices take their place in memory
            choices = Choices(code, classes, counts, ranks, counted)
            before = contexts(counted.words(code, classes, counts, ranks), stream, lengths)
            for i in range(0, len(train), TREE_BATCH):
                k = train[i:i + TREE_BATCH]
                train_tree(t, t_sq, t_n, choices, stream[k], before[:, k])
            tokens += len(train)
        if tokens:
            salt = TaskContext.get().partitionId() % FIRST_LEVEL
            parts = [] if w is None else [(i, w[s:s + CHUNK_ROWS], w_n[s:s + CHUNK_ROWS])
                                          for i, s in enumerate(range(0, WEIGHT_ROWS, CHUNK_ROWS))]
            size = CHUNK_ROWS * CLASSES
            parts += [(-1 - i, t[s:s + size], t_n[s:s + size]) for i, s in enumerate(range(0, len(t), size))]
            for chunk, part, n in parts:
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([salt], pa.int32()),
                                                  *(pa.array([x], pa.binary()) for x in _packed(part, n))],
                                                 names=["chunk", "salt", "part", "touched"])

    kinds = "chunk int, salt int, part binary, touched binary"
    return (resolved.mapInArrow(run, kinds).groupBy("chunk", "salt").applyInArrow(_averaged, kinds)
            .groupBy("chunk").applyInArrow(_averaged, kinds))


@contextmanager
def _single_rows(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of one row while a job runs: a block is megabytes, and a task may read many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _weights(table: DataFrame | None, bits: int, group: int, with_classes: bool) -> tuple[np.ndarray | None, np.ndarray]:
    """(class weights, weights of a group of nodes) from the table of weights; zeros before the first round."""
    weights, tree = np.zeros((WEIGHT_ROWS, CLASSES), np.float32), np.zeros(1 << bits, np.float32)
    wanted = F.col("chunk") < 0 if not with_classes else F.lit(True)
    for r in table.filter((F.col("group") == group) & wanted).select("chunk", "part").collect() if table is not None else []:
        part, k = np.frombuffer(r["part"], "<f2").astype(np.float32), r["chunk"]
        if k >= 0:
            weights[k * CHUNK_ROWS:][:CHUNK_ROWS] = part.reshape(-1, CLASSES)
        else:
            tree[(-1 - k) * CHUNK_ROWS * CLASSES:][:len(part)] = part
    return weights if with_classes else None, tree


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Arrays of each resolved block: codes, classes, counts, ranks, stream, lengths, held_out, doc_ids."""
    for batch in batches:
        for i in range(batch.num_rows):
            raw = {c: batch.column(c)[i].as_py() for c in ("code", "class", "c", "rank", "stream")}
            lengths = np.asarray(batch.column("lengths")[i].values)
            yield (from_planes(raw["code"]), np.frombuffer(raw["class"], np.uint8), np.frombuffer(raw["c"], "<i8"),
                   from_planes(raw["rank"]),
                   from_planes(pa.decompress(raw["stream"], int(lengths.sum()) * 4, "zstd", asbytes=True)), lengths,
                   np.asarray(batch.column("held_out")[i].values.to_numpy(zero_copy_only=False), bool),
                   batch.column("doc_ids")[i].values)


def score(docs: DataFrame, folds: int = 7, held_fold: int = 2, word_contexts: bool = True, group_bits: int = GROUP_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Without ``word_contexts`` the nodes' weights stay zero: P(token | class) sees no context.
    """
    spark = docs.sparkSession
    flagged = docs.select("doc_id", "text", (fold("doc_id", folds) == held_fold).alias("held_out"))
    made = written(blocks(flagged), "lm-blocks")
    dictionary = _dictionary(made)
    mask = F.lit((1 << CLASS_BITS) - 1).cast("long")
    # a word has one ending class, so the packed numbers add up: its tokens above, the class from any row
    counted = written(dictionary.select("word", "told").groupBy("word").agg(
        F.sum(F.shiftright("told", CLASS_BITS)).alias("c"), F.min(F.col("told").bitwiseAND(mask)).alias("ending")), "lm-counted")
    known = counted.filter("c > 0")
    top = [r["word"] for r in known.filter(F.col("word") != END_HASH).orderBy(F.desc("c"), "word").limit(FREQUENT).collect()]
    cls = F.when(F.col("word") == END_HASH, F.lit(0))
    for i, w in enumerate(top):
        cls = cls.when(F.col("word") == w, F.lit(1 + i))
    classed = counted.select("word", "c", cls.otherwise(F.col("ending")).alias("class"))
    totals = classed.filter("c > 0").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in totals:
        class_n[r["class"]], class_v[r["class"]] = r["n"], r["v"]
    n_train, n_words = int(class_n.sum()), int(class_v.sum())
    # the words of a class as a tree: so many first bits of the hash that a node of the top has SUBTREE_WORDS words
    top_bits = max(0, int(np.ceil(np.log2(max(1, class_v.max()) / SUBTREE_WORDS))))
    code_bits = max(BUCKET_BITS, top_bits)
    code = F.shiftright("word", 20).bitwiseAND(F.lit((1 << code_bits) - 1).cast("long"))
    classed = classed.withColumn("prefix", F.shiftright(code, code_bits - top_bits))
    mass = np.zeros((CLASSES, 1 << top_bits))
    for r in classed.filter("c > 0").groupBy("class", "prefix").agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[r["class"], r["prefix"]] = r["m"]
    top = _log_ratios(mass)
    # the counts and paths of a block's words go back to the block: a row for each word of each block
    told = written(classed.withColumn("span", F.shiftright("prefix", SPAN_BITS)).groupBy("class", "span").applyInArrow(
        _subtree, "word long, told long, class long, prefix long, codes binary"), "lm-told")
    at = F.shiftleft(code, PLACE_BITS).bitwiseOR(F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")))
    found = (dictionary.select("word", "at").join(told.select("word", "told"), "word")
             .select(F.shiftright("at", PLACE_BITS).alias("block"), at.alias("at"), "told")
             .groupBy("block").applyInArrow(_gathered, "block long, c binary, code binary, class binary, rank binary"))
    resolved = made.select("block", "doc_ids", "held_out", "lengths", "stream").join(found, "block")
    path = scratch_path(spark, "lm-resolved")
    resolved.write.option("compression", "zstd").parquet(path)
    resolved = spark.read.schema(resolved.schema).parquet(path)
    bits = max(LEAST_BITS, int(np.ceil(np.log2(max(1, n_words) / WORDS_PER_WEIGHT))))
    groups, bits = 1 << max(0, bits - group_bits), min(bits, group_bits)

    def of_group(g: int) -> Tree:
        mine = told.filter("codes is not null").filter((F.col("prefix") * CLASSES + F.col("class")) % groups == g)
        return Tree(top, [tuple(r) for r in mine.select("class", "prefix", "codes").collect()], code_bits, g, groups)

    table = None
    for r in range(ROUNDS if n_train else 0):
        part = resolved.filter(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == r)
        part = part.coalesce(max(1, n_train // ROUNDS // (TOKENS_PER_WEIGHT << bits)))
        after = None
        for g in range(groups):
            weights, tree = _weights(table, bits, g, g == 0)
            with _single_rows(spark):
                done = written(_trained(part, weights, tree, of_group(g)).withColumn("group", F.lit(g)), "lm-weights")
            after = done if after is None else after.unionByName(done)
        # a round without a token of the table leaves the weights as they were
        table = after if table is None or after.limit(1).count() else table
    return _scored(resolved, table, bits, groups, of_group, class_n, class_v, n_train, n_words, word_contexts)


def _scored(resolved: DataFrame, table: DataFrame | None, bits: int, groups: int, tree_of: Callable[[int], Tree], class_n: np.ndarray,
            class_v: np.ndarray, n_train: int, n_words: int, word_contexts: bool) -> DataFrame:
    id_type = resolved.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("nth", T.LongType()),
                           T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()),
                           *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
                           *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])

    def of_group(group: int) -> DataFrame:
        weights, tree = _weights(table, bits, group, group == 0)
        shared = resolved.sparkSession.sparkContext.broadcast((weights, tree if word_contexts else np.zeros_like(tree), tree_of(group)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, t, counted = shared.value
            for number, opened in _numbered(batches):
                code, classes, counts, ranks, stream, lengths, held, doc_ids = opened
                base = np.log10((counts + 1.0) / (n_train + 1.0 * (n_words + 1)))
                in_class = (class_n + class_v)[classes]
                inside = np.where(counts > 0, in_class, 1.0) / (in_class + 1.0)
                logs = np.log(inside)[stream] if w is not None else np.zeros(len(stream))
                if w is not None:
                    rows, cls = features((code & np.uint32(BUCKETS - 1)).astype(np.uint16), classes, stream, lengths)
                    for i in range(0, len(stream), BATCH):
                        logs[i:i + BATCH] += own_class_logs(w, rows[:, i:i + BATCH], cls[i:i + BATCH])
                    del rows, cls
                choices = Choices(code, classes, counts, ranks, counted)
                before = contexts(counted.words(code, classes, counts, ranks), stream, lengths)
                for i in range(0, len(stream), TREE_BATCH):
                    logs[i:i + TREE_BATCH] += tree_logs(t, choices, stream[i:i + TREE_BATCH], before[:, i:i + TREE_BATCH])
                starts = np.cumsum(lengths) - lengths
                add = lambda x: np.add.reduceat(x, starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(lengths), number)), pa.array(np.arange(len(lengths))), doc_ids, pa.array(held),
                     pa.array(lengths, pa.int64()), pa.array(add((counts > 0)[stream].astype(np.int64))),
                     pa.array(np.full(len(lengths), n_train), pa.int64()), pa.array(add(base[stream])),
                     pa.array(add(logs / np.log(10.0)))], names=schema.names)

        return resolved.mapInArrow(run, schema)

    out = of_group(0)
    if groups > 1:  # every group has its part of a document's score
        for g in range(1, groups):
            out = out.unionByName(of_group(g))
        same = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
        out = out.groupBy("block", "nth").agg(*(F.first(c).alias(c) for c in same), F.sum("score").alias("score"))
    return out.drop("block", "nth")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            yield one.column("block")[0].as_py(), next(_opened(iter([one])))
