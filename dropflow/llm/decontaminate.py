"""Benchmark decontamination with one Aho-Corasick automaton.

Items (questions and answers) are normalised to lower-case words
``[0-9a-z and non-ASCII]+`` joined by single spaces; a window is ``WINDOW``
consecutive words of an item, a shorter item is one window. All windows form
one automaton, framed by spaces so that only whole words match. Every text is
normalised the same way and scanned once; the ends of matches give the hit
words, and word bounds map them back to code points of the original text.

Items are the stated query set. They come to the driver in blocks of at most
``BLOCK_CHARS`` characters of windows (a single larger item is a block of its
own); one block is one broadcast and one scan, and further blocks scan the
texts again, adding to the hits found so far. So the automaton in a task's
memory is bounded while no item is dropped.

Defined cases: null or empty texts and items have no words, so they hit
nothing; repeated items count once by item_id; an item without an id still
marks words but is not named; repeated documents are judged row by row; empty
tables give empty results or no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import appended, texts, with_new
from .common import workers_import, written

WINDOW = 10
BLOCK_CHARS = 4_000_000

#: Byte classes: A-Z to a-z, other ASCII that is not a letter or digit to a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def item_words(data: bytes) -> list[bytes]:
    return data.translate(NORMAL).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """The windows of an item, framed by spaces."""
    if not words:
        return []
    n = max(1, len(words) - size + 1)
    return [b" " + b" ".join(words[i:i + size]) + b" " for i in range(n)]


def item_blocks(benchmark: DataFrame, size: int, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of bounded window text, one partition of the table at a time."""
    block, chars = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit(""))).toLocalIterator()
    for item, text in rows:
        n = len(text) * size
        if block and chars + n > limit:
            yield block
            block, chars = [], 0
        block.append((item, text))
        chars += n
    if block:
        yield block


def automaton(items: list[tuple[str | None, str]], size: int) -> ahocorasick.Automaton | None:
    """Windows of all items; the value of a window is (its words, the ids of its items)."""
    found: dict[bytes, tuple[int, set]] = {}
    for item, text in items:
        words = item_words(text.encode())
        for w in windows(words, size):
            found.setdefault(w, (min(size, len(words)), set()))[1].add(item)
    if not found:
        return None
    built = ahocorasick.Automaton()
    for w, (n, ids) in found.items():
        # one character a byte, so that positions are byte positions
        built.add_word(w.decode("latin-1"), (n, tuple(i for i in ids if i is not None)))
    built.make_automaton()
    return built


def hits(built: ahocorasick.Automaton | None, data: bytes) -> tuple[int, np.ndarray | None, set]:
    """Words of a text, for a text with hits the mask of its hit words, and the items found."""
    words = item_words(data)
    if built is None or not words:
        return len(words), None, set()
    line = b" " + b" ".join(words) + b" "
    ends, sizes, items = [], [], set()
    for end, (n, ids) in built.iter(line.decode("latin-1")):
        ends.append(end)
        sizes.append(n)
        items.update(ids)
    if not ends:
        return len(words), None, items
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    last = np.searchsorted(spaces, np.array(ends))  # the window's last word is number last - 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, last - np.array(sizes), 1)
    np.add.at(edge, last, -1)
    return len(words), np.cumsum(edge[:-1]) > 0, items


def original_spans(data: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code point spans [start, end) of the original text."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], np.frombuffer(data.translate(NORMAL), np.uint8) != 32, [False]))
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before a byte
    framed = np.concatenate(([False], hit, [False]))
    first, last = np.flatnonzero(framed[1:] & ~framed[:-1]), np.flatnonzero(~framed[1:] & framed[:-1]) - 1
    return [{"start": int(at[starts[a]]), "end": int(at[ends[b]])} for a, b in zip(first, last)]


_BUILT: dict[str, ahocorasick.Automaton | None] = {}


def _cached(key: str, items: list, size: int) -> ahocorasick.Automaton | None:
    """The automaton of a block, built once in each Python worker; only the last one is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = automaton(items, size)
    return _BUILT[key]


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_chars: int = BLOCK_CHARS,
         prefix: str = "") -> DataFrame:
    """All columns of the documents and n_words, n_hit, items (sorted ids), spans (in code points)."""
    workers_import(docs.sparkSession)
    names = [prefix + x for x in ("n_words", "n_hit", "items", "spans")]
    mask = "__hit_mask"
    out = docs
    blocks = item_blocks(benchmark, size, block_chars)
    block = next(blocks, [])
    first = True
    while first or block:
        following = next(blocks, [])
        if not first:
            out = written(out, "decontaminate")  # the next block reads the hits so far
        out = _scan_block(out, block, size, names, mask, first)
        block, first = following, False
    return out.drop(mask)


def _scan_block(docs: DataFrame, items: list, size: int, names: list[str], mask: str, first: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    key = uuid.uuid4().hex
    types = (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), SPANS)
    schema = with_new(docs, *zip(names, types), (mask, T.BinaryType()))
    arrow = (pa.int64(), pa.int64(), pa.list_(pa.string()),
             pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _cached(key, shared.value, size)
        for batch in batches:
            n = batch.num_rows
            before = [None] * n if first else batch.column(mask).to_pylist()
            named = [()] * n if first else batch.column(names[2]).to_pylist()
            cols: list[list] = [[], [], [], [], []]
            for data, old, ids in zip(texts(batch), before, named):
                words, hit, items_found = hits(built, data)
                if old is not None:
                    old = np.unpackbits(np.frombuffer(old, np.uint8), count=words).astype(bool)
                    hit = old if hit is None else hit | old
                row = (words, int(hit.sum()) if hit is not None else 0, sorted(items_found | set(ids)),
                       original_spans(data, hit) if hit is not None else [],
                       np.packbits(hit).tobytes() if hit is not None else None)
                for c, v in zip(cols, row):
                    c.append(v)
            yield appended(batch, schema, {k: pa.array(c, t) for k, c, t in zip((*names, mask), cols, arrow)})

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit word, same columns."""
    return (scan(docs, benchmark, prefix="__").filter("__n_hit = 0")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
