"""Token ids of a corpus in a compact binary format.

Encoding: a text's ids are those that the given tokenizer has for it. Where the
tokenizer's settings drop white space and cut words apart before it merges, a
text's ids are the ids of its white-space-separated pieces in order; each
worker encodes a piece it has not seen yet and keeps the ids, which saves most
of the work (lower-case words go straight to the merge model).
:class:`PieceEncoder` holds the exact conditions; a tokenizer of other settings
encodes whole texts.

File format (a Parquet dataset, so that any store that Spark reaches can hold
it): one row per block of consecutive documents, in ascending doc_id order.

==========  =====================================================================
shard       number of the file, ascending with doc_id
block       number of the block in its shard
first       ids before the block in its shard
doc_ids     the block's documents
lengths     ids of each document, the end id included
control     two bits an id, four ids a byte, low bits first: its bytes less one
data        the ids' frequency ranks, little-endian, 1 to 4 bytes each
==========  =====================================================================

Rank 0 is the most frequent id of the corpus (ties: the smaller id); the table
``ranks`` beside the blocks maps ranks to ids and is bounded by the
vocabulary. A reader gets a block's byte counts by one table lookup per
control byte and its ids with four masked gathers.

Defined cases: null text: the end id alone; equal doc_ids are ordered by their
ids' bytes; a null doc_id comes first; empty table: no blocks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces, texts
from .common import discard, scratch_path

END_ID = 2
#: A block ends at so many ids or documents (a longer document is a block of its own).
BLOCK_IDS = 1 << 18
BLOCK_DOCS = 4_096
#: Pieces whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 2_000_000

#: Bytes of the four ids of a control byte.
BYTES_OF = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


# ---- coding -------------------------------------------------------------

def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of an array of ranks below 2**32."""
    r = ranks.astype(np.uint32)
    if not len(r):
        return b"", b""
    code = ((r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)).astype(np.uint8)
    four = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    four[: len(r)] = code
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    ends = np.cumsum(code.astype(np.int64) + 1)
    at = ends - code - 1
    data = np.empty(int(ends[-1]), np.uint8)
    data[at] = r & 0xFF
    for k in (1, 2, 3):
        more = np.flatnonzero(code >= k)
        if not len(more):
            break
        data[at[more] + k] = r[more] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block."""
    if not n:
        return np.zeros(0, np.uint32)
    size = BYTES_OF[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# ---- encoding texts -----------------------------------------------------

_LETTERS = bytes([*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_PLAIN = bytes([9, 10, 13, *range(32, 127)]) + _LETTERS
#: Of Latin-1: p for full stop and comma, P for other marks, q for the apostrophe, a for the rest.
_KIND = bytes(ord("p") if c in b".," else ord("q") if c == 39 else
              ord("P") if 32 < c < 127 and not chr(c).isalnum() else ord("a") if c > 32 else 32 for c in range(256))


#: Byte-level tokenizers merge characters that stand for bytes: a printable Latin-1 byte for itself,
#: the others, in order, for the characters from 256 on.
_SELF = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SELF)}


#: The settings for which the ids of a text are those of its pieces.
_PIECE_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PIECE_CUTS = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def piecewise(settings: dict) -> bool:
    """Whether a tokenizer with these settings (its JSON) may encode pieces in place of whole texts."""
    model = settings["model"]
    return (settings.get("normalizer") == _PIECE_NORMALIZER and settings.get("pre_tokenizer") == _PIECE_CUTS
            and model.get("type") == "BPE" and not model.get("dropout") and not settings.get("truncation") and not settings.get("padding")
            and all(t["content"].startswith("<|") and not any(c.isspace() for c in t["content"])
                    and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in settings.get("added_tokens", [])))


class PieceEncoder:
    """Ids of whole texts as little-endian bytes, remembering the ids of pieces.

    A piece is a run without ASCII white space. The tokenizer's normaliser works on single characters
    and never joins across white space, its pre-tokenizer drops white space, and its special strings
    hold none, so the ids of a text are those of its pieces. Two steps make pieces repeat more often,
    both only for texts of plain Latin-1 letters, digits and ASCII marks: lower case first (the
    normaliser does the same to each of these characters), and, if no two marks touch and there is no
    apostrophe, full stops and commas become pieces of their own (the pre-tokenizer cuts there).
    All this holds for the settings that :func:`piecewise` tells; with others, whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.known: dict[bytes, bytes] = {}
        self.separator = self._separator()
        self.by_pieces = piecewise(json.loads(self.tokenizer.to_str()))

    def _separator(self) -> int | None:
        """The id of a control character that stands for itself alone, to encode many pieces in one call."""
        ids = self.tokenizer.encode("a \x01 b", add_special_tokens=False).ids
        return ids[1] if len(ids) == 3 else None

    @staticmethod
    def split(data: bytes) -> list[bytes]:
        text = data.decode("utf-8", "replace")
        try:
            latin = text.encode("latin-1")
        except UnicodeEncodeError:
            return data.split()
        if latin.translate(None, _PLAIN) or b"<|" in latin:
            return data.split()
        lower = text.lower().encode()
        kind = latin.translate(_KIND)
        if b"q" not in kind and not any(two in kind for two in (b"pp", b"pP", b"Pp")):
            lower = lower.replace(b".", b" . ").replace(b",", b" , ")
        return lower.split()

    def learn(self, new: list[bytes]) -> None:
        tokenize, dtype = self.tokenizer.model.tokenize, self.dtype
        rest = []
        for piece in new:
            # one lower-case Latin-1 word is one pre-token that the normaliser leaves as it is
            word = piece.decode("utf-8", "replace")
            if word.isalpha() and word.islower() and max(word) <= "\xff":
                chars = word if piece.isascii() else piece.decode("latin-1").translate(BYTE_CHARS)
                self.known[piece] = np.array([t.id for t in tokenize(chars)], dtype).tobytes()
            else:
                rest.append(piece)
        self._learn_by_text(rest)

    def _learn_by_text(self, new: list[bytes]) -> None:
        plain = [p for p in new if b"\x01" not in p] if self.separator is not None else []
        groups = [plain[i:i + 64] for i in range(0, len(plain), 64)]
        joined = [b" \x01 ".join(g).decode("utf-8", "replace") for g in groups]
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(encoded.ids, self.dtype)
            cuts = np.flatnonzero(ids == self.separator)
            if len(cuts) != len(group) - 1:
                new = new + group  # a piece that holds the separator's id itself
                continue
            raw, width = ids.tobytes(), self.dtype.itemsize
            start = 0
            for piece, cut in zip(group, [*cuts.tolist(), len(ids)]):
                self.known[piece] = raw[start * width:cut * width]
                start = cut + 1
        alone = [p for p in new if p not in self.known]
        for piece, encoded in zip(alone, self.tokenizer.encode_batch_fast(
                [p.decode("utf-8", "replace") for p in alone], add_special_tokens=False)):
            self.known[piece] = np.array(encoded.ids, self.dtype).tobytes()

    def encode(self, batch: list[bytes]) -> list[bytes]:
        if not self.by_pieces:
            encoded = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in batch], add_special_tokens=False)
            return [np.array(e.ids, self.dtype).tobytes() for e in encoded]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [self.split(t) for t in batch]
        new: set[bytes] = set()
        for s in split:
            new.update(s)
        new.difference_update(self.known)
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The tokenizer of a worker, loaded once in each Python process."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """A row (doc_id, ids as uint32 or uint16 bytes, width) per document, and rows that count ids per task."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("ids", T.BinaryType()), T.StructField("width", T.IntegerType()),
        T.StructField("counted", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])))])
    counted_type = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        counts = np.zeros(1, np.int64)
        key_type = None
        for batch in batches:
            key_type = batch.schema.field("doc_id").type
            for part in pieces(batch):
                ids = [t + end for t in enc.encode(texts(part))]
                seen = np.bincount(np.frombuffer(b"".join(ids), enc.dtype))
                if len(seen) > len(counts):
                    seen[: len(counts)] += counts
                    counts = seen
                else:
                    counts[: len(seen)] += seen
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([enc.dtype.itemsize] * n, pa.int32()),
                     pa.array([None] * n, counted_type)], names=schema.names)
        some = np.flatnonzero(counts)
        if len(some):
            pairs = [{"id": int(i), "n": int(counts[i])} for i in some]
            yield pa.RecordBatch.from_arrays([pa.array([None], key_type), pa.array([None], pa.binary()),
                                              pa.array([None], pa.int32()), pa.array([pairs], counted_type)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ---- files --------------------------------------------------------------

def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode all documents and write blocks and ranks under ``path``."""
    spark = docs.sparkSession
    scratch = scratch_path(spark, "ids")
    _encoded(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(scratch)
    encoded = spark.read.parquet(scratch)
    counts = (encoded.filter("counted is not null").select(F.explode("counted").alias("c"))
              .groupBy(F.col("c.id").alias("id")).agg(F.sum("c.n").alias("n")))
    by_rank = Window.orderBy(F.desc("n"), "id")  # a row for each id of the vocabulary
    counts.withColumn("rank", F.row_number().over(by_rank) - 1).write.parquet(f"{path}/ranks")
    ids = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    rank_of = np.zeros(max(ids, default=0) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()),
                           T.StructField("first", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)),
                           T.StructField("lengths", T.ArrayType(T.LongType())),
                           T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        parts: list[np.ndarray] = []
        held, key_type = 0, None

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held
            control, data = pack(np.concatenate(parts))
            row = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
                   pa.array([keys], pa.list_(key_type)), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                   pa.array([control], pa.binary()), pa.array([data], pa.binary())]
            block, first, held = block + 1, first + held, 0
            keys.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        for batch in batches:
            key_type = batch.schema.field("doc_id").type
            for key, raw, width in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("width").to_pylist()):
                part = ranks[np.frombuffer(raw.as_buffer(), f"<u{width}")]
                if parts and (held + len(part) > BLOCK_IDS or len(parts) >= BLOCK_DOCS):
                    yield flush()
                keys.append(key)
                parts.append(part)
                held += len(part)
        if parts:
            yield flush()

    (encoded.filter("ids is not null").select("doc_id", "ids", "width")
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
     .mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks"))
    discard(spark, scratch)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian uint32) of every document, from the files alone."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ids = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast(np.array(ids, np.uint32))
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    shards = blocks.groupBy("shard").agg(F.sum(total).alias("n"))  # a row for each file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select(F.col("shard").alias("o_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = blocks.join(F.broadcast(offsets), F.col("shard") == F.col("o_shard")).select(
        (F.col("offset") + F.col("first")).alias("start"), "doc_ids", "lengths", "control", "data")
    id_type = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = shared.value
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time
                start, lengths, control, data = (batch.column(c)[i] for c in ("start", "lengths", "control", "data"))
                lengths = np.asarray(lengths.values)
                raw = id_of[unpack(control.as_py(), data.as_py(), int(lengths.sum()))].astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(starts + start.as_py(), pa.int64()),
                     pa.array(lengths, pa.int64()),
                     pa.array([raw[4 * s:4 * e] for s, e in zip(starts.tolist(), ends.tolist())], pa.binary())],
                    names=schema.names)

    return placed.mapInArrow(run, schema)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write the token files (to a new shared scratch path unless given) and read them back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
