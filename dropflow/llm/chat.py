r"""Chat formatting with loss masks aligned by token offsets.

Template: ``<|turn|>role<|says|>text<|end|>`` per turn, turns in order. Inside
roles and texts a backslash is doubled and ``<|`` becomes ``<\|``, so no
control string can appear there, and reading back undoes it.

The three markers are control tokens of the tokenizer (added, not trained). A
conversation is rendered whole, encoded once with offsets, and the loss mask
is made by binary search of the sorted spans of the assistant's texts in the
sorted token offsets. Control tokens stand on both sides of a text, so spans
and tokens share their bounds.

Output: a row per conversation: conv_id, segment, part, n_turns, input_ids,
loss_starts and loss_ends (token spans under the loss). A conversation of more
than ``SEGMENT_TURNS`` turn numbers continues in further segments, and a
segment of more than ``PART_CHARS`` characters in further parts (cut between
turns), so that a conversation of any length is bounded in memory and its
segments are formatted in different tasks; no token crosses a turn, so the
parts concatenate to the whole.

Defined cases: null text or role: empty; null turn: first; equal turn numbers
are ordered by role and text; repeated rows are turns of their own; null
conv_id: one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import workers_import

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
ASSISTANT = "assistant"
SEGMENT_TURNS = 64
PART_CHARS = 1 << 22
#: Conversations that are encoded in one call of the tokenizer.
ENCODED = 128

_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the sorted spans of the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        at += len(head)
        if role == ASSISTANT:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += (head, body, END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, text = part.removesuffix(END).split(SAYS)
        turns.append((unescape(role), unescape(text)))
    return turns


def token_spans(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Token ranges [start, end) of sorted character spans, by binary search in the token offsets."""
    want = np.array(spans, np.int64).reshape(-1, 2)
    first = np.searchsorted(offsets[:, 1], want[:, 0], side="right")
    last = np.searchsorted(offsets[:, 0], want[:, 1], side="left")
    return first, np.maximum(first, last)


_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """The tokenizer with the control tokens, loaded once in each Python process."""
    if path not in _TOKENIZERS:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer, processors
        made = Tokenizer.from_file(path)
        made.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, SAYS, END)])
        made.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets that cover all of the text
        _TOKENIZERS[path] = made
    return _TOKENIZERS[path]


def format_chats(conversations: DataFrame, path: str, segment_turns: int = SEGMENT_TURNS,
                 part_chars: int = PART_CHARS) -> DataFrame:
    """The training rows of all conversations (columns conv_id, turn, role, text)."""
    workers_import(conversations.sparkSession)
    id_type = conversations.schema["conv_id"].dataType
    longs = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("conv_id", id_type), T.StructField("segment", T.LongType()),
                           T.StructField("part", T.IntegerType()), T.StructField("n_turns", T.LongType()),
                           T.StructField("input_ids", longs), T.StructField("loss_starts", longs),
                           T.StructField("loss_ends", longs)])

    def encoded(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        rendered = [render(turns) for *_, turns in rows]
        found = tokenizer(path).encode_batch([text for text, _ in rendered], add_special_tokens=False)
        ids, starts, ends = [], [], []
        for e, (_, spans) in zip(found, rendered):
            first, last = token_spans(np.array(e.offsets, np.int64).reshape(-1, 2), spans)
            ids.append(e.ids), starts.append(first.tolist()), ends.append(last.tolist())
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], key_type), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.int32()), pa.array([len(r[3]) for r in rows], pa.int64()),
             pa.array(ids, ints), pa.array(starts, ints), pa.array(ends, ints)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []  # finished pieces that wait for the tokenizer
        now: tuple | None = None
        turns: list[tuple[str, str]] = []
        part = chars = waiting = 0
        key_type = None
        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "role", "text")]
            for conv, segment, role, text in zip(*columns):
                if now is not None and ((conv, segment) != now or chars > part_chars):
                    done.append((*now, part, turns))
                    waiting += chars
                    part = part + 1 if (conv, segment) == now else 0
                    turns, chars = [], 0
                    if len(done) >= ENCODED or waiting > part_chars:
                        yield encoded(done, key_type)
                        done, waiting = [], 0
                now = (conv, segment)
                turns.append((role, text))
                chars += len(text) + len(role)
        if turns:
            done.append((*now, part, turns))
        if done:
            yield encoded(done, key_type)

    rows = conversations.select(
        "conv_id", F.floor(F.col("turn") / segment_turns).cast("long").alias("segment"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", "role", "text")
            .mapInArrow(run, schema))


def decode_chats(formatted: DataFrame, path: str) -> DataFrame:
    """Read training rows back: conv_id, segment, part, roles, texts, loss_texts (unescaped), formatted_chars."""
    id_type = formatted.schema["conv_id"].dataType
    strings = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField("conv_id", id_type), T.StructField("segment", T.LongType()),
                           T.StructField("part", T.IntegerType()), T.StructField("roles", strings),
                           T.StructField("texts", strings), T.StructField("loss_texts", strings),
                           T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(path)
        for batch in batches:
            whole, roles, texts, losses = [], [], [], []
            for ids, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("input_ids", "loss_starts", "loss_ends"))):
                text = known.decode(ids, skip_special_tokens=False)
                turns = parse(text)
                whole.append(len(text))
                roles.append([r for r, _ in turns]), texts.append([t for _, t in turns])
                losses.append([unescape(known.decode(ids[a:b], skip_special_tokens=False)) for a, b in zip(starts, ends)])
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("segment"), batch.column("part"), pa.array(roles, kind),
                 pa.array(texts, kind), pa.array(losses, kind), pa.array(whole, pa.int64())], names=schema.names)

    return formatted.mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest runs over a conversation's parts in order, as a stream that holds one part at a time.
    """
    id_type = decoded.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", id_type), T.StructField("n_turns", T.LongType()),
                           T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                           T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    names = ("conv_id", "roles", "texts", "loss_texts", "formatted_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now: list | None = None
        key_type = None
        out = lambda: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
            names=schema.names)
        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            for conv, roles, texts, losses, chars in zip(*(batch.column(c).to_pylist() for c in names)):
                if now is None or now[0] != conv:
                    if now is not None:
                        rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in zip(roles, texts):
                    now[2].update(f"{role}\n{text}\n".encode())
                for text in losses:
                    now[4].update(text.encode())
                    now[3] += len(text)
                now[1] += len(roles)
                now[5] += chars
            if rows:
                yield out()
                rows.clear()
        if now is not None:
            rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
            yield out()

    return (decoded.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "part").mapInArrow(run, schema))
