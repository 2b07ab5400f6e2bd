"""SentencePiece encoding that keeps byte offsets, and decoding.

A text is normalised by the model's own rules: at every place the longest
prefix in the compiled character map is replaced (a user symbol stands for
itself, any other character too), spaces are collapsed if the model asks for it,
one is put in front, and spaces become the mark U+2581. Every normalised byte
records the original byte its rule started at, so the pieces of the normalised
text project to byte spans of the original: a piece ends where the next starts.

The library merges the characters of a piece; its copy of the model has the
normaliser switched off. If no piece of the model holds the mark behind another
character, no merge crosses from a character to a mark, so the ids of a text are
those of its chunks (a run of marks and what follows to the next mark; a line
break or tab that is in no longer piece is a chunk of its own), and a worker
remembers the ids of up to ``REMEMBERED`` chunks. Other models encode whole texts.

Decoding joins the pieces' bytes by table lookup: marks become spaces, one space
in front goes, runs of byte pieces are read as UTF-8 (U+FFFD for each byte that
is none), control pieces are silent.

Defined cases: a null or empty text has no pieces and decodes to an empty text;
repeated rows are encoded row by row; an empty table gives an empty result; a
text of any length is one row, encoded in one task with memory in proportion to
it; other columns pass through, those of equal name are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import appended, pieces, texts, with_new
from .common import workers_import

#: Chunks whose ids a worker remembers; it starts anew when they are exceeded.
REMEMBERED = 400_000

MARK = "▁"

# Fixed values of the model file format (protocol buffer fields, piece types).
PIECE, TRAINER, NORMALIZER, DENORMALIZER = 1, 2, 3, 5
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_TYPE, WHITESPACE_AS_SUFFIX, UNK_SURFACE = 3, 24, 44
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
BPE = 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message; fixed-size values stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def character_map(compiled: bytes) -> dict[str, str]:
    """The entries of a compiled character map: a double-array trie of keys, then the replacements."""
    if not compiled:
        return {}
    size = int.from_bytes(compiled[:4], "little")
    units = np.frombuffer(compiled, "<u4", size // 4, 4).astype(np.int64)
    replacements = compiled[4 + size:]
    jump = (units >> 10) << ((units & 512) >> 6)
    label = units & 0x800000FF
    byte = np.arange(1, 256)
    found: dict[str, str] = {}
    todo = [(int(jump[0]), b"")]
    while todo:
        base, prefix = todo.pop()
        child = base ^ byte
        child = child[child < len(units)]
        for place in child[label[child] == (child ^ base)].tolist():
            key = prefix + bytes([place ^ base])
            below = place ^ int(jump[place])
            if units[place] >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                found[key.decode()] = replacements[start:replacements.index(b"\0", start)].decode()
            todo.append((below, key))
    return found


class Normaliser:
    """Longest-prefix replacement with, for each normalised byte, the original byte its rule started at."""

    def __init__(self, spec: dict, as_suffix: bool = False, symbols: tuple[str, ...] = ()) -> None:
        self.map = character_map(spec.get(CHARACTER_MAP, b""))
        self.dummy, self.remove = bool(spec.get(DUMMY_PREFIX, 1)), bool(spec.get(REMOVE_EXTRA, 1))
        self.space = MARK if spec.get(ESCAPE, 1) else " "
        self.as_suffix, self.symbols = as_suffix, symbols
        rules = sorted([*self.map, *symbols], key=len, reverse=True)
        self.lengths: dict[str, list[int]] = {}     # lengths of the rules by first character, longest first
        for rule in rules:
            sizes = self.lengths.setdefault(rule[0], [])
            if len(rule) not in sizes:
                sizes.append(len(rule))

    def _rules(self, text: str) -> Iterator[tuple[str, str]]:
        """(original, replacement) from left to right."""
        at, symbols, replace = 0, set(self.symbols), self.map
        while at < len(text):
            for size in self.lengths.get(text[at], ()):
                key = text[at:at + size]
                if len(key) == size and (key in symbols or key in replace):
                    # a user symbol goes before any rule of the map
                    whole = next((text[at:at + len(s)] for s in symbols if text.startswith(s, at)), None) if symbols else None
                    if whole is not None:
                        whole = max((s for s in symbols if text.startswith(s, at)), key=len)
                        yield whole, whole
                        at += len(whole)
                    else:
                        yield key, replace[key]
                        at += size
                    break
            else:
                yield text[at], text[at]
                at += 1

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and the original byte of each of its bytes, and of its end."""
        if not text:
            return "", np.zeros(1, np.int64)
        if not (self.lengths or self.remove or self.as_suffix):
            return self._plain(text)
        out: list[str] = []
        origin: list[int] = []
        byte = 0
        rules = self._rules(text)
        if self.remove:
            rules, lead = list(rules), 0
            while lead < len(rules) and rules[lead][1] == " ":
                byte += len(rules[lead][0].encode())
                lead += 1
            rules = rules[lead:]
            if not rules:
                return "", np.zeros(1, np.int64)

        def put(piece: str, start: int) -> None:
            piece = piece.replace(" ", self.space)
            out.append(piece)
            origin.extend([start] * len(piece.encode()))

        if self.dummy and not self.as_suffix:
            put(" ", byte)
        after_space = self.remove
        for original, piece in rules:
            if after_space:
                piece = piece.lstrip(" ")
            if piece:
                put(piece, byte)
                after_space = piece.endswith(" ")
            byte += len(original.encode())
            if not self.remove:
                after_space = False
        done = "".join(out)
        if self.remove:
            while done.endswith(self.space):
                done = done[:-len(self.space)]
                byte = origin[len(done.encode())]
                del origin[len(done.encode()):]
        if self.dummy and self.as_suffix:
            done += self.space
            origin += [byte] * len(self.space.encode())
        return done, np.array(origin + [byte])

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        """No rule but the space in front and the mark."""
        raw = np.frombuffer(text.encode(), np.uint8)
        front = self.space if self.dummy else ""
        place = np.arange(len(raw))
        lead = np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, place, 0)) if not text.isascii() else place
        wide = len(self.space.encode())
        origin = np.repeat(lead, np.where(raw == 32, wide, 1)) if wide > 1 else lead
        return (front + text.replace(" ", self.space),
                np.concatenate((np.zeros(len(front.encode()), np.int64), origin, [len(raw)])))


class PieceModel:
    """A model file: normaliser, pieces, the library's merges without its normaliser, and a decoder."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        with open(path, "rb") as f:
            data = f.read()
        specs: dict[int, dict] = {TRAINER: {}, NORMALIZER: {}, DENORMALIZER: {}}
        self.pieces: list[str] = []
        self.types: list[int] = []
        for number, value in fields(data):
            if number == PIECE:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.types.append(piece.get(3, NORMAL))
            elif number in specs:
                specs[number].update(fields(value))
        self.normalizer, trainer = specs[NORMALIZER], specs[TRAINER]
        self.unknown = trainer.get(UNK_SURFACE, " ⁇ ".encode()).decode()
        if specs[DENORMALIZER].get(CHARACTER_MAP):
            raise ValueError(f"{path}: models with a denormaliser are not supported")
        as_suffix = bool(trainer.get(WHITESPACE_AS_SUFFIX, 0))
        symbols = tuple(p for p, t in zip(self.pieces, self.types) if t == USER)
        self.normalise = Normaliser(self.normalizer, as_suffix, symbols)
        # a second normaliser message overrides single fields of the first
        off = bytes([CHARACTER_MAP << 3 | 2, 0, DUMMY_PREFIX << 3, 0, REMOVE_EXTRA << 3, 0, ESCAPE << 3, 0])
        self.library = SentencePieceProcessor(model_proto=data + bytes([NORMALIZER << 3 | 2, len(off)]) + off)
        normal = [p for p, t in zip(self.pieces, self.types) if t in (NORMAL, USER, UNUSED)]
        has_bytes = BYTE in self.types
        self.by_chunks = (trainer.get(MODEL_TYPE, 1) == BPE and has_bytes and not symbols and UNUSED not in self.types
                          and not as_suffix and not any(MARK in p.lstrip(MARK) for p in normal))
        alone = self.alone = "".join(c for c in "\t\n\r" if not any(c in p and len(p) > 1 for p in normal))
        inside = f"[^{MARK}{alone}]"
        self.chunk = re.compile(f"{MARK}+{inside}*|{inside}+" + (f"|[{alone}]" if alone else ""))
        self.known: dict[str, bytes] = {"": b""}    # (id, normalised bytes) of the pieces of a chunk
        self._table()

    def _table(self) -> None:
        """Of each id: its bytes in a text, its length in a normalised text."""
        kinds = np.array(self.types)
        self.surface = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else
                        self.unknown.encode() if t == UNKNOWN else p.replace(MARK, " ").encode()
                        for p, t in zip(self.pieces, self.types)]
        self.silent = kinds == CONTROL
        self.size = np.array([len(p.encode()) for p in self.pieces])
        self.byte = np.full(len(kinds), -1)
        for i in np.flatnonzero(kinds == BYTE):
            self.byte[i] = self.surface[i][0]

    def _sizes(self, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes each piece takes; the last byte piece of a character takes all of it."""
        size, byte = self.size[ids], self.byte[ids]
        if (byte >= 0).any():
            place = np.arange(len(ids))
            follows = (byte >= 0x80) & (byte < 0xC0)
            lead = np.maximum.accumulate(np.where(follows, 0, place))
            ends = ~np.concatenate((follows[1:], [False]))
            size = np.where(byte < 0, size, np.where(ends, place - lead + 1, 0))
        return size

    def _learn(self, chunks: list[str]) -> None:
        found = self.library.encode(chunks, num_threads=1)
        ends = list(accumulate(map(len, found)))
        ids = np.fromiter(chain.from_iterable(found), np.int32, ends[-1])
        pairs = np.stack((ids, self._sizes(ids)), 1).astype("<i4").tobytes()
        start = 0
        for chunk, end in zip(chunks, ends):
            self.known[chunk] = pairs[8 * start:8 * end]
            start = end

    def encode(self, all_texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the ids and the original byte offsets: the start of the first piece, then each piece's end."""
        normal = [self.normalise(t) for t in all_texts]
        if not self.by_chunks:
            return [self._whole(text, origin) for text, origin in normal]
        split = [self.chunks(text) for text, _ in normal]
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        new = set(chain.from_iterable(split)).difference(self.known)
        if new:
            self._learn(list(new))
        out = []
        for chunks, (_, origin) in zip(split, normal):
            pairs = np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), "<i4")
            out.append((pairs[::2], origin[np.concatenate(([0], np.cumsum(pairs[1::2])))]))
        return out

    def chunks(self, text: str) -> list[str]:
        """A normalised text cut before runs of marks and around characters that are in no longer piece."""
        if MARK * 2 in text or " " in text:
            return self.chunk.findall(text)
        text = text.replace(MARK, " " + MARK)
        for c in self.alone:
            if c in text:
                text = text.replace(c, f" {c} ")
        return text.split(" ")      # an empty chunk has no pieces

    def _whole(self, text: str, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode(text, return_type="proto").pieces
        ids = np.array([p.id for p in found], np.int32)
        return ids, origin[[0, *[p.end for p in found]]]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a list of ids."""
        out = list(map(self.surface.__getitem__, ids.tolist()))
        if self.normalizer.get(DUMMY_PREFIX, 1) or self.normalizer.get(REMOVE_EXTRA, 1):
            for place, i in enumerate(ids.tolist()):
                kind = self.types[i]
                if kind == CONTROL:
                    continue
                if kind not in (UNKNOWN, BYTE) and self.pieces[i].startswith(MARK):
                    out[place] = out[place][1:]
                    if self.normalizer.get(REMOVE_EXTRA, 1) and not out[place]:
                        continue
                break
        if not self.silent[ids].any():     # silent pieces part byte runs
            try:
                return b"".join(out).decode()
            except UnicodeDecodeError:
                pass
        return self._mended(ids, out)

    def _mended(self, ids: np.ndarray, out: list[bytes]) -> str:
        """Byte runs that are no UTF-8: U+FFFD for each byte that starts no character."""
        parts, run = [], b""
        for i, piece in zip(ids.tolist(), out):
            if self.types[i] == BYTE:
                run += piece
                continue
            parts += [_characters(run), piece.decode()]
            run = b""
        return "".join(parts) + _characters(run)


def _characters(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        size = 1 if run[at] < 0x80 else 2 if run[at] < 0xE0 else 3 if run[at] < 0xF0 else 4
        try:
            out.append(run[at:at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The model of a path, read once in each Python worker."""
    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encoded(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """All columns of the documents, ``ids`` and ``bounds``.

    Piece k covers the bytes ``bounds[k]`` to ``bounds[k + 1]`` of the original text (UTF-8).
    """
    workers_import(docs.sparkSession)
    numbers = T.ArrayType(T.IntegerType())
    schema = with_new(docs, ("ids", numbers), ("bounds", numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for part in pieces(batch, column):
                found = model.encode([t.decode("utf-8", "replace") for t in texts(part, column)])
                yield appended(part, schema, {"ids": _lists([f[0] for f in found]), "bounds": _lists([f[1] for f in found])})

    return docs.mapInArrow(run, schema)


def decoded(docs: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """All columns and the text of each list of ids (null: an empty text)."""
    workers_import(docs.sparkSession)
    schema = with_new(docs, (to, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            column = batch.column(ids)
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            found = [model.decode(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield appended(batch, schema, {to: pa.array(found, pa.string())})

    return docs.withColumn(ids, F.coalesce(F.col(ids), F.array().cast(numbers_type(docs, ids)))).mapInArrow(run, schema)


def numbers_type(docs: DataFrame, column: str) -> T.DataType:
    return docs.schema[column].dataType
