"""Language identification with a byte convolutional network, trained in numpy.

The network reads fixed windows of ``WINDOW`` bytes: byte embeddings, filters
of several widths, the maximum of each filter over the window (ReLU), and a
softmax over the languages seen in training. A text is cut into consecutive
windows that cover all of it (the last one ends with the text; a shorter text
is padded with spaces); its language is that of the mean log probability of
its windows, and its score that mean's share.

Training fits on a bounded sample (``SAMPLE_DOCS`` labelled documents in equal
shares of the languages, chosen by a hash of the id, ``SAMPLE_WINDOWS`` evenly
spaced windows of each) on the driver. Prediction covers every byte of every
document inside tasks: embeddings and filters are folded into tables for byte
pairs, so a filter bank costs one or two table lookups a byte.

Defined cases: null text or no letter: ``und`` with score 0; no labelled
training row: ``und`` for all; one language: that language; repeated rows are
predicted one by one; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import appended, pieces, texts, with_new
from .language_model import fold

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
SAMPLE_DOCS = 2_400
SAMPLE_WINDOWS = 4
EPOCHS = 8
BATCH = 64
RATE = 0.01
#: Windows that are scored at a time.
SCORED = 128
UNKNOWN = "und"


def windows(data: bytes, most: int | None = None) -> np.ndarray:
    """All windows of a text as rows of bytes, or ``most`` evenly spaced ones."""
    raw = np.frombuffer(data if len(data) >= WINDOW else data.ljust(WINDOW), np.uint8)
    n = -(-len(raw) // WINDOW)
    number = np.arange(n) if most is None or n <= most else np.unique(np.linspace(0, n - 1, most).astype(int))
    starts = np.minimum(number * WINDOW, len(raw) - WINDOW)
    return np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[starts]


class ByteNetwork:
    """Parameters, training step and folded tables."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embedding": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"filter{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)).astype(np.float32)
            self.p[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.p["out_bias"] = np.zeros(len(languages), np.float32)

    def _pooled(self, x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """(maximum, its position) of each filter of width w over windows x."""
        n = WINDOW - w + 1
        z = None
        for k in range(w):
            part = (self.p["embedding"] @ self.p[f"filter{w}"][k])[x[:, k:k + n]]
            z = part if z is None else z + part
        at = z.argmax(axis=1)
        return np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + self.p[f"bias{w}"], at

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        pooled = {w: self._pooled(x, w) for w in WIDTHS}
        hidden = np.concatenate([np.maximum(pooled[w][0], 0) for w in WIDTHS], axis=1)
        logits = hidden @ self.p["out"] + self.p["out_bias"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(len(y)), y] -= 1
        prob /= len(y)
        g = {"out": hidden.T @ prob, "out_bias": prob.sum(axis=0), "embedding": np.zeros_like(self.p["embedding"])}
        back = prob @ self.p["out"].T
        for i, w in enumerate(WIDTHS):
            value, at = pooled[w]
            d = back[:, i * FILTERS:(i + 1) * FILTERS] * (value > 0)
            g[f"bias{w}"] = d.sum(axis=0)
            g[f"filter{w}"] = np.empty_like(self.p[f"filter{w}"])
            for k in range(w):
                seen = np.take_along_axis(x, at + k, axis=1)  # the byte under place k of each filter's maximum
                g[f"filter{w}"][k] = np.einsum("bf,bfe->ef", d, self.p["embedding"][seen])
                np.add.at(g["embedding"], seen, d[:, :, None] * self.p[f"filter{w}"][k].T[None])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> "ByteNetwork":
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(p) for k, p in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            rate = RATE * (1 - epoch / epochs)
            for i in range(0, len(order), BATCH):
                step += 1
                rows = order[i:i + BATCH]
                for k, g in self.gradients(x[rows], y[rows]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


class Scorer:
    """Folded tables of a trained network for byte pairs; built once in each worker."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        p = parameters
        one = {w: [p["embedding"] @ p[f"filter{w}"][k] for k in range(w)] for w in WIDTHS}
        pair = lambda a, b: (a[None, :, :] + b[:, None, :]).reshape(1 << 16, -1)  # noqa: E731  low byte first
        self.parts = {w: [(k, pair(one[w][k], one[w][k + 1])) for k in range(0, w - 1, 2)] for w in WIDTHS}
        self.single = {w: one[w][w - 1] if w % 2 else None for w in WIDTHS}
        self.bias = np.concatenate([p[f"bias{w}"] for w in WIDTHS])
        self.out, self.out_bias = p["out"], p["out_bias"]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        logs = np.empty((len(x), len(self.out_bias)), np.float32)
        for i in range(0, len(x), SCORED):
            part = x[i:i + SCORED]
            two = part[:, :-1].astype(np.uint16) | part[:, 1:].astype(np.uint16) << 8
            pooled = []
            for w in WIDTHS:
                n = WINDOW - w + 1
                z = None
                for k, table in self.parts[w]:
                    z = table[two[:, k:k + n]] if z is None else np.add(z, table[two[:, k:k + n]], out=z)
                if self.single[w] is not None:
                    z += self.single[w][part[:, w - 1:w - 1 + n]]
                pooled.append(z.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
            z = hidden @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            logs[i:i + SCORED] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return logs


_SCORERS: dict[int, Scorer] = {}


def _scorer(shared) -> Scorer:
    key = shared.value["key"]
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(shared.value["p"])
    return _SCORERS[key]


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ByteNetwork | None:
    """Fit on a bounded sample of rows with doc_id, text and lang (the label); None without any."""
    rows = labelled.filter("lang is not null and doc_id is not null and text is not null")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # the label set
    if not languages:
        return None
    quota = max(1, sample_docs // len(languages))
    in_order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (rows.select("doc_id", "lang").withColumn("nth", F.row_number().over(in_order))
              .filter(F.col("nth") <= quota).select("doc_id").distinct())  # at most sample_docs rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, key, data in zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), texts(batch)):
                found = [w.tobytes() for w in windows(data, SAMPLE_WINDOWS)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array([lang] * len(found), pa.string()),
                                                  pa.array(found, pa.binary())], names=["key", "lang", "window"])

    sample = (rows.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("key"), "lang", "text")
              .mapInArrow(cut, "key long, lang string, window binary").collect())
    sample = sorted(set(map(tuple, sample)))  # the same order on every run
    number = {lang: i for i, lang in enumerate(languages)}
    x = np.frombuffer(b"".join(r[2] for r in sample), np.uint8).reshape(-1, WINDOW)
    return ByteNetwork(languages).fit(x, np.array([number[r[1]] for r in sample]))


def predict(docs: DataFrame, network: ByteNetwork | None, prefix: str = "") -> DataFrame:
    """All columns and lang_pred, score; only the text is read for the prediction."""
    pred, score, letter = prefix + "lang_pred", prefix + "score", "__letter"
    flagged = docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = with_new(flagged, (pred, T.StringType()), (score, T.DoubleType()))
    languages = network.languages if network else []
    key = hash(tuple(float(v.sum()) for v in network.p.values())) if network else 0
    shared = docs.sparkSession.sparkContext.broadcast({"key": key, "p": network.p if network else None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                rows = [i for i, has in enumerate(part.column(letter).to_pylist()) if has and languages]
                if rows:
                    found = texts(part)
                    cut = [windows(found[i]) for i in rows]
                    sizes = np.array([len(c) for c in cut])
                    logs = _scorer(shared).log_probabilities(np.concatenate(cut))
                    mean = np.add.reduceat(logs.astype(np.float64), np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
                    share = np.exp(mean - mean.max(axis=1, keepdims=True))
                    share /= share.sum(axis=1, keepdims=True)
                    for i, best, value in zip(rows, share.argmax(axis=1), share.max(axis=1)):
                        names[i], scores[i] = languages[best], value
                yield appended(part, schema, {pred: pa.array(names, pa.string()), score: pa.array(scores, pa.float64())})

    return flagged.mapInArrow(run, schema).drop(letter)


def training_rows(docs: DataFrame, folds: int = 4, held_fold: int = 2) -> DataFrame:
    return docs.filter(fold("doc_id", folds) != held_fold)
