"""Periodic runs of words, by a suffix automaton with link-cut access.

A *run* is a stretch of words with smallest period q, at least twice q long
(and at least ``min_words``), that no neighbouring word extends.

Words are appended to a suffix automaton one by one. Its suffix links form a
tree; the states on the path from the root to the newest state are all suffixes
of the words so far. A link-cut tree keeps for each state where it last ended:
an access recolours the path of the newest state, which meets the segments of
equal colour on it, deepest state first. A segment of colour j whose deepest
state has length L says that the last L words, and no later ones, also ended at
j. With q = i - j <= L that is a square of period q ending at word i; L reaches
as far to the left as the period does, and i moves on with the run, so the
pairs (start, q) with their last i are exactly the runs. (A smaller period
of the same words would have ended the suffix later than j, so q is smallest.)

Only stretches that can hold a run are appended. With k = min_words // 2, every
word of a run lies in a group of k words that occurs twice within that run, so
words outside repeated groups part the text, and the groups that repeat are
looked for again within each part until nothing changes. This drops no run:
parts are compared by hash, and a collision only keeps words.

Work inside a task is bounded by one text: memory grows with its longest part,
time with n log n. Defined cases: a null or empty text has no words and no run;
repeated rows are judged row by row; an empty table gives an empty result; all
other columns pass through, those of equal name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import appended, pieces, texts, with_new
from .common import workers_import

MIN_WORDS = 12

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Repetitions:
    """A suffix automaton whose suffix-link tree is held as link-cut paths of equal last end.

    State 0 is the root of the automaton and "none" in the trees. A path is a
    splay tree ordered by depth; its colour (the last end) is kept at the
    splay root, whose ``up`` is the state the path hangs from.
    """

    def __init__(self) -> None:
        self.length, self.link, self.following = [0], [-1], [{}]
        self.left, self.right, self.up, self.colour = [0], [0], [0], [-1]
        self.last, self.words = 0, 0
        self.squares: dict[tuple[int, int], int] = {}  # (start, period) -> last word

    def _state(self, length: int, link: int, following: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.following.append(following)
        self.left.append(0)
        self.right.append(0)
        self.up.append(link)
        self.colour.append(-1)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        """Make x the root of its path's tree; the colour moves with the root."""
        left, right, up, colour = self.left, self.right, self.up, self.colour
        y = up[x]
        while y and (left[y] == x or right[y] == x):
            z = up[y]
            top = y
            if z and (left[z] == y or right[z] == y):
                top = z
                if (left[z] == y) == (left[y] == x):
                    self._rotate(y)
                else:
                    self._rotate(x)
            self._rotate(x)
            colour[x] = colour[top]
            y = up[x]

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b:
            up[b] = y
        up[y] = x
        up[x] = z
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def append(self, word: int) -> None:
        length, link, following = self.length, self.link, self.following
        i = self.words
        self.words = i + 1
        p = self.last
        own: dict = {}
        while p >= 0 and word not in following[p]:
            following[p][word] = len(length)
            p = link[p]
        if p < 0:
            new = self._state(i + 1, 0, own)
        else:
            q = following[p][word]
            if length[q] == length[p] + 1:
                new = self._state(i + 1, q, own)
            else:
                new = self._state(i + 1, 0, own)
                copy = self._split(p, q, word)
                link[new] = self.up[new] = copy
        self.last = new
        self._access(new, i)

    def _split(self, p: int, q: int, word: int) -> int:
        """Put a copy of q for its shorter suffixes right above it, on the same path."""
        link, following, left, up = self.link, self.following, self.left, self.up
        copy = self._state(self.length[p] + 1, link[q], following[q].copy())
        while p >= 0 and following[p].get(word) == q:
            following[p][word] = copy
            p = link[p]
        link[q] = copy
        self._splay(q)
        above = left[copy] = left[q]
        if above:
            up[above] = copy
        left[q] = copy
        up[copy] = q
        return copy

    def _access(self, new: int, i: int) -> None:
        """Recolour the path of the newest state to i and note the squares that end here."""
        left, right, up, colour, length = self.left, self.right, self.up, self.colour, self.length
        below, v = new, up[new]
        while v:
            y = up[v]
            if y and (left[y] == v or right[y] == v):
                self._splay(v)
            j = colour[v]
            period, reach = i - j, length[v]
            if period <= reach:
                self.squares[j - reach + 1, period] = i
            deeper = right[v]
            if deeper:
                colour[deeper] = j
            right[v] = below
            below, v = v, up[v]
        colour[below] = i


def squares_to_runs(squares: dict[tuple[int, int], int], offset: int, min_words: int) -> list[tuple[int, int, int]]:
    return [(offset + start, end - start + 1, period) for (start, period), end in squares.items()
            if end - start + 1 >= min_words]


def candidate_parts(ids: np.ndarray, texts_of: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Bounds [a, b) of the parts of numbered words that can hold runs; no part crosses texts.

    ``ids`` are word numbers, ``texts_of`` the number of each word's text.
    """
    k = max(min_words // 2, 1)
    at = np.arange(len(ids))          # places of the words still in a part
    part = texts_of                   # the part of each
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    while len(at) >= min_words:
        n = len(at) - k + 1
        gram = np.zeros(n, np.uint64)
        for d in range(k):
            gram = gram * np.uint64(0xD6E8FEB86659FD93) + mixed[at[d:d + n]]
        whole = np.flatnonzero(part[:n] == part[k - 1:])
        if not len(whole):
            return []
        gram = (gram[whole] ^ (part[whole].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        gram ^= gram >> np.uint64(31)
        order = np.argsort(gram)
        same = gram[order][1:] == gram[order][:-1]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        edge = np.zeros(len(at) + 1, np.int64)
        first = whole[order[twice]]
        edge[first] = 1
        edge[:len(at)] -= np.concatenate((np.zeros(k, np.int64), edge[:len(at) - k]))
        kept = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if not len(kept):
            return []
        # a part ends where words were left out or an older part ended
        parted = np.concatenate(([True], (at[kept][1:] != at[kept][:-1] + 1) | (part[kept][1:] != part[kept][:-1])))
        number = np.cumsum(parted) - 1
        big = np.bincount(number)[number] >= min_words
        done = len(kept) == len(at) and big.all()
        at, part = at[kept][big], number[big]
        if done:
            break
    if len(at) < min_words:
        return []
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    ends = np.concatenate((starts[1:], [len(part)]))
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(starts, ends)]


def text_runs(all_words: list[list[bytes]], min_words: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in all_words]
    flat = [w for words in all_words for w in words]
    if len(flat) < min_words:
        return found
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    sizes = np.array([len(words) for words in all_words])
    begin = np.cumsum(sizes) - sizes
    texts_of = np.repeat(np.arange(len(all_words)), sizes)
    for a, b in candidate_parts(ids, texts_of, min_words):
        automaton = Repetitions()
        for word in ids[a:b].tolist():
            automaton.append(word)
        text = texts_of[a]
        found[text] += squares_to_runs(automaton.squares, int(a - begin[text]), min_words)
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside the repeats of runs (all but the first period of each), joined by spaces."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, column: str = "text") -> DataFrame:
    """All columns of the documents, n_words, runs and the collapsed text."""
    workers_import(docs.sparkSession)
    schema = with_new(docs, ("n_words", T.LongType()), ("runs", RUNS), ("collapsed", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column):
                words = [t.split() for t in texts(part, column)]
                runs = text_runs(words, min_words)
                rows = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
                short = [collapsed(w, r).decode() for w, r in zip(words, runs)]
                yield appended(part, schema, {"n_words": pa.array([len(w) for w in words], pa.int64()),
                                              "runs": pa.array(rows, _ARROW_RUNS), "collapsed": pa.array(short, pa.string())})

    return docs.mapInArrow(run, schema)
