"""Periodic runs against a plain search, and the query against plain Python."""

import hashlib
import random
import zlib

import pytest

from dropflow.llm.registry import llm_queries
from dropflow.llm.runs import Repetitions, collapsed, periodic_runs, text_runs

from fixtures import WORD, documents, write_tables


def plain_runs(words, least):
    """Every run by comparing words q apart, for each q."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, 2 * q) and not any(
                    all(words[start + t] == words[start + t + p] for t in range(length - p)) for p in range(1, q)):
                found.append((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_runs_of_random_words(least):
    rng = random.Random(least)
    texts = []
    for _ in range(400):
        letters, n = rng.choice([1, 2, 3, 5, 20]), rng.randint(0, 70)
        words = [b"%d" % rng.randrange(letters) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, n // 2)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        texts.append(words + words[:rng.randint(0, n)] if rng.random() < 0.4 else words)
    assert text_runs(texts, least) == [plain_runs(w, least) for w in texts]


def test_the_automaton_alone_finds_all_squares():
    rng = random.Random(8)
    for _ in range(200):
        words = [rng.randrange(rng.choice([2, 4])) for _ in range(rng.randint(1, 60))]
        made = Repetitions()
        for w in words:
            made.append(w)
        got = sorted(((s, e - s + 1, p) for (s, p), e in made.squares.items()), key=lambda r: (r[0], r[2]))
        assert got == plain_runs(words, 2)


@pytest.mark.parametrize("words", [[b"a"] * 30_000, [b"%d" % (i % 997) for i in range(30_000)]])
def test_long_repetition_is_one_run(words):
    period = len(set(words))
    assert text_runs([words]) == [[(0, len(words), period)]]
    assert collapsed(words, [(0, len(words), period)]) == b" ".join(words[:period])


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    # a plain search is quadratic: long texts without short-distance repeats are covered by test_long_...
    runs = plain_runs(words, 12)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_agrees_with_plain_search(spark, tmp_path_factory):
    folder = write_tables(spark, str(tmp_path_factory.mktemp("runs")))
    short = [r for r in documents() if len(r[1] or "") < 20_000]
    got = [tuple(r) for r in llm_queries()["op11_periodic_runs"](spark, folder).collect()]
    assert len(got) == len(documents())
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in short)
    want = [expected(r[0], r[1]) for r in short]
    for row in want:
        assert got.count(row) == want.count(row)


def test_other_columns_stay_and_equal_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b " * 8, "x"), (2, None, "y")], "doc_id long, text string, runs string")
    rows = {r["doc_id"]: r for r in periodic_runs(docs).collect()}
    assert [tuple(r) for r in rows[1]["runs"]] == [(0, 16, 2)] and rows[1]["collapsed"] == "a b"
    assert rows[2]["runs"] == [] and rows[2]["collapsed"] == "" and rows[2]["n_words"] == 0
