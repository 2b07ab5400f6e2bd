"""Words inside their class depend on the words before them."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dropflow.llm import language_model as lm
from dropflow.llm.common import documents

SF01 = "/root/testdata/sf0.01"


def ids(held: bool, n: int) -> list[int]:
    return [i for i in range(20 * n) if (zlib.crc32(str(i).encode()) % 7 == 2) == held][:n]


@pytest.mark.parametrize("group_bits", [lm.GROUP_BITS, 15])
def test_context_decides_between_words_of_one_class(spark, group_bits):
    assert lm.ending_class(b"fishing") == lm.ending_class(b"wishing")
    filler = " ".join(f"filler{i}" for i in range(20))
    train = [f"{filler} red fishing {filler} blue wishing " * 150] * 60
    cases = ["red fishing", "blue wishing", "red wishing", "blue fishing"]
    rows = list(zip(ids(False, 60), train)) + list(zip(ids(True, 4), cases))
    made = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), group_bits=group_bits)
    got = {r["doc_id"]: r["score"] for r in made.collect()}
    assert len(got) == 64
    right, wrong = [got[i] for i in ids(True, 4)][:2], [got[i] for i in ids(True, 4)][2:]
    assert sum(right) - sum(wrong) > 0.5  # the words and classes are the same, so without context the sums are equal


def test_held_out_gain_over_the_model_without_word_contexts(spark):
    docs = documents(spark, SF01)
    held = [lm.score(docs, word_contexts=on).filter("held_out").agg(F.sum("score"), F.sum("n_tokens")).first() for on in (True, False)]
    assert held[0][1] == held[1][1]
    assert (held[0][0] - held[1][0]) / held[0][1] > 0.005


def test_words_of_a_class_are_a_distribution_in_every_context():
    rng = np.random.default_rng(4)
    n, top_bits, cls = 700, 2, 20
    words, c = rng.integers(-1 << 62, 1 << 62, n), rng.integers(1, 200, n)
    code = (words >> 20 & (lm.BUCKETS - 1)).astype(np.uint32)
    prefix, mass = code >> (lm.BUCKET_BITS - top_bits), np.zeros((lm.CLASSES, 1 << top_bits))
    np.add.at(mass[cls], prefix, c + 1.0)
    told, rows = np.zeros(n, np.int64), []
    for p in range(1 << top_bits):
        at = np.flatnonzero(prefix == p)
        made = lm._subtree(pa.table({"word": words[at], "c": c[at], "class": np.full(len(at), cls), "prefix": prefix[at]}))
        told[at] = made.column("told").to_numpy()
        rows.append((cls, p, next(x for x in made.column("codes").to_pylist() if x is not None)))
    ranks = told >> lm.CLASS_BITS & ((1 << lm.DEEP) - 1)
    trees = [lm.Tree(lm._log_ratios(mass), [r for r in rows if (r[1] * lm.CLASSES + cls) % 2 == g], lm.BUCKET_BITS, g, 2) for g in (0, 1)]
    choices = [lm.Choices(code, np.full(n, cls), c, ranks, t) for t in trees]
    total = np.zeros(n)
    for choice in choices:
        tree = rng.normal(size=1 << 16).astype(np.float32)
        total += lm.tree_logs(tree, choice, np.arange(n), np.full((2, n), [[77], [99]], np.uint32))
    assert np.exp(total).sum() == pytest.approx(1, abs=1e-4)
    plain = sum(lm.tree_logs(np.zeros(1 << 16, np.float32), x, np.arange(n), np.zeros((2, n), np.uint32)) for x in choices)
    assert np.exp(plain) == pytest.approx((c + 1) / (c + 1).sum(), rel=0.05)


def test_averages_count_only_the_tokens_that_touched_a_weight():
    parts = [lm._packed(np.array([1.0, 5.0, 7.0]), np.array([100, 0, 0])), lm._packed(np.array([3.0, 2.0, 7.0]), np.array([100, 40, 0]))]
    table = pa.table({"chunk": pa.array([-1, -1], pa.int32()), "salt": pa.array([0, 1], pa.int32()),
                      "part": [p for p, _ in parts], "touched": [n for _, n in parts]})
    made = lm._averaged(table)
    assert np.frombuffer(made.column("part")[0].as_py(), "<f2").tolist() == [2.0, 2.0, 7.0]


def test_steps_and_scores_are_those_of_plain_sums_to_the_last_bit():
    """Sums by segments of any length, steps in place and scores by parts leave every weight and score as plain numpy has it."""
    rng = np.random.default_rng(4)
    n = 3 * lm.PART + 5
    rows = np.stack([np.minimum(rng.zipf(1.3, n) - 1, 4000), rng.integers(0, 3000, n) + lm.BUCKETS,
                     rng.integers(0, 9, n) + 2 * lm.BUCKETS]).astype(np.uint16)
    cls = rng.integers(0, lm.CLASSES, n).astype(np.int32)
    start = rng.normal(size=(lm.WEIGHT_ROWS, lm.CLASSES)).astype(np.float32), np.zeros((lm.WEIGHT_ROWS, lm.CLASSES), np.float32)
    (w, sq), (plain, plain_sq) = ([a.copy() for a in start] for _ in range(2))
    own = lm.own_class_logs(w, rows, cls)
    lm.train_on(w, sq, rows, cls)
    z = plain[rows[0]] + plain[rows[1]] + plain[rows[2]]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.array_equal(own, z[np.arange(n), cls])
    g = np.exp(z)
    g[np.arange(n), cls] -= 1.0
    seen = set()
    for r in rows:
        order = np.argsort(r, kind="stable")
        touched, first, size = np.unique(r[order], return_index=True, return_counts=True)
        seen |= set(size.tolist())
        step = np.add.reduceat(g[order], first, axis=0)
        assert np.array_equal(lm.segment_sums(g, order, first), step)
        plain_sq[touched] += step * step
        plain[touched] -= lm.RATE * step / np.sqrt(plain_sq[touched] + 1e-6)
    assert seen >= {1, 2, 3, lm.SHORT - 1, lm.SHORT, lm.SHORT + 1} and max(seen) > 1000
    assert np.array_equal(w, plain) and np.array_equal(sq, plain_sq)


def test_subtrees_of_one_group_are_those_of_each_alone():
    """Several nodes' words in one call have the ranks and codes that each node's words have alone."""
    rng = np.random.default_rng(5)
    n = 900
    words, c, prefix = rng.integers(-1 << 62, 1 << 62, n), rng.integers(0, 9, n), np.minimum(rng.geometric(0.05, n), 70)
    whole = {r["word"]: r for r in lm._subtree(pa.table({"word": words, "c": c, "class": np.full(n, 20), "prefix": prefix})).to_pylist()}
    assert len(whole) == n
    for p in np.unique(prefix):
        own = np.flatnonzero(prefix == p)
        alone = lm._subtree(pa.table({"word": words[own], "c": c[own], "class": np.full(len(own), 20), "prefix": prefix[own]}))
        assert [whole[w] for w in words[own].tolist()] == alone.to_pylist()
        known = own[c[own] > 0]
        ranks = [whole[w]["told"] >> lm.CLASS_BITS & ((1 << lm.DEEP) - 1) for w in words[known[np.lexsort((words[known], -c[known]))]].tolist()]
        assert ranks == list(range(len(known)))
        assert sum(whole[w]["codes"] is not None for w in words[own].tolist()) == (len(known) > 0)
