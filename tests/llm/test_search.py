"""Ranked search: classes of equal bags, ties, item blocks (its SQL is compared in test_sql_queries)."""

import math
from collections import Counter

from dropflow.llm.decontaminate import item_words
from dropflow.llm.search import ranked

from fixtures import BENCHMARK, benchmark, documents


def plain_ranks(docs, items, top=10):
    bags = [(i, Counter(item_words((t or "").encode()))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    held = Counter(w for _, b in bags for w in b)
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(item_words((text or "").encode()))
    out = []
    for item, words in terms.items():
        scores = []
        for i, bag in bags:
            m = 10 + 90 * sum(bag.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[w] + 1)))
                        * (1_000_000_000 * bag[w] // (1000 * bag[w] + 8 * m)) for w in words if w in bag)
            if score > 0:
                scores.append((-score, i is None, i if i is not None else 0))
        out += [(item, rank, None if gone else i, -s) for rank, (s, gone, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_large_classes_ties_and_missing_ids(spark):
    docs = ([(i, "alpha beta gamma") for i in range(300, 0, -1)] + [(500, "beta alpha, GAMMA"), (500, "beta alpha, GAMMA")]
            + [(None, "alpha beta gamma")] * 3 + [(i, f"alpha delta x{i}") for i in range(1000, 1030)]
            + [(2, "epsilon"), (2, "epsilon"), (None, "epsilon"), (7, None), (8, " ,;")])
    items = [(1, "Alpha beta"), (2, "gamma gamma delta"), (3, "nothing here"), (4, "epsilon"), (None, "beta"), (5, None), (1, "delta")]
    found = ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(7),
                   spark.createDataFrame(items, BENCHMARK))
    assert rows(found) == plain_ranks(docs, items)


def test_blocks_of_items_give_the_same_ranks(spark):
    docs = [(r[0], r[1]) for r in documents()]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(benchmark(), BENCHMARK)
    want = plain_ranks(docs, benchmark(), 4)
    assert rows(ranked(frame, items, top=4)) == want
    assert rows(ranked(frame, items, top=4, block_chars=30)) == want
