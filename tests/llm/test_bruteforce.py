"""Operators that SQL cannot express, against plain Python on the same rows."""

import collections
import math
import zlib

import numpy as np
import pytest
import xxhash

from dropflow.llm import chat, decontaminate, language_id, language_model, lines, mixing, quality, simhash, tokens
from dropflow.llm.queries_chat import byte_bpe
from dropflow.llm.queries_tokens import word_bpe
from dropflow.llm.registry import llm_queries

from fixtures import documents, text_words, write_tables

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("tables")))


def fingerprint(text) -> int:
    w = text_words(text)
    if not w:
        return 0
    found = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    counts = [0] * 64
    for s in found:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(found))


def groups(prints: list[int], bits: int = 2) -> list[int]:
    """Index of each print's component, by all pairs."""
    label = list(range(len(prints)))
    a = np.array(prints, np.uint64)
    changed = True
    pairs = [(int(x), int(y)) for x, y in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= bits)) if x < y]
    while changed:
        changed = False
        for x, y in pairs:
            low = min(label[x], label[y])
            changed |= label[x] != low or label[y] != low
            label[x] = label[y] = low
    return label


def test_simhash_query(spark, tables):
    rows = documents()
    prints = [fingerprint(r[1]) for r in rows]
    label = groups(prints)
    lowest = collections.defaultdict(list)
    for r, g in zip(rows, label):
        lowest[g].append(r[0])
    low = {g: min((i for i in ids if i is not None), default=None) for g, ids in lowest.items()}
    want = sorted((str(r[0]), f"{p:016x}", str(low[g])) for r, p, g in zip(rows, prints, label))
    got = llm_queries()["op1_simhash_vptree"](spark, tables).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_simhash_keeps_one_row_of_each_group(spark, tables):
    rows = documents()
    n_groups = len(set(groups([fingerprint(r[1]) for r in rows])))
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == n_groups


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_finds_every_link_across_shards(seed):
    rng = np.random.default_rng(seed)
    prints = []
    for base in rng.integers(0, 1 << 64, 150, dtype=np.uint64):
        for _ in range(rng.integers(1, 30)):
            x = int(base)
            for k in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(k)
            prints.append(x)
    f = np.unique(np.array(prints, np.uint64))
    tree = simhash.build_tree(f[::5], 24)
    row, leaf, home = simhash.route(tree, f, 2)
    assert home.sum() == len(f) and len(np.unique(leaf)) > 4
    forest = simhash.Forest(len(f))
    for shard in np.unique(leaf):
        at = row[leaf == shard]
        label = simhash.link_shard(f[at], home[leaf == shard], 2)
        forest.join(at, at[label])
    want = groups([int(x) for x in f])
    assert forest.label.tolist() == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 200), (300, 301)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 0, 300: 300, 301: 300}


def test_token_files(spark, tables):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(word_bpe())
    rows = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = llm_queries()["op3_token_files"](spark, tables).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    start, want = 0, collections.Counter()
    for r in rows:
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        want[(r[0], len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]


@pytest.mark.parametrize("bits", [1, 8, 9, 17, 25, 32])
def test_pack_and_unpack(bits):
    r = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    control, data = tokens.pack(r)
    assert len(control) == 251 and (tokens.unpack(control, data, len(r)) == r).all()
    assert tokens.pack(r[:0]) == (b"", b"") and len(tokens.unpack(b"", b"", 0)) == 0


def test_language_model_base_counts_and_held_out_gain(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    counts = collections.Counter()
    for i, text in rows:
        if not held[i]:
            counts.update([*text_words(text), None])
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in llm_queries()["op7_maxent_lm"](spark, SF001).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        words = [*text_words(text), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held[i], len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    gain = [r["score"] - r["base_score"] for r in got.values()]
    assert sum(gain) > 0 and all(math.isfinite(g) for g in gain)


def test_language_model_is_a_distribution():
    rng = np.random.default_rng(3)
    w = rng.normal(size=(language_model.WEIGHT_ROWS, language_model.CLASSES)).astype(np.float32)
    buckets, classes = rng.integers(0, 100, 50).astype(np.uint16), rng.integers(0, language_model.CLASSES, 50).astype(np.uint8)
    rows, _ = language_model.features(buckets, classes, rng.integers(0, 50, 200), np.array([1, 99, 100]))
    assert np.exp(language_model.class_logs(w, rows)).sum(axis=1) == pytest.approx(np.ones(200), abs=1e-5)
    assert (rows[1][[0, 1, 2, 100, 101]] == language_model.BUCKETS).all()  # no context across texts
    steps = np.zeros_like(w), np.zeros_like(w)
    for _ in range(200):
        language_model.train_on(*steps, rows, np.zeros(200, np.int32))
    assert np.exp(language_model.class_logs(steps[0], rows))[:, 0].min() > 0.9


def test_language_model_on_awkward_rows(spark, tables):
    got = llm_queries()["op7_maxent_lm"](spark, tables).collect()
    assert len(got) == len(documents()) and all(math.isfinite(r["score"]) for r in got)
    assert sorted(r["n_tokens"] for r in got) == sorted(len(text_words(r[1])) + 1 for r in documents())


def test_language_id_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = llm_queries()["op4_byte_cnn"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and len(held) > 100
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_language_id_on_awkward_rows(spark, tables):
    got = llm_queries()["op4_byte_cnn"](spark, tables).collect()
    assert len(got) == len(documents())
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    for i in (100, 101, 102, 109):
        assert [(r["lang_pred"], r["score"]) for r in by_id[i]] == [("und", 0.0)]
    assert all(r["lang_pred"] in ("en", "fr", "ja") for i in range(60) for r in by_id[i])


def test_language_id_tables_agree_with_the_network():
    rng = np.random.default_rng(0)
    net = language_id.ByteNetwork(["a", "b", "c"])
    x = rng.integers(0, 256, (5, language_id.WINDOW), dtype=np.uint8)
    hidden = np.concatenate([np.maximum(net._pooled(x, w)[0], 0) for w in language_id.WIDTHS], axis=1)
    z = hidden @ net.p["out"] + net.p["out_bias"]
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert language_id.Scorer(net.p).log_probabilities(x) == pytest.approx(want, abs=1e-4)
    assert b"".join(w.tobytes() for w in language_id.windows(bytes(range(256)) * 2)) == bytes(range(256)) * 2


def test_chat_round_trip_of_control_strings(spark, tables):
    turns = [("user", "a <|end|> \\ <\\| b"), ("assistant", "\\<|turn|>x\\"), ("assi<|says|>", "")]
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == ["\\<|turn|>x\\"]
    table = spark.read.parquet(f"{tables}/conversations.parquet")
    formatted = chat.format_chats(table, byte_bpe(), segment_turns=8, part_chars=100)
    whole = chat.digests(chat.decode_chats(chat.format_chats(table, byte_bpe()), byte_bpe()))
    parts = chat.digests(chat.decode_chats(formatted, byte_bpe()))
    assert formatted.filter("conv_id = 7").count() > 20  # a long conversation continues in further rows
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))


def test_decontamination_spans_and_blocks(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    items = spark.read.parquet(f"{tables}/benchmark.parquet")
    one = decontaminate.scan(docs, items).filter("doc_id = 107").first()
    assert [docs.filter("doc_id = 107").first()["text"][s["start"]:s["end"]] for s in one["spans"]] == [
        "The QUICK, brown fox: jumps over the lazy dog and then sleeps",
        "the quick brown fox jumps over the lazy dog and then sleeps"]
    assert one["items"] == ["1", "10", "2"]
    columns = ["doc_id", "n_words", "n_hit", "items", "spans"]
    blocks = decontaminate.scan(docs, items, block_chars=50).select(*columns)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, decontaminate.scan(docs, items).select(*columns).collect()))
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and clean.filter("doc_id = 107").count() == 0


def test_mixed_rows_repeat_as_planned(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    plan = mixing.planned_documents(docs)
    want = plan.groupBy("doc_id").sum("copies").collect()
    got = {r["doc_id"]: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert mixing.mix(docs).columns == docs.columns
    assert got == {r["doc_id"]: r["sum(copies)"] for r in want if r["sum(copies)"]}
    assert plan.filter("copies > 3").count() == 0


def test_kept_lines_and_documents_keep_their_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    cut = lines.dedup_lines(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[111] == "Line a b c d e f g\n" and texts[100] is None and texts[103] == ""
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()


def test_pipeline_is_its_stages_by_brute_force(spark, tables):
    import corpus_pipeline
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(word_bpe())
    judged = {(r["doc_id"], r["n_words"]) for r in llm_queries()["op5_host_rules"](spark, tables).filter("kept").collect()}
    rows = [r for r in documents() if (r[0], len(text_words(r[1]))) in judged]
    label, seen, kept = groups([fingerprint(r[1]) for r in rows]), set(), []
    for r, g in sorted(zip(rows, label), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        if g not in seen:
            seen.add(g)
            kept.append(r)
    kept = [r for r in kept if r[0] not in (107, -5)]  # the planted benchmark passages
    size = collections.Counter()
    for r in kept:
        size[r[3]] += len(text_words(r[1]))
    got = corpus_pipeline.run(spark, tables).collect()
    taken = collections.Counter(r["doc_id"] for r in got)
    assert set(taken) <= {r[0] for r in kept} and max(taken.values()) <= 3
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, clamped, target = sum(size.values()), set(), {}
    while True:
        level = (total - sum(3 * size[s] for s in clamped)) / sum(weight[s] for s in order if s not in clamped)
        more = {s for s in order if s not in clamped and weight[s] * level >= 3 * size[s]}
        if not more:
            break
        clamped |= more
    target = {s: 3 * size[s] if s in clamped else weight[s] * level for s in order}
    words = collections.Counter()
    for r in kept:
        words[r[3]] += taken[r[0]] * len(text_words(r[1]))
    for s in order:
        largest = max(len(text_words(r[1])) for r in kept if r[3] == s)
        assert abs(words[s] - target[s]) <= largest / 2 + 1e-6
    ids = {r[0]: np.array(tok.encode(r[1], add_special_tokens=False).ids + [2], "<u4") for r in kept}
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids[r["doc_id"]]), zlib.crc32(ids[r["doc_id"]].tobytes()))
        start += r["n_tokens"]
