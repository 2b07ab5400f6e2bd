"""SentencePiece encoding, spans and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from dropflow.llm.queries_pieces import piece_bpe
from dropflow.llm.registry import llm_queries
from dropflow.llm.sentencepieces import (DUMMY_PREFIX, ESCAPE, NORMALIZER, REMOVE_EXTRA, Normaliser, PieceModel, decoded,
                                         encoded, fields)

from fixtures import documents, write_tables

CHARS = "abcdefgh the is of .,;'\"-  \n\t\r▁é日本語🙂\x00\x01<s></s><0x41><unk>́　ab�"


def random_texts(n, chars=CHARS, longest=50, seed=3):
    rng = random.Random(seed)
    wide = [chr(c) for c in (*range(0xA0, 0x250), *range(0x4E00, 0x4E80), *range(0x1F300, 0x1F340))]
    return (["", " ", "  ", "▁", "\n", "a", " a", "a ", "▁▁ a"]
            + ["".join(rng.choice(chars if rng.random() < 0.8 else wide) for _ in range(rng.randint(0, longest))) for _ in range(n)])


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe())


@pytest.mark.parametrize("by_chunks", [True, False])
def test_ids_and_byte_spans_are_those_of_the_library(library, by_chunks):
    model = PieceModel(piece_bpe())
    assert model.by_chunks
    model.by_chunks = by_chunks
    texts = random_texts(1500)
    for text, (ids, bounds) in zip(texts, model.encode(texts)):
        found = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in found]
        assert list(zip(bounds[:-1].tolist(), bounds[1:].tolist())) == [(p.begin, p.end) for p in found]


def test_any_ids_decode_as_in_the_library(library):
    model, rng = PieceModel(piece_bpe()), random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 280), rng.randrange(32000)])
               for _ in range(rng.randint(0, 8))]
        assert model.decode(np.array(ids, int)) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("remove, dummy", [(True, True), (False, True), (True, False)])
def test_compiled_character_maps_and_offsets(rule, remove, dummy):
    there = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, escape_whitespaces=True,
                                                  remove_extra_whitespaces=remove)
    spec = {}
    for number, value in fields(there.serialized_model_proto()):
        if number == NORMALIZER:
            spec.update(fields(value))
    here = Normaliser(spec | {DUMMY_PREFIX: int(dummy), REMOVE_EXTRA: int(remove), ESCAPE: 1})
    for text in random_texts(400, "abe é é ①ﬁ㍿ Ａ　 ​\t\n\r\x00 ℌＡＢ가가Åß İ­̀́x", 20):
        want, offsets = there.normalize(text, with_offsets=True)
        got, origin = here(text)
        assert got == want
        ends = [len(want[:k].encode()) for k in range(len(want) + 1)]
        assert [int(origin[e]) for e in ends] == [len(text[:k].encode()) for k in offsets]


def test_query_agrees_with_the_library(spark, library, tmp_path_factory):
    folder = write_tables(spark, str(tmp_path_factory.mktemp("pieces")))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for row in documents():
        ids = library.encode(row[1] or "")
        want.append((row[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = [tuple(r) for r in llm_queries()["op12_sentencepieces"](spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_round_trip_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "a  b\nc", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, ids string")
    rows = decoded(encoded(docs, piece_bpe()), piece_bpe()).orderBy("doc_id").collect()
    assert [r["decoded"] for r in rows] == ["a  b\nc", "", ""]
    assert rows[1]["ids"] == [] and rows[1]["bounds"] == [0] and rows[0]["bounds"][-1] == 6
    none = docs.limit(1).selectExpr("doc_id", "CAST(NULL AS ARRAY<INT>) AS ids")
    assert decoded(none, piece_bpe()).first()["decoded"] == ""
