"""Any tokenizer gives the ids of whole texts."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from dropflow.llm.queries_chat import byte_bpe
from dropflow.llm.queries_tokens import word_bpe
from dropflow.llm.tokens import PieceEncoder

from fixtures import documents


@pytest.mark.parametrize("path, by_pieces", [(word_bpe(), True), (byte_bpe(), False)])
def test_ids_are_those_of_whole_texts(path, by_pieces):
    texts = [r[1] for r in documents() if r[1] is not None] + ["Upper  Case, two  spaces\n", " <|endoftext|> x"]
    made, whole = PieceEncoder(path), Tokenizer.from_file(path)
    assert made.by_pieces == by_pieces
    for text, ids in zip(texts, made.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, made.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids
