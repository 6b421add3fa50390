"""Piece BPE against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from salespark.llm import piecebpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_encode_and_decode_equal_the_library(library):
    m = piecebpe.model(PATH)
    random.seed(2)
    letters = "aaabcdehlo xX  ..,-=01 éß▁日\n\t🙂_"
    texts = ["", " ", "  a  b ", "▁", "a▁b", "<s> </s><unk> <0x0A>", "日本語 中文", "a" * 700, "=" * 99, "\x00 \x01"]
    texts += ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(random.choices("abcdefghij", k=3000))]
    for t in texts:
        ids = m.encode(t)
        assert ids == library.encode(t), t
        assert m.decode(ids) == library.decode(ids), t


def test_decode_of_any_ids(library):
    m = piecebpe.model(PATH)
    random.seed(3)
    for _ in range(300):
        ids = [random.randrange(3, 400) for _ in range(random.randint(0, 12))]
        assert m.decode(ids) == library.decode(ids), ids


def test_query_rows(spark, docs, texts, library):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    got = {r.doc_id: tuple(r)[1:] for r in piecebpe.round_trip_digest(docs, PATH).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        ids = library.encode(t)
        assert got[k] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_edges(edge_docs, no_docs, library):
    rows = edge_docs.select("doc_id", "text").collect()
    got = piecebpe.encode(edge_docs, PATH).collect()
    assert sorted((r.doc_id or -1, list(r.ids)) for r in got) == sorted(
        (r.doc_id or -1, library.encode(r.text or "")) for r in rows)
    back = piecebpe.decode(piecebpe.encode(edge_docs, PATH), PATH).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted(
        (r.doc_id or -1, library.decode(library.encode(r.text or ""))) for r in rows)
    assert piecebpe.round_trip_digest(no_docs, PATH).collect() == []
