"""Token files and packing: round trips against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from salespark.llm import packing, tokenfiles, wordbpe
from salespark.llm.queries import word_tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_equal_the_library(library):
    enc = wordbpe.encoder(word_tokenizer())
    random.seed(5)
    letters = "abcXYZ019 .,'<|>_-@é É ñ ß Ø ſ İ ı ² ª º \xad \xa0 ́   Σ日\n\t\x00\x01🙂"
    texts = ["", "<|endoftext|> x<|ENDOFTEXT|>", "I'm it's 's O'Neil", "H̱ K Å ﬁ", "x" * 5000]
    texts += ["".join(random.choices(letters, k=random.randint(1, 16))) for _ in range(4000)]
    for t in texts:
        assert np.frombuffer(enc.encode(t.encode()), enc.dtype).tolist() == ids_of(library, t), t


def test_token_files_round_trip(spark, docs, texts, library):
    folder = tokenfiles.write(docs, word_tokenizer(), shard_rows=23)
    assert tokenfiles.manifest(spark, folder).count() > 3
    want, start = {}, 0
    for k in sorted(texts):
        ids = ids_of(library, texts[k])
        want[k] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r.doc_id: tuple(r)[1:] for r in tokenfiles.read_digest(docs.select("doc_id"), folder).collect()}
    assert got == want
    some = sorted(texts)[7]
    assert tokenfiles.get(spark, folder, some).tolist() == ids_of(library, texts[some])
    assert tokenfiles.get(spark, folder, 10**12) is None
    assert tokenfiles.get(spark, folder, some, occurrence=1) is None


def test_token_files_edges(spark, edge_docs, no_docs, library):
    folder = tokenfiles.write(edge_docs, word_tokenizer(), shard_rows=3)
    got = tokenfiles.read_digest(edge_docs.select("doc_id"), folder).collect()
    rows = edge_docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(ids_of(library, r.text)), crc(ids_of(library, r.text)))
                  for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    empty = tokenfiles.write(no_docs, word_tokenizer())
    assert tokenfiles.read_digest(no_docs.select("doc_id"), empty).collect() == []


def test_perfect_hash_is_minimal():
    keys = tokenfiles.mix(np.arange(5000, dtype=np.uint64), 1)
    mph = tokenfiles.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(5000))
    index = tokenfiles.ShardIndex(tokenfiles.index_bytes(
        np.arange(5000), np.zeros(5000, bool), np.zeros(5000, np.int64), np.arange(5000) % 7))
    absent = np.arange(10**6, 10**6 + 5000)
    assert not index.find(absent, np.zeros(5000, bool), np.zeros(5000, np.int64))[0].any()


def check_pieces(rows, window=packing.WINDOW):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and at == pieces[0].sequence_length
        padded += window - at if at & (at - 1) else 0
    return by_doc, padded


def test_packing_holds_every_id_once(docs, texts, library):
    rows = packing.pack(docs, word_tokenizer()).collect()
    by_doc, padded = check_pieces(rows)
    assert padded == 0
    for k, t in texts.items():
        ids, at = ids_of(library, t), 0
        for p in sorted(by_doc[k, len(ids)], key=lambda p: p.start):
            part = np.frombuffer(p.ids, "<u4").tolist()
            assert p.start == at and part == ids[at:at + p.length] and p.ids_crc32 == crc(part)
            at += p.length
        assert at == len(ids)


def test_packing_edges(edge_docs, no_docs, library):
    rows = packing.pack(edge_docs, word_tokenizer(), payload=False).collect()
    total = sum(len(ids_of(library, r.text)) for r in edge_docs.collect())
    _, padded = check_pieces(rows)
    assert sum(r.length for r in rows) == total and padded == 0
    assert packing.pack(no_docs, word_tokenizer()).collect() == []


def test_bm25_scores_and_neighbours():
    """Scores against the formula; the best unused neighbour fills the seed's window."""
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 60, rng.integers(5, 40)).astype(np.uint16) for _ in range(30)]
    held = np.zeros(60)
    for d in docs:
        held[np.unique(d)] += 1
    idf = np.log(1 + (len(docs) - held + 0.5) / (held + 0.5))
    average = np.mean([len(d) for d in docs])
    block = packing.Block(docs, idf, average)
    for seed in (0, 11, 29):
        got = block.scores(seed)
        for k, d in enumerate(docs):
            want = 0.0
            for term in set(docs[seed].tolist()):
                tf = (d == term).sum()
                norm = packing.K1 * (1 - packing.B + packing.B * len(d) / average)
                want += idf[term] * tf * (packing.K1 + 1) / (tf + norm)
            assert got[k] == pytest.approx(want, rel=1e-4)
    first = next(iter(packing.pack_block(docs, idf, average, window=64)))
    score = block.scores(0)
    score[0] = -1
    assert first[0][0] == 0 and first[1][0] == int(np.argmax(score)) and sum(p[2] for p in first) == 64


def test_neighbours_share_a_shard():
    """Of a corpus of several shards, most corpus-wide best neighbours lie in the seed's
    own shard, whatever the doc_ids; copies that no direction splits are dealt out."""
    rng = np.random.default_rng(4)
    topics = [rng.choice(2000, 60, replace=False) for _ in range(40)]
    docs = [rng.choice(topics[k % 40], 50).astype(np.uint16) for k in range(4000)]
    held = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=2000)
    idf = np.log(1 + (len(docs) - held + 0.5) / (held + 0.5))
    vectors = packing.Projection(idf, 50.0).vectors(docs)
    tree = packing.Tree(vectors, len(docs), 250)
    shards = tree.shard_of(vectors, rng.integers(0, 1 << 31, len(docs)))
    assert tree.shards >= 10 and np.bincount(shards).max() <= 500
    block = packing.Block(docs, idf, 50.0)
    same = []
    for seed in range(0, 4000, 40):
        score = block.scores(seed)
        score[seed] = -1
        same.append(shards[seed] == shards[int(np.argmax(score))])
    assert np.mean(same) > 0.6  # by a hash of doc_id: one in tree.shards
    copies = np.repeat(vectors[:1], 4000, axis=0)
    tree = packing.Tree(copies, len(copies), 250)
    assert np.bincount(tree.shard_of(copies, rng.integers(0, 1 << 31, 4000))).max() < 400


def test_packing_brings_topics_together(spark):
    """Windows of a corpus of many shards hold documents of one topic."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(640)]
    texts = [(k * 7919 % 100003, " ".join(rng.choices(words[k % 16 * 40:k % 16 * 40 + 40], k=40))) for k in range(6000)]
    topic = {doc: k % 16 for k, (doc, _) in enumerate(texts)}
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), word_tokenizer(), payload=False).collect()
    assert len({r.doc_id for r in rows}) == len(texts)
    check_pieces(rows)
    shards = defaultdict(lambda: defaultdict(int))
    for r in rows:
        shards[r.sequence_id >> 32][topic[r.doc_id]] += 1
    # dealt out by doc_id every shard holds all 16 topics alike
    assert np.mean([max(s.values()) / sum(s.values()) for s in shards.values()]) > 0.15


def test_columns_of_texts_encode_as_the_library_does(monkeypatch):
    """Slices, texts longer than a slice, forgotten pieces, bytes that aren't UTF-8."""
    import pyarrow as pa
    import public_tokenizers
    from salespark.llm import wordbpe

    monkeypatch.setattr(wordbpe, "SLICE", 300)
    monkeypatch.setattr(wordbpe, "PIECES_KEPT", 40)
    enc = wordbpe.WordBPE(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", "  a  b ", "é x. É, Ñandú.", "a.. ., . , .. U.S.A. it's don't. <s> </s> [CLS]", "Word, WORD. word; 12.5, x1",
             "日本語 🙂 é", "x" * 900 + " y z", "word " * 400, *(f"plain words{i} Number, {i}." for i in range(60))]
    raw = [t.encode() for t in texts] + [b"\xff\xfe x", b"a \x80b."]
    got = wordbpe.encoded_column(enc, pa.array([b"before", *raw], pa.binary()).slice(1)).to_pylist()
    for text, ids in zip(raw, got):
        want = enc.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids + [2]
        assert np.frombuffer(ids, enc.dtype).tolist() == want, text[:40]


def test_a_worker_remembers_for_one_operator_at_a_time():
    from salespark.llm import common

    first = common.memo(("a", 1), dict)
    assert common.memo(("a", 1), dict) is first
    common.memo(("b",), dict)
    assert common.memo(("a", 1), dict) is not first


def test_encoding_a_batch_takes_little_memory_at_a_time():
    """Ids are gathered a slice at a time: the arrays for a batch don't add up."""
    import tracemalloc

    import pyarrow as pa
    import public_tokenizers
    from salespark.llm import wordbpe

    enc = wordbpe.WordBPE(public_tokenizers.path("word_bpe_49k.json"))
    texts = pa.array([b"some plain words, in a text. " * 100] * 3000, pa.binary())  # 8.7 MB
    tracemalloc.start()
    try:
        wordbpe.encoded_column(enc, texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80e6, peak


def test_a_lookup_costs_as_much_whatever_is_remembered():
    """Short texts take little time after many distinct words, and have the library's ids."""
    import time

    import pyarrow as pa
    import public_tokenizers
    from salespark.llm import wordbpe

    enc = wordbpe.WordBPE(public_tokenizers.path("word_bpe_49k.json"))
    letters = "abcdefghijklmnopqrst"
    many = [a + b + c + d + e for a in letters for b in letters for c in letters for d in letters for e in "xy"]
    wordbpe.encoded_column(enc, pa.array([" ".join(many).encode()], pa.binary()))  # 320,000 words
    before = time.process_time()
    for k in range(60):
        got = wordbpe.encoded_column(enc, pa.array([f"Some {many[k]}, words.".encode()], pa.binary()))[0].as_py()
        assert np.frombuffer(got, enc.dtype).tolist() == enc.tokenizer.encode(f"Some {many[k]}, words.").ids + [2]
    assert time.process_time() - before < 0.6


def test_texts_of_a_run_are_gathered_in_slices(monkeypatch):
    """Texts numbered together and gathered apart; long, empty and first texts among them."""
    import pyarrow as pa
    import public_tokenizers
    from salespark.llm import wordbpe

    monkeypatch.setattr(wordbpe, "SLICE", 50)
    monkeypatch.setattr(wordbpe, "NUMBERED", 400)
    enc = wordbpe.WordBPE(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", *("words go, on. " * (k % 6) for k in range(90)), "", "x" * 500, "don't; 1.5 " * 4]
    got = wordbpe.encoded_column(enc, pa.array([t.encode() for t in texts], pa.binary())).to_pylist()
    for text, ids in zip(texts, got, strict=True):
        want = enc.tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert np.frombuffer(ids, enc.dtype).tolist() == want, text[:40]


def test_packing_takes_and_gives_few_rows_at_a_time(monkeypatch):
    """A worker that packs forgets the encoder, and a block's pieces leave it in parts that hold all ids."""
    from types import SimpleNamespace

    import pyarrow as pa
    from salespark.llm import common

    rng = np.random.default_rng(3)
    docs = [rng.integers(3, 5000, 900).astype("<u2") for _ in range(2500)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([5] * 2500, pa.int64()), pa.array(range(2500), pa.int64()), pa.array([d.tobytes() for d in docs])],
        ["shard", "doc_id", "ids"])
    monkeypatch.setattr(common, "_MEMO", {("wordbpe", "x"): "an encoder"})
    stats = SimpleNamespace(value=(np.ones(5000), 900.0))
    parts = list(packing._pack(stats, np.dtype("<u2"), packing.WINDOW, True)(iter([batch])))
    assert common._MEMO == {}
    assert max(p.nbytes for p in parts) < 3 << 20  # the block of 2,048 documents has 7 MB of ids
    rows = [r for p in parts for r in p.to_pylist()]
    for k in range(2500):
        mine = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == k)
        assert b"".join(i for _, i in mine) == docs[k].astype("<u4").tobytes()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
