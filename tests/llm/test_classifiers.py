"""Toxicity and language: held-out accuracy, contract columns, edges."""

import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from salespark.llm import langid, quality, toxicity

TABLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def more_docs(spark):
    return spark.read.parquet(f"{TABLE}/documents.parquet")


def remainder(doc_id, m):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % m


def made_texts(n, seed):
    rng = random.Random(seed)
    clean = ["river", "stone", "window", "paper", "garden", "signal", "market", "letter", "engine", "summer"]
    toxic = ["blorgish", "blorged", "snarkled", "snarkling"]
    texts, labels = [], []
    for i in range(n):
        words = rng.choices(clean, k=rng.randint(5, 60))
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(toxic)
        texts.append(" ".join(words).encode())
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_subwords_reach_unseen_spellings():
    model = toxicity.train(*made_texts(800, 1))
    texts, labels = made_texts(200, 2)
    p = model.score(texts)
    assert ((p >= 0.3) == np.array(labels)).mean() > 0.97
    unseen = model.score([b"river stone blorgings window", b"river stone flower window"])
    assert unseen[0] > 0.3 > unseen[1]
    # a passage in a long clean text is not averaged away
    long_clean = b"river stone window paper " * 2000
    assert model.score([long_clean])[0] < 0.3 < model.score([long_clean + b"blorged snarkling blorgish " + long_clean])[0]


def test_training_is_repeatable_and_needs_both_classes():
    texts, labels = made_texts(200, 3)
    a, b = toxicity.train(texts, labels), toxicity.train(texts, labels)
    assert a.weights == b.weights and a.bias == b.bias
    only = toxicity.train(texts, [0] * len(texts))
    assert only.weights == {} and only.score([b"x"])[0] < 0.3
    assert 0 <= toxicity.train([], []).score([b""])[0] <= 1


def test_toxicity_rows(spark, more_docs):
    labels = spark.read.parquet(f"{TABLE}/labels.parquet")
    rows = toxicity.toxicity(more_docs, labels).collect()
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == more_docs.count()
    for r in rows:
        assert r.held_out == (remainder(r.doc_id, 4) == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.9
    # held-out labels are never read
    hidden = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2")
    again = {r.doc_id: r.score for r in toxicity.toxicity(more_docs, hidden).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_toxicity_edges(spark, edge_docs, no_docs, labels):
    rows = toxicity.toxicity(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(no_docs, labels).collect() == []
    model = toxicity.Model({}, -3.0)
    assert toxicity.kept(edge_docs, model).columns == edge_docs.columns


def test_language_rows(more_docs):
    rows = langid.languages(more_docs).collect()
    lang = {r.doc_id: r.lang for r in more_docs.collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    assert len(rows) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_language_edges(spark, no_docs):
    texts = [(1, "das haus und der garten", "de"), (2, "the house and the garden", "en"), (3, None, "de"),
             (4, "123 !? \n", "en"), (6, "der hund und das haus", None), (7, "the dog and the house", None),
             (8, "日本語の文章", None), (None, "the garden", None), (1, "das haus und der garten", "de")]
    df = spark.createDataFrame([(*t, 1.0, 2) for t in texts], "doc_id long, text string, lang string, score double, n int")
    protos = langid.prototypes(df)
    assert sorted(protos) == ["de", "en"]
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(df, protos, ["doc_id"]).collect()]
    assert {(3, "und"), (4, "und"), (6, "de"), (7, "en"), (None, "en")} <= set(got) and len(got) == len(texts)
    assert langid.languages(no_docs.selectExpr("*", "text as lang")).collect() == []
    unknown = langid.languages(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in unknown)


def test_prototype_is_the_bundle_of_bound_letters(spark):
    """One text: its prototype has the direction of the sum of products of rotated letter vectors."""
    df = spark.createDataFrame([(1, "abca", "x")], "doc_id long, text string, lang string")
    tri = langid.Trigrams()
    want = sum(np.roll(tri.letter(a), 2).astype(int) * np.roll(tri.letter(b), 1) * tri.letter(c)
               for a, b, c in (" ab", "abc", "bca", "ca "))
    assert langid.prototypes(df)["x"] @ (want / np.linalg.norm(want)) == pytest.approx(1.0, abs=1e-6)


def test_toxic_passages_anywhere_in_long_texts():
    """At the end, across a multiple of the window and of one repeated word."""
    plain = toxicity.Model({"<bad>": 60.0}, -3.0)  # the word "bad" weighs 10
    for before, after in ((300, 0), (10_000, 0), (2560 - 32, 2000)):
        assert plain.score([b"river " * before + b"bad " * 64 + b"river " * after])[0] > 0.8
    model = toxicity.train(*made_texts(800, 1))
    clean = [w for t in made_texts(400, 9)[0][1::4] for w in t.split()]
    passage = [b"blorged", b"snarkling", b"blorgish", b"snarkled"]
    for words in (192, 300, 1000):
        assert model.score([b" ".join(clean[:words])])[0] < 0.3
    scores = model.score([b" ".join(clean[:192 - 16] + passage * 4), b" ".join(clean[:300 - 16] + passage * 4),
                          b" ".join(clean[:2560 - 8] + passage * 4 + clean[:2000]),
                          b" ".join(clean[:2560] + [b"blorged"] * 60 + clean[:2000])])
    assert (scores >= 0.3).all()
    # every start counts: a passage scores alike wherever it stands
    anywhere = model.score([b" ".join(clean[:1] * k + passage * 32 + clean[:1] * (999 - k)) for k in (0, 64, 100, 999)])
    assert np.ptp(anywhere) < 1e-9


def test_training_takes_the_documented_rows():
    """The held-out figures of the README are those of 8,000 training rows."""
    assert toxicity.SAMPLE_ROWS >= 8_000


def test_repeated_doc_ids_do_not_grow_the_sample(spark, monkeypatch):
    rows = [(1, f"copy {i} of a text") for i in range(300)] + [(i, f"text {i} here") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, toxic int, quality int")
    got = toxicity.sample(docs, marks).collect()
    ids = {i for i in range(1, 40) if remainder(i, 4) != 2}
    assert len(got) == len(ids)
    seen = []
    monkeypatch.setattr(quality, "learn", lambda x, bad: seen.append(len(x)) or [])
    monkeypatch.setattr(quality, "LEAST_WORDS", 0)
    quality.fit(docs, marks)
    assert seen[0] <= 39


def test_components_keep_unrelated_trigrams_apart():
    """The noise of a cosine between unrelated trigrams is that of 1,024 components."""
    tri = langid.Trigrams()
    numbers = [tri.number(a + b + c) for a in "abcdefgh" for b in "ijklmnop" for c in "qrst"]
    v = tri.vectors[numbers].astype(float)
    cosines = (v @ v.T / v.shape[1])[np.triu_indices(len(v), 1)]
    assert np.sqrt(np.mean(cosines ** 2)) < 0.036


def test_new_words_cost_no_calls_of_their_own():
    """Trigrams are counted by the text: a word never seen before, of known trigrams, adds no Python call."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcd", k=9)) for _ in range(8000)})
    tri, calls = langid.Trigrams(), []
    tri.counts(" ".join(words[:4000]).encode())
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        at, n = tri.counts(" ".join(words[4000:]).encode())
    finally:
        sys.setprofile(None)
    assert n.sum() == 9 * len(words[4000:]) and len(at) <= 4 ** 3 + 2 * 4 ** 2
    assert len(calls) < 1000


@pytest.mark.parametrize("stretch", [1, 7, 1 << 20])
def test_trigrams_are_those_of_the_words(monkeypatch, stretch):
    """Equal to trigrams taken word by word, however a text is cut into stretches."""
    monkeypatch.setattr(langid, "STRETCH", stretch, raising=False)
    tri = langid.Trigrams()
    for text in ["", " \n", "a", "abca abc,ABC", "ΣΑΣ ΟΔΟΣ. ΑΣ\tΣ", "İstanbul İ_x9²y ½", "日本語の文章", "𝔘𝔫𝔦 𐐀", "123 _ ١٢٣"]:
        want = Counter(tri.number(f" {run} "[i:i + 3]) for word in text.split()
                       for run in re.findall(r"[^\W\d_]+", word.lower()) for i in range(len(run)))
        at, n = tri.counts(text.encode())
        assert dict(zip(at.tolist(), n.tolist())) == want
    broken = b"ab \xc3\xff cd\xe2\x82"
    assert sorted(tri.counts(broken)[0]) == sorted(tri.counts(b"ab cd")[0])


@pytest.mark.parametrize("names", [["__q", "__score", "__text"], ["row", "score", "__rule"], ["__failed", "a.b", "words"]])
def test_kept_rows_may_have_any_column_names(spark, labels, docs, names):
    """Columns of the operators' own names neither clash nor change."""
    some = docs.limit(120)
    odd = some.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    rules, model = quality.fit(some, labels), toxicity.fit(some, labels)
    for kept in (quality.kept(odd, rules), toxicity.kept(odd, model)):
        assert kept.columns == odd.columns
        rows = kept.collect()
        assert rows and all(tuple(r)[-3:] == (0, 1, 2) for r in rows)
    assert {r.doc_id for r in toxicity.kept(odd, model).collect()} == {r.doc_id for r in toxicity.kept(some, model).collect()}
    assert {r.doc_id for r in quality.kept(odd, rules).collect()} == {r.doc_id for r in quality.kept(some, rules).collect()}
