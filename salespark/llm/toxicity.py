"""Toxicity by subword-bag embeddings and a linear softmax.

A word's vector is the mean of the embeddings of its character n-grams (3 to 6
characters of the word between ``<`` and ``>``, and the whole word); a text's
vector is the mean of its words' vectors; two softmax outputs stand on top.
Embeddings and output weights are trained jointly by gradient steps (Adagrad) in
numpy.  Words never seen share n-grams with seen ones.

An n-gram has an embedding if the share of training documents that hold it
differs between the classes by more than chance (chi-square over ``SCREEN``);
the vector of any other n-gram is zero.

Training takes a bounded sample of the labelled rows (``SAMPLE_ROWS``), chosen
by a hash of doc_id, with their whole texts.  The mean over words is linear, so
a trained model is one number an n-gram and a bias, sent to the tasks; its size
is bounded by ``MOST_GRAMS``.
"""

from __future__ import annotations

import uuid
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salespark.llm import common

#: Labelled rows that training takes at most (in expectation; a hash decides).
SAMPLE_ROWS = 8_000
DIM, EPOCHS, BATCH, RATE, DECAY = 8, 24, 128, 0.5, 1e-5
SHORTEST, LONGEST = 3, 6
SCREEN, MOST_GRAMS, LEAST_DOCS = 20.0, 40_000, 3
SKETCH_BITS = 24
THRESHOLD = 0.3
#: Words of a window: a longer text scores as its most toxic window (of those that
#: begin at any word) or as a whole, whichever is more, so a passage isn't averaged
#: away by its surroundings, wherever it stands.
WINDOW = 128
WORDS_KEPT = 400_000
_EDGES = ".,;:!?\"'()[]{}<>|%&$#*-_"


def grams_of(word: bytes) -> list[str]:
    """A word's n-grams (each as often as it stands there) and the word itself."""
    text = word.decode("utf-8", "replace").strip(_EDGES).lower()
    if not text:
        return []
    full = f"<{text}>"
    size = len(full)
    grams = [full[i:i + n] for n in range(SHORTEST, min(LONGEST, size) + 1) for i in range(size - n + 1)]
    return grams if size <= LONGEST else [*grams, full]


@dataclass
class Model:
    weights: dict[str, float]  # an n-gram's part of the logit of the toxic class
    bias: float

    def score(self, texts: list[bytes], memory: dict | None = None) -> np.ndarray:
        """Probability of the toxic class for whole texts."""
        words = _Words(self.weights) if memory is None else memory
        logit = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            found = text.split()
            if not found:
                continue
            values = np.fromiter(map(words.__getitem__, found), float, len(found))
            mean = values.sum() / len(found)
            if len(found) > WINDOW:
                sums = np.concatenate([[0.0], np.cumsum(values)])
                mean = max(mean, (sums[WINDOW:] - sums[:-WINDOW]).max() / WINDOW)
            logit[i] += mean
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


class _Words(dict):
    """word -> its part of the logit, remembered."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        weight = self.weights.get
        grams = grams_of(word)
        value = sum([weight(g, 0.0) for g in grams]) / len(grams) if grams else 0.0
        if len(word) <= 64:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = value
        return value


def _bags(texts: list[bytes]):
    """Per text: numbers of its distinct words and their shares; the words in order."""
    index: dict[bytes, int] = {}
    bags = []
    for text in texts:
        counts: dict[int, int] = {}
        found = text.split()
        for w in found:
            k = index.setdefault(w, len(index))
            counts[k] = counts.get(k, 0) + 1
        bags.append((np.fromiter(counts.keys(), np.int64, len(counts)),
                     np.fromiter(counts.values(), np.float64, len(counts)) / max(len(found), 1)))
    return list(index), bags


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated start..start+size ranges."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _frequent(words: list[bytes], bags) -> bytearray:
    """A table of 2 ** SKETCH_BITS saturated counts: under the place of an n-gram's hash at
    least the documents that hold it, up to ``LEAST_DOCS``.  It saves numbering the many
    n-grams of fewer documents, which have no embedding."""
    docs = np.zeros(len(words), np.int64)
    for own, _ in bags:
        docs[own] += 1
    table, mask = bytearray(1 << SKETCH_BITS), (1 << SKETCH_BITS) - 1
    for w, n in zip(words, np.minimum(docs, LEAST_DOCS).tolist()):
        for g in grams_of(w):
            at = hash(g) & mask
            if (now := table[at]) < LEAST_DOCS:
                table[at] = min(now + n, LEAST_DOCS)
    return table


def _screened(words: list[bytes], bags, labels: np.ndarray):
    """n-grams with an embedding, and for each word their numbers and its count of n-grams."""
    table, mask = _frequent(words, bags), (1 << SKETCH_BITS) - 1
    index: dict[str, int] = {"": 0}  # all that can't have an embedding
    flat, sizes = array("i"), array("q")
    for w in words:
        grams = [index.setdefault(g, len(index)) if table[hash(g) & mask] >= LEAST_DOCS else 0 for g in grams_of(w)]
        flat.extend(grams)
        sizes.append(len(grams))
    flat, sizes = np.frombuffer(flat, np.int32), np.frombuffer(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    held = np.zeros((2, len(index)))
    for (own, _), label in zip(bags, labels.tolist()):
        held[label, np.unique(flat[_ranges(starts[own], sizes[own])])] += 1
    held[:, 0] = 0
    totals = np.bincount(labels, minlength=2).astype(float)
    n, both = totals.sum(), held.sum(axis=0)
    cross = held[1] * (totals[0] - held[0]) - held[0] * (totals[1] - held[1])
    chi = n * cross ** 2 / np.maximum(both * (n - both) * totals[0] * totals[1], 1)
    keep = np.flatnonzero((chi > SCREEN) & (both >= LEAST_DOCS))
    keep = np.sort(keep[np.argsort(-chi[keep], kind="stable")][:MOST_GRAMS])
    number = np.full(len(index), -1, np.int64)
    number[keep] = np.arange(len(keep))
    names = list(index)
    return [names[k] for k in keep.tolist()], number[flat], starts, sizes


def train(texts: list[bytes], labels, seed: int = 7) -> Model:
    """Fit embeddings and softmax jointly; without both classes the score is the base rate."""
    labels = np.asarray(labels, np.int64)
    rate = (labels.sum() + 0.5) / (len(labels) + 1.0)
    prior = float(np.log(rate / (1 - rate)))
    if len(set(labels.tolist())) < 2:
        return Model({}, prior)
    words, bags = _bags(texts)
    del texts
    names, flat, starts, sizes = _screened(words, bags, labels)
    if not names:
        return Model({}, prior)
    # a document as shares of n-grams: mean over its words of the mean over their n-grams
    rows = []
    for own, share in bags:
        at = flat[_ranges(starts[own], sizes[own])]
        part = np.repeat(share / np.maximum(sizes[own], 1), sizes[own])[at >= 0]
        used, place = np.unique(at[at >= 0], return_inverse=True)
        rows.append((used, np.bincount(place, part, len(used)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.5, (len(names), DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.array([0.0, prior], np.float32)
    emb_sq, out_sq, bias_sq = np.zeros_like(emb), np.zeros_like(out), np.zeros_like(bias)
    bag = np.zeros((BATCH, len(names)), np.float32)
    for epoch in range(EPOCHS):
        order, step = rng.permutation(len(rows)), RATE * (1 - epoch / EPOCHS)
        for k in range(0, len(rows), BATCH):
            docs = order[k:k + BATCH].tolist()
            for r, d in enumerate(docs):
                bag[r, rows[d][0]] = rows[d][1]
            now = bag[:len(docs)]
            vectors = now @ emb
            z = vectors @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(docs)), labels[docs]] -= 1
            p /= len(docs)
            to_emb, to_out, to_bias = now.T @ (p @ out.T) + DECAY * emb, vectors.T @ p, p.sum(axis=0)
            for x, square, to in ((emb, emb_sq, to_emb), (out, out_sq, to_out), (bias, bias_sq, to_bias)):
                square += to ** 2
                x -= step * to / (np.sqrt(square) + 1e-7)
            for r, d in enumerate(docs):
                bag[r, rows[d][0]] = 0
    weight = emb.astype(np.float64) @ (out[:, 1] - out[:, 0]).astype(np.float64)
    return Model(dict(zip(names, weight.tolist())), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of about ``rows`` labelled documents outside the held-out part,
    chosen by a hash of doc_id; all of them where there are fewer.  Rows of null
    doc_id or label take no part; of a document labelled twice the greater label counts,
    of rows of one doc_id the first text in order is taken."""
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
             .filter("doc_id is not null and toxic is not null")
             .filter(common.bucket_of(labels, 4) != 2)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < max(1, int(rows / n * (1 << 20))))
    return (docs.select("doc_id", common.text_bytes().alias("text")).join(known, "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
            .select("text", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train on a bounded sample of the labelled documents."""
    got = sample(docs, labels, rows).orderBy(F.xxhash64("text"), "toxic").toArrow()
    return train(got.column("text").to_pylist(), np.clip(got.column("toxic").to_numpy(), 0, 1))


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``row``, a struct of the columns ``keep`` of ``docs`` (of any names), and ``score``
    of the whole text (null: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    number = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        m = shared.value
        # named anew for every scoring, so no model finds another's words
        memory = common.memo(("toxicity", number), lambda: _Words(m.weights))
        for batch in batches:
            p = m.score(batch.column("text").to_pylist(), memory)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p)], ["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), common.text_bytes().alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    held_out: crc32(doc_id as text) mod 4 is 2; such rows' labels are never read.
    A text without words scores the bias alone.  Without labelled rows of both
    classes every score is the base rate.
    """
    out = scored(docs.select("doc_id", "text"), fit(docs, labels), ["doc_id"]).select("row.doc_id", "score")
    return out.select("doc_id", (common.bucket_of(out, 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` that score below the threshold, columns as they are."""
    return scored(docs, model, docs.columns).filter(F.col("score") < THRESHOLD).select("row.*")
