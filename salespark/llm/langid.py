"""Language identification by hyperdimensional profiles.

Every letter has a random vector of -1 and +1 (``DIM`` components, drawn from its
code point).  The vector of a letter trigram binds its letters: the componentwise
product of the first letter's vector rotated by two places, the second's by one
and the third's.  Trigrams are taken inside words, with a blank at either end.  A
text's vector is the sum (bundle) of its trigrams' vectors; a language's
prototype is the bundle of all its training texts, each text weighing the same.
A text has the language whose prototype has the largest cosine with its vector.

A text's trigrams are read off its code points by numpy, whatever words it is made
of; its distinct trigrams are remembered as vectors, so a text costs one count of its
trigrams and one product with their vectors.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespark.llm import common

DIM = 1024
UNDETERMINED = "und"
#: Remembered trigrams and their vectors per Python worker; beyond them they start afresh.
TRIGRAMS_KEPT = 50_000
#: Code points of a text whose trigrams are counted at a time.
STRETCH = 1 << 20
_LETTERS = re.compile(r"[^\W\d_]+")
_BLANK = ord(" ")


@cache
def letter_table() -> np.ndarray:
    """By code point: is it a letter?"""
    table = np.zeros(0x110000, bool)
    for run in _LETTERS.finditer("".join(map(chr, range(len(table))))):
        table[run.start():run.end()] = True
    return table


class Trigrams(dict):
    """trigram (three code points of 21 bits) -> its number; vectors by number."""

    def __init__(self, seed: int = 11):
        super().__init__()
        self.seed = seed
        self.letters: dict[str, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.vectors = np.zeros((1024, DIM), np.int8)

    def letter(self, ch: str) -> np.ndarray:
        if ch not in self.letters:
            if len(self.letters) > 4096:
                self.letters.clear()
            bits = np.random.default_rng([self.seed, ord(ch)]).integers(0, 2, DIM, np.int8)
            self.letters[ch] = 2 * bits - 1
        return self.letters[ch]

    def number(self, gram: str) -> int:
        a, b, c = map(ord, gram)
        return self[a << 42 | b << 21 | c]

    def __missing__(self, packed: int) -> int:
        k = self[packed] = len(self)
        if k >= len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        a, b, c = (self.letter(chr(packed >> shift & 0x1FFFFF)) for shift in (42, 21, 0))
        self.vectors[k] = np.roll(a, 2) * np.roll(b, 1) * c
        return k

    def counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a whole text's distinct trigrams and how often each stands there."""
        if len(self) > TRIGRAMS_KEPT:
            self.forget()
        chars = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
        found = [self._stretch(chars, lo) for lo in range(0, max(len(chars), 1), STRETCH)]
        if len(found) == 1:
            at, n = found[0]
        else:
            total = np.bincount(np.concatenate([at for at, _ in found]), np.concatenate([n for _, n in found]))
            at = np.flatnonzero(total)
            n = total[at]
        return at, n.astype(np.float32)

    def _stretch(self, chars: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray]:
        """``counts`` of the trigrams around the letters of ``STRETCH`` code points from ``lo`` on."""
        first, last = max(lo - 1, 0), min(lo + STRETCH, len(chars))
        some = chars[first:last + 1]
        is_letter = letter_table()[some]
        padded = np.full(len(some) + 2, _BLANK, np.int64)
        np.copyto(padded[1:-1], some, where=is_letter)
        # the letters of the stretch; its neighbours on either side only complete trigrams
        middle = np.flatnonzero(is_letter[lo - first:last - first]) + (lo - first)
        packed = padded[middle] << 42 | padded[middle + 1] << 21 | padded[middle + 2]
        distinct, n = np.unique(packed, return_counts=True)
        return np.array([self[k] for k in distinct.tolist()], np.int64), n

    def bundle(self, text: bytes) -> np.ndarray | None:
        """A text's vector, None for a text without letters."""
        at, n = self.counts(text)
        return n @ self.vectors[at].astype(np.float32) if len(at) else None


def trigrams() -> Trigrams:
    """The remembered trigrams of this Python worker."""
    return common.memo(("langid",), Trigrams)


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototype of every language over all rows of (text, lang) with a
    language and a letter.

    Each task bundles trigram counts by language and sends one vector a language;
    they are added in Spark.  The result holds ``DIM`` numbers a language.
    """
    def run(batches):
        import pyarrow as pa

        tri, sums, weights = trigrams(), {}, {}

        def close():
            for lang, w in weights.items():
                at = np.flatnonzero(w)
                vector = w[at].astype(np.float32) @ tri.vectors[at].astype(np.float32)
                sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
            weights.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if len(tri) > TRIGRAMS_KEPT:
                    close()  # numbers change their meaning when they are forgotten
                at, n = tri.counts(text)
                if not len(at):
                    continue
                w = weights.get(lang)
                if w is None or len(w) <= at.max():
                    w, old = np.zeros(2 * int(at.max()) + 1024), w
                    if old is not None:
                        w[:len(old)] = old
                    weights[lang] = w
                w[at] += n / n.sum()
        close()
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(k) for k in sums]), pa.array([v.tolist() for v in sums.values()])],
                ["lang", "vector"])

    known = docs.filter("lang is not null").select(
        common.text_bytes().alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = (known.mapInArrow(run, "lang string, vector array<double>")
            .select("lang", F.posexplode("vector").alias("i", "x"))
            .groupBy("lang", "i").agg(F.sum(F.round("x", 6).cast("decimal(38,6)")).alias("x")).collect())
    out: dict[str, np.ndarray] = {}
    for r in sums:
        out.setdefault(r.lang, np.zeros(DIM))[r.i] = float(r.x)
    return {k: v / (np.linalg.norm(v) or 1.0) for k, v in sorted(out.items())}


def identify(docs: DataFrame, protos: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score`` (the cosine, at least 0).

    Null texts, texts without letters and any text where no language was learned
    are ``und`` with score 0.  Ties go to the language first in order.
    """
    names = list(protos)
    matrix = np.array([protos[k] for k in names], np.float32) if names else np.zeros((0, DIM), np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))
    schema = docs.select(*keep).schema

    def run(batches):
        import pyarrow as pa

        tri = trigrams()
        langs, protos = shared.value
        for batch in batches:
            found, scores = [], []
            for text in batch.column("__text").to_pylist():
                vector = tri.bundle(text) if langs else None
                if vector is None:
                    found.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                cosines = protos @ vector / max(float(np.linalg.norm(vector)), 1e-30)
                best = int(np.argmax(cosines))
                found.append(langs[best])
                scores.append(float(min(max(cosines[best], 0.0), 1.0)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(found, pa.string()), pa.array(scores)],
                [*keep, "lang_pred", "score"])

    return docs.select(*keep, common.text_bytes().alias("__text")).mapInArrow(
        run, schema.add("lang_pred", "string").add("score", "double"))


def languages(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    held_out: crc32(doc_id as text) mod 5 is 0; prototypes come from all other
    rows with a language.  Predictions read the text alone.
    """
    protos = prototypes(docs.filter(common.bucket_of(docs, 5) != 0))
    out = identify(docs.select("doc_id", "text"), protos, ["doc_id"])
    return out.select("doc_id", (common.bucket_of(out, 5) == 0).alias("held_out"), "lang_pred", "score")
