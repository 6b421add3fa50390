"""Encoding and decoding with a sentencepiece BPE model file, without the library's encoder.

Only the vocabulary (pieces, scores, kinds) is taken from the model.  A text is
normalised as the model's ``identity`` rule does (a dummy prefix and spaces
shown as U+2581).  No piece joins a character with a U+2581 after it, so a text
falls apart into words (a run of U+2581 and what follows it) that are encoded
apart, each distinct word once per Python worker's memory.

Encoding of a batch of distinct words runs in merge rounds over flat numpy
arrays: symbol ids, and the word each symbol belongs to.  A round looks up the
rank of every adjacent pair of a word, takes the smallest rank of each word
(segmented minimum), merges that pair wherever it stands in the word, leftmost
first and without overlap, in all words at once, and compacts the arrays; words
without a known pair leave.  The reference order merges one pair at a time, the
leftmost of the best rank; merging all of them at once differs only where a
merge makes a new pair of a better rank.  In such a word that merge is the last
of the round, so the result is the same.

Characters without a piece become byte pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np

from salespark.llm import common

SPACE = "▁"
#: Remembered words per Python worker; beyond it the memory starts afresh.
WORDS_KEPT = 400_000
_BIG = np.int64(1) << 60
_SLOT_BITS = 20
_SLOTS = 1 << _SLOT_BITS


class PieceBPE:
    """Vocabulary and merge tables of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(" a  b ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}":
            raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece joins words; words can't be encoded apart")
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        scores = np.array([sp.get_score(i) for i in range(n)])
        # rank of a piece: by score, ties (none in practice) share a rank
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.n = n
        # symbols: piece ids, then single characters without a piece
        self.extra: dict[str, int] = {}
        lefts, rights, made = [], [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    lefts.append(a)
                    rights.append(b)
                    made.append(i)
        self._fill_tables(np.array(lefts, np.int64) * n + np.array(rights, np.int64),
                          np.array(made, np.int64))
        # what ids decode to
        self.shown = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i)
                      else bytes([int(p[3:5], 16)]) if sp.is_byte(i)
                      else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        # adjacent characters inside some piece
        self.joined = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.words: dict[str, bytes] = {}

    def _fill_tables(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Hash tables of the pairs: keys that share a slot go to the next table."""
        self.tables = []
        while len(keys):
            slots = self._slot(keys, len(self.tables))
            table_keys, table_made = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, -1, np.int64)
            table_keys[slots], table_made[slots] = keys, made  # the last one stays
            self.tables.append((table_keys, table_made))
            rest = table_keys[slots] != keys
            keys, made = keys[rest], made[rest]

    @staticmethod
    def _slot(keys: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x5851F42D4C957F2D * table
                                                       & 0xFFFFFFFFFFFFFFFF)
        return (mixed >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged piece id of symbol pairs, -1 where there is none."""
        keys = np.where((left < self.n) & (right < self.n), left * self.n + right, -2)
        out = np.full(len(keys), -1, np.int64)
        for table, (table_keys, table_made) in enumerate(self.tables):
            slots = self._slot(keys, table)
            same = table_keys[slots] == keys
            out[same] = table_made[slots[same]]
        return out

    def _ranked(self, made: np.ndarray) -> np.ndarray:
        return np.where(made >= 0, self.rank[made], _BIG)

    def _symbol(self, ch: str) -> int:
        i = self.ids.get(ch)
        if i is None:
            i = self.extra.setdefault(ch, self.n + len(self.extra))
        return i

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian u32) of each word, by merge rounds over all of them."""
        if not words:
            return []
        if len(self.extra) > 100_000:
            self.extra.clear()
        chars = "".join(words)
        distinct = {c: self._symbol(c) for c in set(chars)}
        sym = np.fromiter(map(distinct.__getitem__, chars), np.int64, len(chars))
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done_sym, done_word = [], []
        made = np.full(len(sym), -1, np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        made[inner] = self._pairs(sym[inner], sym[inner + 1])
        rank = self._ranked(made)
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            if (best == _BIG).any():  # words without a pair leave
                over = np.repeat(best == _BIG, lengths)
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, made, rank = (x[~over] for x in (sym, word, made, rank))
                if not len(sym):
                    break
                lengths, best = lengths[best < _BIG], best[best < _BIG]
                starts = np.cumsum(lengths) - lengths
            hit = _leftmost(rank == np.repeat(best, lengths))
            at = np.flatnonzero(hit)
            at = at[~self._after_better(sym, word, made, rank, hit, at)]
            kept = np.ones(len(sym), bool)
            kept[at + 1] = False
            sym[at] = made[at]
            now = np.cumsum(kept)[at] - 1
            sym, word, made, rank = sym[kept], word[kept], made[kept], rank[kept]
            touched = np.zeros(len(sym), bool)
            touched[now] = True
            touched[now[now > 0] - 1] = True
            changed = np.flatnonzero(touched)
            made[changed] = -1
            inner = changed[changed + 1 < len(sym)]
            inner = inner[word[inner] == word[inner + 1]]
            made[inner] = self._pairs(sym[inner], sym[inner + 1])
            rank[changed] = self._ranked(made[changed])
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return self._packed(sym[order], word[order], len(words))

    def _packed(self, sym, word, n) -> list[bytes]:
        """Ids of each word as little-endian u32; unknown characters as byte pieces."""
        ends = np.searchsorted(word, np.arange(n), side="right")
        flat = sym.astype("<u4").tobytes()
        cuts = (4 * ends).tolist()
        out = [flat[a:b] for a, b in zip([0, *cuts], cuts)]
        unknown = {i: [self.byte_ids[b] for b in c.encode()] for c, i in self.extra.items()}
        for w in np.unique(word[sym >= self.n]).tolist():
            ids = sym[ends[w - 1] if w else 0:ends[w]].tolist()
            ids = [x for i in ids for x in unknown.get(i, (i,))]
            out[w] = np.array(ids, "<u4").tobytes()
        return out

    def _after_better(self, sym, word, made, rank, hit, at) -> np.ndarray:
        """Of the merges at ``at``: those of a word after its first merge that
        makes a pair of a better rank.  In the reference order that pair is next."""
        if len(at) < 2 or not (word[at[1:]] == word[at[:-1]]).any():
            return np.zeros(len(at), bool)
        n, merged, own = len(sym), made[at], rank[at]
        better = np.zeros(len(at), bool)
        after = np.minimum(at + 2, n - 1)
        has = (at + 2 < n) & (word[after] == word[at])
        better[has] = self._ranked(self._pairs(merged[has], sym[after[has]])) < own[has]
        before = np.maximum(at - 1, 0)
        left = np.where((at >= 2) & hit[np.maximum(at - 2, 0)], made[np.maximum(at - 2, 0)], sym[before])
        has = (at >= 1) & (word[before] == word[at])
        better[has] |= self._ranked(self._pairs(left[has], merged[has])) < own[has]
        first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
        count = np.cumsum(better) - better  # earlier merges, of any word, with a better pair
        base = np.repeat(count[first], np.diff(np.append(np.flatnonzero(first), len(at))))
        return count > base

    def split(self, text: str) -> list[str]:
        """Words of the normalised text: a run of U+2581 and what follows."""
        if not text:
            return []
        parts = (" " + text).replace(SPACE, " ").split(" ")[1:]
        if "" not in parts:
            return [SPACE + p for p in parts]
        out, lead = [], ""
        for p in parts:
            lead += SPACE
            if p:
                out.append(lead + p)
                lead = ""
        return out + [lead] if lead else out

    def learn(self, texts: list[list[str]]) -> None:
        """Put every word of these texts into ``words`` (word -> ids as u32 bytes)."""
        need = set().union(*texts)
        new = need.difference(self.words)
        if len(self.words) + len(new) > WORDS_KEPT:
            self.words = {w: self.words[w] for w in need if w in self.words}
        # a closing mark that no piece joins to the character before it stands alone
        marked = [w for w in new if w[-1] in ".," and w[-2:] not in self.joined]
        plain = new.difference(marked)
        plain.update([w[:-1] for w in marked], ".,")
        plain = list(plain.difference(self.words))
        for k in range(0, len(plain), 50_000):
            part = plain[k:k + 50_000]
            self.words.update(zip(part, self.encode_words(part)))
        known = self.words
        known.update([(w, known[w[:-1]] + known[w[-1]]) for w in marked])

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        self.learn([words])
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4").tolist()

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, U+2581 as space, one leading space dropped."""
        out = b"".join([self.shown[i] for i in ids])
        return _as_text(out[1:] if out[:1] == b" " else out)


def _as_text(data: bytes) -> str:
    """UTF-8 bytes as text; each byte of no valid character becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        import codecs

        def one(err):
            return "�" * (err.end - err.start), err.end

        codecs.register_error("piece-each-byte", one)
        return data.decode("utf-8", "piece-each-byte")


def _leftmost(hit: np.ndarray) -> np.ndarray:
    """Of adjacent hits (overlapping pairs) every second one, from the left."""
    run_start = hit & ~np.concatenate([[False], hit[:-1]])
    at = np.arange(len(hit))
    start = np.maximum.accumulate(np.where(run_start, at, 0))
    return hit & ((at - start) % 2 == 0)


def model(path: str) -> PieceBPE:
    """The model of this Python worker for a file."""
    return common.memo(("piecebpe", path), lambda: PieceBPE(path))

#: Documents and characters that are split and encoded at a time.
_DOCS, _CHARS = 512, 4_000_000


def _groups(texts: list[str]):
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and end - at < _DOCS and (end == at or chars + len(texts[end]) <= _CHARS):
            chars += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def encode_texts(m: PieceBPE, texts: list[str]):
    """Ids of each text."""
    for group in _groups(texts):
        lists = [m.split(t) for t in group]
        m.learn(lists)
        word = m.words.__getitem__
        for words in lists:
            yield np.frombuffer(b"".join(map(word, words)), "<u4").tolist()


def round_trip(path: str):
    """mapInArrow function: (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256."""
    def run(batches):
        import pyarrow as pa

        m = model(path)
        decimal = [str(i) for i in range(m.n)]
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for ids in encode_texts(m, batch.column("text").to_pylist()):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                of_text.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encode(docs, path: str):
    """(doc_id, ids array<int>) of every whole text; a null text has no ids."""
    from pyspark.sql import functions as F

    def run(batches):
        import pyarrow as pa

        m = model(path)
        for batch in batches:
            ids = list(encode_texts(m, batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded, path: str):
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""
    def run(batches):
        import pyarrow as pa

        m = model(path)
        for batch in batches:
            texts = [m.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digest(docs, path: str):
    """One row per row of ``docs`` (nulls and repeats kept): doc_id, n_tokens,
    ids_sha256 (decimal ids joined by commas), decoded_sha256 (the decoded text)."""
    from pyspark.sql import functions as F

    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(round_trip(path),
                            "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
