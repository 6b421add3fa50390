"""Whole-text encoding with a word-level BPE file of the tokenizers library.

The tokenizer of ``word_bpe_49k.json`` drops white space and never joins
characters across it, so a text's ids are the ids of its white-space separated
words, one after the other.  Most words are plain: Latin letters, maybe a full stop
or comma behind; these are two pieces, lower-cased letters and the mark, which go
straight to the library's BPE model.  So do the pieces of words of printable ASCII
and accented letters (runs of letters, single digits, runs of the rest).  All
other words (apostrophes, special-token strings, other scripts, combining marks) go
through the library's whole pipeline.

Texts are split, words numbered and plain ones told apart column by column (Arrow),
so each distinct piece of ``NUMBERED`` bytes of texts is looked up once; the ids of
all words are then gathered by numpy, ``SLICE`` bytes at a time.  What a Python worker remembers is a dict from
pieces met to their packed ids, so a look-up costs as much whatever is remembered.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

END_ID = 2
#: Pieces that a Python worker remembers (about 140 bytes each); before that it would be more, it starts afresh.
PIECES_KEPT = 500_000
#: Longer pieces (bytes) seldom recur and aren't remembered.
LONGEST_KEPT = 24
#: Bytes of texts whose words are numbered at a time.
NUMBERED = 6_000_000
#: Bytes of texts whose ids are gathered at a time; a longer text is cut at white space.
SLICE = 2_000_000

_LETTERS = "^[A-Za-zÀ-ÖØ-öø-įı-ſ]+$"
_PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-įı-ſ]+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PIECES = re.compile(r"[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBPE:
    """Encoder of a tokenizer file, and the pieces it remembers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}  # packed ids of remembered pieces
        self.always = [[], [END_ID], self.piece("."), self.piece(",")]  # no mark, end, marks

    def piece(self, piece: str) -> list[int]:
        """Ids of a run of letters, a digit, or a run of the rest, in lower case."""
        shown = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return [t.id for t in self.model.tokenize(shown)]

    def word(self, word: bytes) -> list[int]:
        """Ids of any word."""
        if _PLAIN.fullmatch(text := word.decode("utf-8", "replace")):
            return [i for p in _PIECES.findall(text.lower()) for i in self.piece(p)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids if text else []

    def packed(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of distinct pieces; new ones are learned."""
        found = list(map(self.known.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        if len(self.known) + len(new) > PIECES_KEPT:
            self.known.clear()
        learned = [self.piece(pieces[i].decode()) for i in new]
        ids = np.fromiter(chain.from_iterable(learned), self.dtype).tobytes()
        ends = np.cumsum([0, *map(len, learned)]) * self.dtype.itemsize
        for i, start, end in zip(new, ends.tolist(), ends[1:].tolist()):
            found[i] = self.known[pieces[i]] = ids[start:end]
        return found

    def encode(self, text: bytes) -> bytes:
        """Packed ids of a whole text, the end id appended."""
        import pyarrow as pa

        return encoded_column(self, pa.array([text], pa.binary()))[0].as_py()


def encoder(path: str) -> WordBPE:
    """The encoder of this Python worker for a tokenizer file."""
    from salespark.llm import common

    return common.memo(("wordbpe", path), lambda: WordBPE(path))


def encoded_column(enc: WordBPE, texts):
    """A binary column of texts as a binary column of packed ids, end ids appended."""
    import pyarrow as pa

    return pa.concat_arrays([pa.array([], pa.binary()), *encoded_parts(enc, texts)])


def encoded_parts(enc: WordBPE, texts):
    """The column of packed ids in parts, one after the other."""
    import pyarrow as pa

    if not len(texts):
        return
    texts = texts.cast(pa.binary())
    sizes = _sizes(texts)
    for at, stop in _runs(np.where(sizes > SLICE, NUMBERED + 1, sizes), NUMBERED):
        if sizes[at] > SLICE:  # one text
            yield pa.array([_long(enc, texts[at].as_py())], pa.binary())
        else:
            yield from _encoded_run(enc, texts.slice(at, stop - at))


def _sizes(texts) -> np.ndarray:
    """Bytes of each value of a binary column."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    return np.diff(ends.astype(np.int64))


def _runs(sizes: np.ndarray, most: int):
    """Values one after the other, in runs of at most ``most`` bytes (a larger value alone)."""
    ends, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        stop = max(int(np.searchsorted(ends, ends[at] + most, side="right")) - 1, at + 1)
        yield at, stop
        at = stop


def _long(enc: WordBPE, text: bytes) -> bytes:
    """A text longer than a slice, cut at white space."""
    import pyarrow as pa

    out, at = [], 0
    while at < len(text):
        space = _SPACE.search(text, at + SLICE)
        stop = space.start() if space else len(text)
        ids = next(_encoded_run(enc, pa.array([text[at:stop]], pa.binary())))[0].as_py()
        out.append(ids[:-enc.dtype.itemsize])
        at = stop
    return b"".join(out) + np.array([END_ID], enc.dtype).tobytes()


def _values(column) -> list[bytes]:
    """Values of a column of words, none of which holds white space."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(column):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.view(pa.binary()))
    return pc.binary_join(whole, b" ")[0].as_py().split(b" ")


def _plain(words):
    """Of a column of distinct words: which are plain, their letters in lower case, and
    how many marks stand behind."""
    import pyarrow as pa
    import pyarrow.compute as pc

    core = pc.ascii_rtrim(words, characters=".,")
    tail = pc.subtract(pc.binary_length(words), pc.binary_length(core)).to_numpy()
    try:
        words.validate(full=True)
        letters, lower = pc.match_substring_regex(core, _LETTERS), pc.utf8_lower(core)
    except pa.ArrowInvalid:  # not UTF-8
        letters, lower = pc.ascii_is_alpha(core), pc.ascii_lower(core)
    short = pc.less_equal(pc.binary_length(core), LONGEST_KEPT)
    return pc.and_(letters, short).to_numpy(zero_copy_only=False) & (tail <= 1), lower, tail


def _encoded_run(enc: WordBPE, texts):
    """Packed ids of texts whose words are numbered together, in columns of ``SLICE`` bytes of texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(texts.view(pa.string()))
    numbered = lists.flatten().dictionary_encode()
    words = numbered.dictionary
    plain, lower, tail = _plain(words)
    cores = lower.filter(pa.array(plain)).dictionary_encode()
    others = [enc.word(w) for w in words.view(pa.binary()).filter(pa.array(~plain)).to_pylist()]
    pieces = enc.packed(_values(cores.dictionary))
    # units: the run's pieces, then what every run has, then the other words
    extra = [*enc.always, *others]
    sizes = np.concatenate([np.fromiter(map(len, pieces), np.int32, len(pieces)) // enc.dtype.itemsize,
                            np.fromiter(map(len, extra), np.int32, len(extra))])
    starts = np.cumsum(sizes, dtype=np.int32) - sizes
    ids = np.concatenate([np.frombuffer(b"".join(pieces), enc.dtype),
                          np.fromiter(chain.from_iterable(extra), enc.dtype)])
    none, end, stop, comma = range(len(pieces), len(pieces) + len(enc.always))
    # a word is two units: its letters or itself, and its mark or none
    units = np.full((len(words), 2), none, np.int32)
    units[plain, 0] = cores.indices.to_numpy()
    units[~plain, 0] = none + len(enc.always) + np.arange(len(others))
    marked = plain & (tail == 1)
    if marked.any():
        last = pc.ends_with(words, ",").to_numpy(zero_copy_only=False)
        units[marked, 1] = np.where(last[marked], comma, stop)
    # every text's words, then the end id
    number = numbered.indices.to_numpy()
    bounds = np.concatenate([[0], lists.value_lengths().to_numpy().cumsum()])
    for first, last in _runs(_sizes(texts), SLICE):
        marks = 2 * (bounds[first + 1:last + 1] - bounds[first])
        unit = np.insert(units[number[bounds[first]:bounds[last]]].ravel(), marks, end)
        many = sizes[unit]
        after = np.cumsum(many, dtype=np.int32)
        out = ids[np.repeat(starts[unit] - (after - many), many) + np.arange(after[-1], dtype=np.int32)]
        offsets = np.concatenate([[0], after[marks + np.arange(len(marks))]]) * enc.dtype.itemsize
        yield pa.Array.from_buffers(
            pa.binary(), last - first, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def encode_batches(path: str, keep: list[str]):
    """mapInArrow function: column ``text`` (binary) -> ``ids`` (packed), other
    columns of ``keep`` as they are."""
    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            at = 0
            for ids in encoded_parts(enc, batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(at, len(ids)) for k in keep] + [ids], [*keep, "ids"])
                at += len(ids)
    return run


def ids_as_u32(ids: bytes, dtype: np.dtype) -> bytes:
    """Packed ids widened to little-endian unsigned 32-bit."""
    return np.frombuffer(ids, dtype).astype("<u4").tobytes()


def id_dtype(path: str) -> np.dtype:
    """Width of the packed ids of a tokenizer file."""
    return encoder(path).dtype


def encode(docs, path: str):
    """(doc_id, ids): packed ids of every whole text (null: empty) and the end id."""
    from pyspark.sql import functions as F

    from salespark.llm import common

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text")).mapInArrow(
        encode_batches(path, ["doc_id"]), "doc_id long, ids binary")
