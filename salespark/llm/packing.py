"""Lexical retrieval packing.

Documents are encoded (``wordbpe``) and dealt out by content into shards: the
leaves of a tree of median splits (``Tree``), learned from a bounded sample, over
random projections of the documents' BM25 weights.  A shard is packed in blocks of
at most ``BLOCK_DOCS`` documents, each with its own BM25 inverted index over token
ids; document frequencies, document count and average length are those of the
whole corpus (one row a token id, so their size is bounded by the vocabulary).
Retrieval does not look outside a block: a neighbour that the tree sent to
another shard is not found (the README has the measured share).

A window begins with a seed, the first document that is not yet used.  The index
returns the unused documents of the block by their BM25 score for the seed's
terms, and the window takes them in that order.  The document that no longer
fits is cut; what is left of it is the next seed.  Documents longer than a
window fill whole windows first.  So every window but a block's last is full.
The last tokens of a block are cut at powers of two (their binary digits), so
they need no padding either.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespark.llm import common, wordbpe

WINDOW = 4096
#: Documents of a shard on average, and of an index at most.
SHARD_DOCS, BLOCK_DOCS = 1024, 2048
#: Tokens of a block, about; a block is closed when it holds more.
BLOCK_TOKENS = 16_000_000
K1, B = 1.2, 0.75
#: Bytes of packed ids of a partition, about; it holds several shards.
PARTITION_BYTES = 8 << 20
#: Components of a projected document; documents that the tree is learned from.
PROJECTED, SAMPLE_DOCS = 64, 65_536
#: Rows of a batch taken out of Arrow at a time; bytes of packed ids that leave a task at a time, about.
ROWS_AT_ONCE, BYTES_AT_ONCE = 512, 1 << 20

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long")


def rows_of(batches, *columns: str):
    """Rows of Arrow batches as Python values, ``ROWS_AT_ONCE`` at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield [batch.column(c).slice(at, ROWS_AT_ONCE).to_pylist() for c in columns]


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's terms in order and how often each stands there (a radix sort for 16-bit ids)."""
    ids = np.sort(ids, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[new], np.diff(np.append(new, len(ids)).astype(np.int32))


def corpus_statistics(tokens: DataFrame, dtype: np.dtype) -> tuple[int, int, np.ndarray]:
    """(documents, tokens, document frequency by token id) over all documents."""
    def run(batches):
        import pyarrow as pa

        held, docs, total = np.zeros(1 << 16, np.int64), 0, 0
        common.forget()  # the encoder: its work is done
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                terms, _ = distinct(np.frombuffer(ids, dtype))
                if terms[-1] >= len(held):
                    held = np.concatenate([held, np.zeros(2 * int(terms[-1]) - len(held) + 2, np.int64)])
                held[terms] += 1
                docs += 1
                total += len(ids) // dtype.itemsize
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([at, [-2, -1]])), pa.array(np.concatenate([held[at], [docs, total]]))],
            ["term", "n"])

    rows = (tokens.select("ids").mapInArrow(run, "term long, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())  # one a vocabulary entry
    counts = {r.term: r.n for r in rows}
    docs, total = counts.pop(-2, 0), counts.pop(-1, 0)
    held = np.zeros(max(counts, default=0) + 1, np.int64)
    held[list(counts)] = list(counts.values())
    return docs, total, held


class Projection:
    """Documents as unit vectors: random projections of their BM25 weights."""

    def __init__(self, idf: np.ndarray, average: float):
        self.idf, self.average = idf, average
        self.axes = np.random.default_rng(7).standard_normal((len(idf), PROJECTED), np.float32)

    def vectors(self, docs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(docs), PROJECTED), np.float32)
        for k, ids in enumerate(docs):
            terms, tf = distinct(ids)
            norm = K1 * (1 - B + B * len(ids) / self.average)
            weights = (self.idf[terms] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
            vector = weights @ self.axes.take(terms, axis=0)
            out[k] = vector / (float(np.linalg.norm(vector)) or 1.0)
        return out


class Tree:
    """Shards by content: a node splits its sample at the median along the direction
    of the largest spread, until a leaf stands for about ``size`` documents.  A leaf
    that no direction splits (copies) is dealt out by a hash into as many shards as
    it needs."""

    def __init__(self, sample: np.ndarray, documents: int, size: int = SHARD_DOCS):
        each = documents / max(len(sample), 1)  # documents that a sampled one stands for
        self.axes, self.cuts, self.next, self.parts = [], [], [], []
        self._grow(sample.astype(np.float64), each, size)
        self.axes, self.cuts = np.array(self.axes, np.float32), np.array(self.cuts, np.float32)
        self.next, self.parts = np.array(self.next), np.array(self.parts)
        self.first = np.cumsum(self.parts) - self.parts
        self.shards = int(self.parts.sum())

    def _grow(self, sample: np.ndarray, each: float, size: int) -> int:
        at = len(self.cuts)
        self.axes.append(np.zeros(PROJECTED))
        self.cuts.append(0.0)
        self.next.append((-1, -1))
        self.parts.append(0)
        if len(sample) > 1 and len(sample) * each > 1.5 * size:
            apart = sample - sample.mean(axis=0)
            axis = np.linalg.eigh(apart.T @ apart)[1][:, -1].astype(np.float32)
            along = sample.astype(np.float32) @ axis
            cut = np.median(along).astype(np.float32)
            right = along > cut
            if right.any() and np.ptp(along) > 1e-4:
                self.axes[at], self.cuts[at] = axis, cut
                self.next[at] = (self._grow(sample[~right], each, size), self._grow(sample[right], each, size))
                return at
        self.parts[at] = max(1, round(len(sample) * each / size))
        return at

    def shard_of(self, vectors: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        while len(at := np.flatnonzero(self.next[node, 0] >= 0)):
            here = node[at]
            right = np.einsum("ij,ij->i", vectors[at], self.axes[here]) > self.cuts[here]
            node[at] = self.next[here, right.astype(np.int64)]
        return self.first[node] + hashes % self.parts[node]


def content_tree(tokens: DataFrame, stats, dtype: np.dtype, documents: int) -> Tree:
    """The tree over a sample of the encoded documents, chosen by a hash of the row."""
    def run(batches):
        import pyarrow as pa

        common.forget()
        projection = Projection(*stats.value)
        for batch in batches:
            found = projection.vectors([np.frombuffer(i, dtype) for i in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([v.tobytes() for v in found], pa.binary())], ["doc_id", "vector"])

    if documents <= 1.5 * SHARD_DOCS:
        return Tree(np.zeros((0, PROJECTED)), 0)
    if documents > SAMPLE_DOCS:
        share = int(SAMPLE_DOCS / documents * (1 << 30))
        tokens = tokens.filter(F.pmod(F.xxhash64("doc_id", "ids", F.lit(3)), F.lit(1 << 30)) < share)
    rows = tokens.mapInArrow(run, "doc_id long, vector binary").orderBy("doc_id", "vector").toArrow()
    flat = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float32)
    return Tree(flat.reshape(-1, PROJECTED), documents)


def _deal(stats, tree, dtype: np.dtype):
    """mapInArrow over (doc_id, ids, hash): (shard, doc_id, ids)."""
    def run(batches):
        import pyarrow as pa

        common.forget()
        projection = Projection(*stats.value)
        for batch in batches:
            docs = [np.frombuffer(i, dtype) for i in batch.column("ids").to_pylist()]
            shards = tree.value.shard_of(projection.vectors(docs), batch.column("hash").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), batch.column("doc_id"), batch.column("ids")], ["shard", "doc_id", "ids"])
    return run


class Block:
    """Documents of a block and their inverted index."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, average: float):
        sizes = np.array([len(d) for d in docs])
        found = [distinct(d) for d in docs]
        term, tf = np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found])
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), [len(t) for t, _ in found])
        del found
        by_term = np.argsort(term, kind="stable")
        term, tf, self.units = term[by_term], tf[by_term], owner[by_term]
        del by_term, owner
        norm = K1 * (1 - B + B * sizes / average)
        weights = idf[term]
        weights *= tf
        weights *= K1 + 1
        weights /= tf + norm[self.units]
        self.weights = weights.astype(np.float32)
        del weights, tf
        # postings lie by term; a document's terms point at their postings
        new = np.concatenate([[True], term[1:] != term[:-1]])
        self.starts = np.flatnonzero(new)
        self.lengths = np.diff(np.append(self.starts, len(term)))
        number = np.cumsum(new, dtype=np.int32) - 1
        self.doc_terms = number[np.argsort(self.units, kind="stable")]
        self.doc_ends = np.cumsum(np.bincount(self.units, minlength=len(docs)))
        self.n = len(docs)
        # terms that many documents hold are kept as rows of weights for all documents
        often = np.flatnonzero(self.lengths > max(len(docs) // 12, 1))
        self.row = np.full(len(self.lengths), -1, np.int64)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), len(docs)), np.float32)
        at = np.flatnonzero(self.row[number] >= 0)
        self.rows[self.row[number[at]], self.units[at]] = self.weights[at]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the block for the seed's terms."""
        terms = self.doc_terms[(self.doc_ends[seed - 1] if seed else 0):self.doc_ends[seed]]
        row = self.row[terms]
        score = self.rows[row[row >= 0]].sum(axis=0, dtype=np.float64)
        terms = terms[row < 0]
        if len(terms):
            lengths = self.lengths[terms]
            ends = np.cumsum(lengths)
            at = np.arange(ends[-1]) + np.repeat(self.starts[terms] - (ends - lengths), lengths)
            score += np.bincount(self.units[at], self.weights[at], self.n)
        return score


def pack_block(docs: list[np.ndarray], idf: np.ndarray, average: float, window: int = WINDOW):
    """Sequences of a block: lists of (document, start, length)."""
    block = Block(docs, idf, average)
    sizes = np.array([len(d) for d in docs])
    begun = np.zeros(len(docs), np.int64)  # tokens already placed
    left = np.ones(len(docs), bool)
    at_seed, seed, tail = 0, None, []
    while True:
        if seed is None:
            while at_seed < len(docs) and not left[at_seed]:
                at_seed += 1
            if at_seed == len(docs):
                break
            seed = at_seed
        while sizes[seed] - begun[seed] >= window:
            yield [(seed, int(begun[seed]), window)]
            begun[seed] += window
        left[seed] = False
        room = window - int(sizes[seed] - begun[seed])
        pieces = [(seed, int(begun[seed]), window - room)] if room < window else []
        if not pieces:
            seed = None
            continue
        taken, seed = seed, None
        if room:
            score = np.where(left, block.scores(taken), -1.0)
            for near in _ranked(score, left):
                take = min(room, int(sizes[near]))
                pieces.append((near, 0, take))
                left[near], begun[near] = False, take
                room -= take
                if take < sizes[near]:
                    seed = near
                if not room:
                    break
        if room:
            tail = pieces
            break
        yield pieces
    yield from _powers(tail)


def _ranked(score: np.ndarray, left: np.ndarray):
    """Unused documents by falling score, ties by place; found a few at a time."""
    n, done = int(left.sum()), 0
    many = 16
    while done < n:
        many = min(many, n)
        cut = np.partition(score, len(score) - many)[len(score) - many]
        at = np.flatnonzero((score >= cut) & (score >= 0))
        at = at[np.argsort(-score[at], kind="stable")]
        yield from at[done:].tolist()
        done = len(at)
        many *= 8


def _powers(pieces: list[tuple[int, int, int]]):
    """The last pieces of a block as sequences whose lengths are powers of two."""
    rest = sum(p[2] for p in pieces)
    pieces = list(pieces)
    while rest:
        room = 1 << (rest.bit_length() - 1)
        rest -= room
        out = []
        while room:
            doc, start, length = pieces.pop(0)
            take = min(room, length)
            out.append((doc, start, take))
            if take < length:
                pieces.insert(0, (doc, start + take, length - take))
            room -= take
        yield out


def _pack(stats, dtype: np.dtype, window: int, payload: bool):
    """mapInArrow over rows sorted by shard and doc_id: the pieces of their sequences."""
    def run(batches):
        import pyarrow as pa

        common.forget()
        idf, average = stats.value
        names, docs, held, now, sequence = [], [], 0, None, 0
        columns = [c.split()[0] for c in PIECES.split(", ")]

        def part(rows):
            arrays = [pa.array(r, pa.int64()) for r in rows[:8]]
            if payload:
                return pa.RecordBatch.from_arrays([*arrays, pa.array(rows[8], pa.binary())], [*columns, "ids"])
            return pa.RecordBatch.from_arrays(arrays, columns)

        def close():
            nonlocal sequence
            rows, size_held = [[] for _ in range(9)], 0
            for pieces in pack_block(docs, idf, average, window):
                offset, length = 0, sum(p[2] for p in pieces)
                for doc, start, size in pieces:
                    ids = docs[doc][start:start + size].astype("<u4").tobytes()
                    for row, value in zip(rows, (names[doc], start, size, zlib.crc32(ids), len(docs[doc]),
                                                 sequence, offset, length, ids)):
                        row.append(value)
                    offset += size
                sequence += 1
                size_held += 4 * length
                if size_held >= BYTES_AT_ONCE:
                    yield part(rows)
                    rows, size_held = [[] for _ in range(9)], 0
            if rows[0]:
                yield part(rows)

        for some in rows_of(batches, "shard", "doc_id", "ids"):
            for shard, name, ids in zip(*some):
                if shard != now:
                    if docs:
                        yield from close()
                        names, docs, held = [], [], 0
                    now, sequence = shard, shard << 32
                names.append(name)
                docs.append(np.frombuffer(ids, dtype))
                held += len(docs[-1])
                if len(docs) >= BLOCK_DOCS or held >= BLOCK_TOKENS:
                    yield from close()
                    names, docs, held = [], [], 0
        if docs:
            yield from close()
    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, payload: bool = True) -> DataFrame:
    """Pieces of sequences of at most ``window`` tokens that hold every id once.

    One row a piece: doc_id, start (ids of the document before it), length,
    ids_crc32 (of its ids as little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, sequence_length, and with ``payload`` the ids so packed.
    Null texts are empty and have the end id alone; repeated rows and null
    doc_ids are packed like any other; an empty table gives no rows.
    """
    dtype = wordbpe.id_dtype(tokenizer)
    tokens = common.written(wordbpe.encode(docs, tokenizer), "tokens")
    n, total, held = corpus_statistics(tokens, dtype)
    idf = np.log(1 + (n - held + 0.5) / (held + 0.5))
    stats = docs.sparkSession.sparkContext.broadcast((idf, max(total / max(n, 1), 1.0)))
    schema = PIECES + (", ids binary" if payload else "")
    tree = content_tree(tokens, stats, dtype, n)
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)).alias("hash")
    return (tokens.select("doc_id", "ids", key)
            .mapInArrow(_deal(stats, shared, dtype), "shard long, doc_id long, ids binary")
            .repartition(max(1, min(tree.shards, -(-total * dtype.itemsize // PARTITION_BYTES))), "shard")
            .sortWithinPartitions("shard", "doc_id", "ids")
            .mapInArrow(_pack(stats, dtype, window, payload), schema))
