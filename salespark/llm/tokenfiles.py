"""Token-id files with a minimal perfect hash index.

A corpus is encoded (``wordbpe``), put in ascending key order and written as
shards.  Each shard is two files:

* ``*.ids``: the raw payload, little-endian unsigned ids of the shard's
  documents one after the other (16 bits where the vocabulary allows it);
* ``*.mph``: the index.  A minimal perfect hash function maps every key of the
  shard to a slot of its own in 0..n-1; the slot holds a 32-bit fingerprint of
  the key, the document's offset in the payload (in ids) and its length.  The
  keys themselves are not stored: a lookup computes the slot in constant time
  and compares the fingerprint, so an absent key is refused but for a chance
  of 2**-32.

The hash function has levels of bit arrays: a key that shares its bit with no
other key of its level is placed there, the rest go to the next level; the
slot is the rank of the bit.

A Parquet manifest, written by Spark's committer, names the files of the task
attempts that counted; files of lost attempts are never named.  The shards are
range partitions by key, so start offsets of whole shards follow from one row
per shard.

Keys are (doc_id, occurrence): repeated doc_ids are told apart by their
occurrence number (ordered by their ids), null doc_ids come first.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salespark.llm import common, wordbpe

#: Documents of a shard on average; raise it with the corpus (a shard is
#: streamed to its file, only its index is built in memory, 40 bytes a document).
SHARD_ROWS = 8192

_MAGIC = b"SPMPH001"
_GAMMA = 2.0
_U64 = np.uint64

MANIFEST = ("shard long, ids_path string, mph_path string, n_docs long, n_tokens long, "
            "first_key long, width int")


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (bijective for each seed)."""
    with np.errstate(over="ignore"):
        x = x + _U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


def key_hashes(doc_ids: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray,
               salt: int) -> np.ndarray:
    """64-bit hashes of (doc_id or null, occurrence)."""
    base = mix(doc_ids.astype(np.int64).view(_U64), 3 * salt)
    base = np.where(nulls, mix(np.full(1, 77, _U64), 3 * salt + 1)[0], base)
    return base ^ mix(occurrence.astype(_U64) + nulls.astype(_U64) * _U64(1 << 40), 3 * salt + 2)


class PerfectHash:
    """Minimal perfect hash function over distinct 64-bit hashes."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        counts = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(counts)])[:-1]

    @classmethod
    def build(cls, hashes: np.ndarray) -> "PerfectHash":
        sizes, parts, rest = [], [], hashes
        while len(rest):
            size = max(64, -(-int(_GAMMA * len(rest)) // 64) * 64)
            at = (mix(rest, 1000 + len(sizes)) % _U64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[at]]
        words = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        return cls(np.array(sizes, np.int64), words)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash; -1 where no level claims it (surely absent)."""
        out = np.full(len(hashes), -1, np.int64)
        open_at = np.arange(len(hashes))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_at):
                break
            h = hashes[open_at]
            bit = self.starts[level] + (mix(h, 1000 + level) % _U64(size)).astype(np.int64)
            word, inside = self.words[bit >> 6], (bit & 63).astype(_U64)
            hit = (word >> inside) & _U64(1) == 1
            below = word & ((_U64(1) << inside) - _U64(1))
            slot = self.ranks[bit >> 6] + np.bitwise_count(below)
            out[open_at[hit]] = slot[hit]
            open_at = open_at[~hit]
        return out


def index_bytes(doc_ids, nulls, occurrence, lengths) -> bytes:
    """The .mph file of a shard whose documents stand in this order."""
    for salt in range(64):
        hashes = key_hashes(doc_ids, nulls, occurrence, salt)
        if len(np.unique(hashes)) == len(hashes):
            break
    else:
        raise ValueError("keys of a shard are not distinct")
    mph = PerfectHash.build(hashes)
    slots, n = mph.slots(hashes), len(hashes)
    offsets = np.cumsum(lengths) - lengths
    prints, offs, lens = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u8")
    prints[slots] = fingerprints(hashes)
    offs[slots], lens[slots] = offsets, lengths
    head = _MAGIC + struct.pack("<QQQQ", salt, n, len(mph.sizes), len(mph.words))
    return b"".join([head, mph.sizes.astype("<i8").tobytes(), mph.words.tobytes(),
                     prints.tobytes(), offs.tobytes(), lens.tobytes()])


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes, 7) >> _U64(32)).astype("<u4")


class ShardIndex:
    """A read .mph file."""

    def __init__(self, data: bytes):
        if data[:8] != _MAGIC:
            raise ValueError("not an index file")
        self.salt, n, levels, words = struct.unpack_from("<QQQQ", data, 8)
        at = 40

        def take(dtype, count):
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        self.mph = PerfectHash(take("<i8", levels), take("<u8", words))
        self.prints, self.offsets, self.lengths = take("<u4", n), take("<u8", n), take("<u8", n)

    def find(self, doc_ids, nulls, occurrence):
        """(found, offset, length) of keys; constant time each."""
        hashes = key_hashes(doc_ids, nulls, occurrence, self.salt)
        slots = self.mph.slots(hashes)
        if not len(self.prints):
            none = np.zeros(len(slots), np.int64)
            return none.astype(bool), none, none
        at = np.maximum(slots, 0)
        found = (slots >= 0) & (self.prints[at] == fingerprints(hashes))
        return found, self.offsets[at].astype(np.int64), self.lengths[at].astype(np.int64)


def _filesystem(folder: str):
    """(pyarrow file system, path) of a shared folder's URI or plain path."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def _columns(batch):
    ids = batch.column("doc_id")
    nulls = ids.is_null().to_numpy(zero_copy_only=False)
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), nulls


def occurrences(doc_ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """Number of earlier equal keys, for keys in sorted order."""
    n = len(doc_ids)
    if not n:
        return np.zeros(0, np.int64)
    first = np.ones(n, bool)
    first[1:] = (doc_ids[1:] != doc_ids[:-1]) | (nulls[1:] != nulls[:-1])
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(first, at, 0))


class _Shard:
    """A shard being written."""

    def __init__(self, folder: str, shard: int, width: int):
        self.fs, base = _filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"{base}/shard-{shard:07d}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.name}.ids")
        self.shard, self.width, self.parts = shard, width, []

    def add(self, keys, nulls, payload) -> None:
        self.parts.append((keys, nulls, np.array([len(p) for p in payload], np.int64) // self.width))
        self.out.write(b"".join(payload))

    def close(self) -> dict:
        self.out.close()
        keys, nulls, lens = map(np.concatenate, zip(*self.parts))
        with self.fs.open_output_stream(f"{self.name}.mph") as f:
            f.write(index_bytes(keys, nulls, occurrences(keys, nulls), lens))
        return dict(shard=self.shard, ids_path=f"{self.name}.ids", mph_path=f"{self.name}.mph",
                    n_docs=len(keys), n_tokens=int(lens.sum()),
                    first_key=None if nulls[0] else int(keys[0]), width=self.width)


def _runs(shards: np.ndarray):
    """(from, to) of runs of equal values."""
    cuts = (np.flatnonzero(np.diff(shards)) + 1).tolist()
    return [(a, b) for a, b in zip([0, *cuts], [*cuts, len(shards)]) if b > a]


def _write_shards(folder: str, width: int):
    """mapInArrow over rows sorted by (shard, doc_id): a manifest row for each shard."""
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("shard", pa.int64()), ("ids_path", pa.string()), ("mph_path", pa.string()),
                            ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_key", pa.int64()),
                            ("width", pa.int32())])
        shard = None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            for lo, hi in _runs(numbers):
                part = batch.slice(lo, hi - lo)
                if shard is None or shard.shard != numbers[lo]:
                    if shard is not None:
                        yield pa.RecordBatch.from_pylist([shard.close()], schema)
                    shard = _Shard(folder, int(numbers[lo]), width)
                shard.add(*_columns(part), part.column("ids").to_pylist())
        if shard is not None:
            yield pa.RecordBatch.from_pylist([shard.close()], schema)
    return run


def _encode_and_route(tokenizer: str, bounds: np.ndarray):
    """mapInArrow: (doc_id, text) -> (doc_id, ids, shard)."""
    encode = wordbpe.encode_batches(tokenizer, ["doc_id"])

    def run(batches):
        import pyarrow as pa

        for batch in encode(batches):
            keys, null = _columns(batch)
            shard = np.where(null, 0, np.searchsorted(bounds, keys, side="right"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int64))],
                                             ["doc_id", "ids", "shard"])
    return run


def write(docs: DataFrame, tokenizer: str, shard_rows: int = SHARD_ROWS) -> str:
    """Encode ``docs`` and write shards below the shared folder; returns the folder.

    Shards hold ranges of doc_id, bounded by quantiles over all documents
    (8 bytes a shard on the driver).  Texts are encoded where they are read; only
    ids are shuffled.  Empty tables give an empty manifest.  Null texts count as
    empty and have the end id alone.  Extra columns of ``docs`` are not read.
    """
    folder = common.scratch(docs.sparkSession, "token-files")
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    shards = max(1, -(-docs.count() // shard_rows))
    cuts = [k / shards for k in range(1, shards)]
    bounds = np.unique(keys.approxQuantile("doc_id", cuts, 1 / (8 * shards)) if cuts else []).astype(np.int64)
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))
        .mapInArrow(_encode_and_route(tokenizer, bounds), "doc_id long, ids binary, shard long")
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
        .mapInArrow(_write_shards(folder, wordbpe.id_dtype(tokenizer).itemsize), MANIFEST)
        .write.parquet(f"{folder}/manifest"))
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _route(first_keys: np.ndarray, shards: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, null = _columns(batch)
            at = np.maximum(np.searchsorted(first_keys, keys, side="right") - 1, 0)
            at = np.where(null, 0, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("copies"), pa.array(shards[at])],
                ["doc_id", "copies", "shard"])
    return run


#: Keys looked up at a time.
_LOOKUP = 4096


def _digest(bases: dict[int, int]):
    """Looks up runs of (shard, doc_id, copies) rows and digests the payload."""
    def run(batches):
        import pyarrow as pa

        at, index, payload, width = None, None, None, 2
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            for lo, hi in _runs(shards):
                part = batch.slice(lo, hi - lo)
                shard = int(shards[lo])
                if shard != at:
                    if payload is not None:
                        payload.close()
                    row = part.slice(0, 1).to_pylist()[0]
                    fs, ids_path = _filesystem(row["ids_path"])
                    with fs.open_input_stream(_filesystem(row["mph_path"])[1]) as f:
                        index = ShardIndex(f.read())
                    payload, width, at = fs.open_input_file(ids_path), row["width"], shard
                keys, null = _columns(part)
                copies = part.column("copies").to_numpy()
                keys, null = np.repeat(keys, copies), np.repeat(null, copies)
                ends = np.cumsum(copies)
                occ = np.arange(len(keys)) - np.repeat(ends - copies, copies)
                for k in range(0, len(keys), _LOOKUP):
                    s = slice(k, k + _LOOKUP)
                    found, offset, length = index.find(keys[s], null[s], occ[s])
                    if not found.all():
                        raise KeyError("a document is missing from its shard's index")
                    crcs = []
                    for o, n in zip(offset.tolist(), length.tolist()):
                        payload.seek(o * width)
                        ids = payload.read(n * width)
                        crcs.append(zlib.crc32(wordbpe.ids_as_u32(ids, np.dtype(f"<u{width}"))))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[s], pa.int64(), mask=null[s]), pa.array(bases[shard] + offset),
                         pa.array(length), pa.array(np.array(crcs, np.int64))],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])
        if payload is not None:
            payload.close()
    return run


def read_digest(keys: DataFrame, folder: str) -> DataFrame:
    """Keyed access to every ``doc_id`` of ``keys``: doc_id, start, n_tokens, ids_crc32.

    Keys find their shard by the shards' first keys (8 bytes a shard, sent to
    the tasks), their document by the shard's index.  A key that stands k times
    in ``keys`` gives its first k documents.
    """
    spark = keys.sparkSession
    files = manifest(spark, folder)
    rows = files.select("shard", "n_tokens", "first_key").orderBy("shard").collect()  # one a shard
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    firsts = np.array([np.iinfo(np.int64).min if r.first_key is None else r.first_key for r in rows])
    shards = np.array([r.shard for r in rows], np.int64)
    ends = np.cumsum([r.n_tokens for r in rows])
    bases = {r.shard: int(e) - r.n_tokens for r, e in zip(rows, ends)}
    routed = (keys.groupBy("doc_id").agg(F.count("*").alias("copies"))
              .mapInArrow(_route(firsts, shards), "doc_id long, copies long, shard long"))
    return (routed.join(files.select("shard", "ids_path", "mph_path", "width"), "shard")
            .repartitionByRange(len(rows), "shard").sortWithinPartitions("shard", "doc_id")
            .mapInArrow(_digest(bases), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def get(spark: SparkSession, folder: str, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
    """One document's ids by key, or None: one manifest row, one index, one read."""
    files = manifest(spark, folder)
    fits = files.filter(F.col("first_key").isNull() | (F.col("first_key") <= F.lit(doc_id))
                        if doc_id is not None else F.col("first_key").isNull())
    row = fits.orderBy(F.col("shard").desc() if doc_id is not None else F.col("shard")).first()
    if row is None:
        return None
    fs, path = _filesystem(row.ids_path)
    with fs.open_input_stream(_filesystem(row.mph_path)[1]) as f:
        index = ShardIndex(f.read())
    found, offset, length = index.find(np.array([doc_id or 0]), np.array([doc_id is None]),
                                       np.array([occurrence]))
    if not found[0]:
        return None
    with fs.open_input_file(path) as f:
        f.seek(int(offset[0]) * row.width)
        return np.frombuffer(f.read(int(length[0]) * row.width), f"<u{row.width}")
