"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints.  A document's words (ASCII lower case, split at white space) form
shingles of ``width`` words, repeats included; a text of fewer words is one
shingle, one without words has fingerprint zero.  Bit i of the 64-bit
fingerprint is set if it is set in over half the shingles' XXH64 hashes.

Links.  Two fingerprints link at ``distance`` or fewer differing bits.  Equal
fingerprints are one node, so exact copies cost one row.  For the others:

1. Correlated bits are grouped: from the co-occurrence counts of all 64 bits
   over all fingerprints, eight cells of eight bits are grown, each next bit the
   one most correlated with its cell.  Fingerprints are permuted accordingly.
2. A dynamic programme over the cells chooses partitions (runs of cells) and a
   threshold t >= 0 for each, or none: partitions whose sum of (t + 1) is
   ``distance`` + 1.  By the generalised pigeonhole principle a linked pair is
   within t bits in some partition.  The cost is the estimated number of
   candidates (from the exact distance distribution of every cell, convolved)
   and of signature rows.
3. Every fingerprint is stored under its own value in each partition and probes
   all values within t bits.  Rows meet by (partition, value), a bucket.
4. Buckets are verified in numpy by the Hamming distance of whole fingerprints.
   A bucket yields links that connect what is linked in it (a forest, not all
   pairs).  A bucket of more than ``BLOCK`` rows is dealt out as pairs of blocks,
   so no task holds a whole hot bucket and no pair is missed.

Components.  Links contract in rounds: every node joins its neighbour of the
least hash, equal links merge, until none is left.  Each round is a written
table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salespark.llm import common

#: Shingle length in words and greatest distance in bits.
WIDTH, DISTANCE = 4, 4
#: Rows of a bucket that are compared with each other at a time.
BLOCK = 2048
_CELLS, _CELL_BITS = 8, 8
#: Weights of the cost estimate: a signature row, a candidate pair (seconds).
_ROW_COST, _PAIR_COST = 1e-6, 5e-9


# --- fingerprints

def fingerprints_of(texts: list[bytes], width: int) -> np.ndarray:
    """uint64 fingerprints of whole texts."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    hashes, counts, owner = [], [], []

    def flush():
        if not counts:
            return
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8),
                             axis=1, bitorder="little")
        starts = np.cumsum(counts) - counts
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        over = 2 * ones > np.array(counts)[:, None]
        out[owner] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
        hashes.clear()
        counts.clear()
        owner.clear()

    for i, text in enumerate(texts):
        words = text.lower().split()  # ASCII letters and white space only, as bytes
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= width:
            found = [xxh64_intdigest(joined, 42)]
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = [0, *(ends[:-width] + 1).tolist()]
            found = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1:].tolist())]
        if len(found) > 1 << 18:  # a very long text, in parts
            out[i] = _long_fingerprint(found)
            continue
        hashes.extend(found)
        counts.append(len(found))
        owner.append(i)
        if len(hashes) > 1 << 16:
            flush()
    flush()
    return out


def _long_fingerprint(hashes: list[int]) -> np.uint64:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k:k + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ("doc_id",),
                 name: str = "fp") -> DataFrame:
    """Columns ``keep`` and the fingerprint as a signed 64-bit integer; null texts as empty."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = fingerprints_of(batch.column("__text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(found.view(np.int64))], [*keep, name])

    return docs.select(*keep, common.text_bytes().alias("__text")).mapInArrow(
        run, docs.select(*keep).schema.add(name, "long"))


# --- partitions and thresholds

def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and 64 x 64 counts of bits set together, over all rows."""
    def run(batches):
        import pyarrow as pa

        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = _bits(batch.column("fp").to_numpy().astype(np.int64)).astype(np.float32)
            for k in range(0, len(bits), 1 << 16):
                part = bits[k:k + (1 << 16)]
                total += part.T @ part
            n += len(bits)
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64 * 64 + 1), pa.int32()), pa.array(cells)], ["i", "n"])

    rows = (nodes.select("fp").mapInArrow(run, "i int, n long")
            .groupBy("i").agg(F.sum("n").alias("n")).collect())  # 4,097 rows
    flat = np.zeros(64 * 64 + 1, np.int64)
    for r in rows:
        flat[r.i] = r.n
    return int(flat[-1]), flat[:-1].reshape(64, 64)


def group_bits(n: int, together: np.ndarray) -> list[int]:
    """An order of the 64 bits in which each run of eight is a cell of correlated bits."""
    p = together / max(n, 1)
    one = np.diag(p)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    corr = np.abs((p - np.outer(one, one)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, order = list(range(64)), []
    for _ in range(_CELLS):
        cell = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(cell[0])
        while len(cell) < _CELL_BITS:
            best = max(left, key=lambda b: (corr[b, cell].sum(), -b))
            cell.append(best)
            left.remove(best)
        order += cell
    return order


def permute(fps: np.ndarray, order: list[int]) -> np.ndarray:
    """Fingerprints with bit k taken from bit order[k]."""
    bits = np.ascontiguousarray(_bits(fps)[:, order])
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def cell_distances(cells: np.ndarray) -> np.ndarray:
    """Per cell: share of pairs of fingerprints at distance 0..8 in it, from value counts."""
    away = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))
    out = np.zeros((len(cells), _CELL_BITS + 1))
    for c, counts in enumerate(cells.astype(float)):
        share = counts / max(counts.sum(), 1)
        for d in range(_CELL_BITS + 1):
            out[c, d] = share @ ((away == d) @ share)
    return out


def allot(n: int, near: np.ndarray, distance: int) -> list[tuple[int, int, int]]:
    """Partitions (first cell, cells, threshold) of least estimated cost.

    Dynamic programme over (cells used, threshold units spent): a partition of
    some cells with threshold t spends t + 1 of the ``distance`` + 1 units.
    """
    from math import comb

    units = distance + 1
    best: dict[tuple[int, int], tuple[float, list]] = {(0, 0): (0.0, [])}
    for first in range(_CELLS):
        for spent in range(units + 1):
            if (first, spent) not in best:
                continue
            cost, plan = best[first, spent]
            options = [((first + 1, spent), cost, plan)]  # a cell left out
            pmf = np.ones(1)
            for cells in range(1, min(4, _CELLS - first) + 1):
                pmf = np.convolve(pmf, near[first + cells - 1])
                bits = cells * _CELL_BITS
                for t in range(units - spent):
                    probes = sum(comb(bits, k) for k in range(t + 1))
                    if probes > 3000:
                        break
                    pairs = n * n * pmf[:t + 1].sum() * (0.5 if t == 0 else 1)
                    more = n * (probes + (t > 0)) * _ROW_COST + pairs * _PAIR_COST
                    options.append(((first + cells, spent + t + 1), cost + more,
                                    plan + [(first, cells, t)]))
            for key, c, pl in options:
                if key not in best or c < best[key][0]:
                    best[key] = (c, pl)
    return best[_CELLS, units][1]


def flips(bits: int, t: int) -> np.ndarray:
    """All masks of 1..t set bits among ``bits``."""
    from itertools import combinations

    return np.array([sum(1 << b for b in c) for k in range(1, t + 1)
                     for c in combinations(range(bits), k)], np.uint64)


# --- probing and verifying

def signatures(nodes: DataFrame, order: list[int], plan: list[tuple[int, int, int]]) -> DataFrame:
    """(part, value, probe, code): every permuted fingerprint under its own value
    in each partition, and under the values within the partition's threshold."""
    masks = [flips(cells * _CELL_BITS, t) for _, cells, t in plan]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                fps = batch.column("fp").slice(k, 4096).to_numpy().astype(np.int64)
                codes = permute(fps, order)
                for part, (first, cells, _) in enumerate(plan):
                    keep = np.uint64((1 << (cells * _CELL_BITS)) - 1)
                    value = (codes >> np.uint64(first * _CELL_BITS)) & keep
                    probes = (value[:, None] ^ masks[part][None, :]).ravel() if len(masks[part]) else value[:0]
                    values = np.concatenate([value, probes])
                    code = np.concatenate([codes, np.repeat(codes, len(masks[part]))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), part, np.int32)), pa.array(values.view(np.int64)),
                         pa.array(np.arange(len(values)) >= len(value)), pa.array(code.view(np.int64))],
                        ["part", "value", "probe", "code"])

    return nodes.select("fp").mapInArrow(run, "part int, value long, probe boolean, code long")


def _forest(left: np.ndarray, right: np.ndarray, same: bool, distance: int):
    """Links that connect what is linked between (or within) two sets of codes."""
    codes = left if same else np.concatenate([left, right])
    n, cut = len(codes), len(left)
    label = np.arange(n)
    linked = np.bitwise_count(left[:, None] ^ right[None, :]) <= distance
    while True:
        a = np.where(linked, label[None, (0 if same else cut):], n).min(axis=1, initial=n)
        b = np.where(linked, label[:cut, None], n).min(axis=0, initial=n)
        new = np.minimum(label, np.concatenate([a, b]) if not same else np.minimum(a, b))
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return codes[label[at]], codes[at]


def verify(distance: int):
    """mapInArrow over rows sorted by bucket: links (a, b) of each bucket."""
    def links(side, probe, codes):
        own, other = codes[~probe & (side != 1)], codes[probe & (side != 1)]
        own2, other2 = codes[~probe & (side == 1)], codes[probe & (side == 1)]
        if (side == 1).any():  # two blocks of a hot bucket
            pairs = [(own, own2), (own, other2), (other, own2)]
        else:
            pairs = [(own, None), (own, other)]
        for left, right in pairs:
            same = right is None
            right = left if same else right
            if len(left) < 1 + same or not len(right):
                continue
            for i in range(0, len(left), BLOCK):
                for j in range(i if same else 0, len(right), BLOCK):
                    inside = same and i == j
                    yield _forest(left[i:i + BLOCK], right[j:j + BLOCK], inside, distance)

    def run(batches):
        import pyarrow as pa

        def out(found):
            a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            differ = a != b
            return pa.RecordBatch.from_arrays(
                [pa.array(a[differ].view(np.int64)), pa.array(b[differ].view(np.int64))], ["a", "b"])

        rest = None
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in
                    ("part", "value", "cell", "side", "probe", "code")}
            if rest is not None:
                cols = {c: np.concatenate([rest[c], v]) for c, v in cols.items()}
            if not len(cols["code"]):
                continue
            starts = _starts(cols)
            rest = {c: v[starts[-1]:] for c, v in cols.items()}
            yield from _small_and_large(cols, starts[:-1], starts[1:], links, out, distance)
        if rest is not None and len(rest["code"]):
            n = np.array([len(rest["code"])])
            yield from _small_and_large(rest, np.zeros(1, np.int64), n, links, out, distance)
    return run


def _starts(cols) -> np.ndarray:
    new = np.ones(len(cols["code"]), bool)
    new[1:] = False
    for c in ("part", "value", "cell"):
        new[1:] |= cols[c][1:] != cols[c][:-1]
    return np.flatnonzero(new)


#: Buckets up to this size are compared together, row against following rows.
_SMALL = 16


def _small_and_large(cols, starts, ends, links, out, distance):
    codes = cols["code"].astype(np.int64).view(np.uint64)
    size = ends - starts
    found = []
    small = (size > 1) & (size <= _SMALL)
    if small.any():
        left = np.concatenate([[0], np.cumsum(size[small])])[:-1]
        at = np.repeat(starts[small] - left, size[small]) + np.arange(size[small].sum())
        end = np.repeat(ends[small], size[small])
        probe = cols["probe"]
        for lag in range(1, int(size[small].max())):
            ok = at + lag < end
            at, end = at[ok], end[ok]
            a, b = codes[at], codes[at + lag]
            hit = (np.bitwise_count(a ^ b) <= distance) & ~(probe[at] & probe[at + lag])
            found.append((a[hit], b[hit]))
    for s, e in zip(starts[size > _SMALL].tolist(), ends[size > _SMALL].tolist()):
        found += links(cols["side"][s:e], cols["probe"][s:e], codes[s:e])
        if sum(len(f[0]) for f in found) > 100_000:
            yield out(found)
            found = []
    if found:
        yield out(found)


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect all linked ones.

    ``nodes`` has distinct ``fp`` values.  Codes are the permuted fingerprints;
    the result is in the terms of ``fp``.
    """
    n, together = bit_counts(nodes)
    order = group_bits(n, together)
    plan = allot(n, cell_distances(cell_values(nodes, order)), distance)
    rows = common.written(signatures(nodes, order, plan), "signatures")
    hot = (rows.groupBy("part", "value").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
           .select("part", "value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    dealt = rows.join(hot, ["part", "value"], "left")
    block = F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("blocks").isNotNull(), block))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0)))
                      .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("other", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select(
        "part", "value", "probe", "code",
        F.coalesce(low.cast("long") * F.col("blocks") + high, F.lit(-1)).alias("cell"),
        F.when(F.col("blocks").isNull() | (F.col("block") == F.col("other")), 2)
         .when(F.col("block") < F.col("other"), 0).otherwise(1).cast("int").alias("side"))
    found = (dealt.repartition("part", "value", "cell")
             .sortWithinPartitions("part", "value", "cell").mapInArrow(verify(distance), "a long, b long"))
    back = np.argsort(order).tolist()

    def unpermute(batches):
        import pyarrow as pa

        for batch in batches:
            ab = [permute(batch.column(c).to_numpy().astype(np.int64).view(np.uint64), back).view(np.int64)
                  for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ab], ["a", "b"])

    return found.mapInArrow(unpermute, "a long, b long")


def cell_values(nodes: DataFrame, order: list[int]) -> np.ndarray:
    """8 x 256 counts of cell values over all fingerprints."""
    def run(batches):
        import pyarrow as pa

        counts = np.zeros((_CELLS, 256), np.int64)
        for batch in batches:
            codes = permute(batch.column("fp").to_numpy().astype(np.int64), order)
            for c, column in enumerate(codes.view(np.uint8).reshape(-1, 8).T):
                counts[c] += np.bincount(column, minlength=256)
        flat = counts.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "n"])

    rows = (nodes.select("fp").mapInArrow(run, "i int, n long").groupBy("i")
            .agg(F.sum("n").alias("n")).collect())  # 2,048 rows
    flat = np.zeros(_CELLS * 256, np.int64)
    for r in rows:
        flat[r.i] = r.n
    return flat.reshape(_CELLS, 256)


# --- components

def components(edges: DataFrame) -> DataFrame | None:
    """(node, root) of every node of the links (a, b), or None without links.

    Each round every node takes the neighbour of the least hash (or itself),
    links are rewritten to what their ends took, and the round's choice is
    written.  A node's root follows the choices of all rounds.
    """
    edges = common.written(edges.filter("a != b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        def ranked(c):
            return F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("h"), F.col(c).alias("v"))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        chosen = (both.groupBy("a").agg(F.min(ranked("b")).alias("least"))
                  .select("a", F.least(ranked("a"), F.col("least")).getField("v").alias("to")))
        chosen = common.written(chosen, "chosen")
        rounds.append(chosen)
        ends_a = chosen.select("a", F.col("to").alias("ta"))
        ends_b = chosen.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        edges = common.written(
            edges.join(ends_a, "a").join(ends_b, "b").filter("ta != tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    if not rounds:
        return None
    root = rounds[-1].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for chosen in rounds[-2::-1]:
        later = root.select(F.col("node").alias("to"), "root")
        root = common.written(
            chosen.join(later, "to", "left")
            .select(F.col("a").alias("node"), F.coalesce("root", "to").alias("root")), "roots")
    return root


def classes(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of (doc_id, fp): ``root``
    names the component, component_id is its smallest doc_id."""
    nodes = common.written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, distance))
    if roots is None:
        return nodes.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    joined = joined.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return common.written(joined.join(least, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id
    (the smallest doc_id reachable by links, itself included).

    Null texts are empty; empty texts have fingerprint zero and link like any
    other.  Repeated rows are copies.  Null doc_ids take part and are never the
    smallest; a component of null doc_ids alone has a null component_id.
    """
    marked = common.written(fingerprints(docs, width), "fingerprints")
    return marked.join(classes(marked, distance), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` for each component: the one of the smallest doc_id.

    Where several rows share that doc_id (or all are null), the least text hash
    decides.  Columns stay as they are.
    """
    marked = common.written(fingerprints(docs, width), "fingerprints")
    found = classes(marked, distance)
    firsts = common.written(
        marked.join(found, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("doc_id").agg(F.count("*").alias("n")), "firsts")
    alone = F.col("doc_id").isNotNull() & (F.col("n") == 1)
    # the ids grow with the corpus: one plan at every size, never a broadcast of them
    kept = docs.join(firsts.filter(alone).select("doc_id").hint("merge"), "doc_id", "left_semi")
    shared = firsts.filter(~alone).select(F.col("doc_id").alias("__id"))
    if shared.isEmpty():
        return kept.select(*docs.columns)
    rest = docs.join(shared, docs["doc_id"].eqNullSafe(shared["__id"]), "left_semi")
    rest = fingerprints(rest, width, tuple(docs.columns), "__fp").join(
        found.select(F.col("fp").alias("__fp"), F.col("root").alias("__root"),
                     F.col("component_id").alias("__id")), "__fp")
    order = Window.partitionBy("__root").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns))
    rest = (rest.filter(F.col("doc_id").eqNullSafe(F.col("__id")))
            .withColumn("__n", F.row_number().over(order)).filter("__n = 1"))
    return kept.select(*docs.columns).unionByName(rest.select(*docs.columns))
