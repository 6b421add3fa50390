"""Nearest neighbours with randomly rotated one-bit codes.

Vectors are scaled to length one, the mean of all of them (the centre) is taken
off and the rest is scaled to length one again.  A random rotation, the same for
all, is applied and only the sign of each component is kept: ``dim`` bits,
packed.  Three numbers stand beside a code: the length of the rest, its product
with the centre, and the product of the rest with its own code (the correction).

For a query the inner product with every code is estimated from the bits and
corrected; by the rotation's randomness the estimate's error is within
``WIDTH`` * sqrt(1 - c^2) / (c * sqrt(dim - 1)) (c the correction), save with a
small chance.  A vector whose upper bound falls below the k-th best exact cosine
found so far is passed over; the others are reranked by the exact cosine of the
original vectors in double precision.

Codes are written once.  Queries go over all codes in blocks of ``BLOCK`` (its
size bounds what is sent to the tasks); each task keeps k results a query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salespark.llm import common

K = 5
#: Queries that go over the codes at a time.
BLOCK = 4096
#: Standard errors that the bound allows; the chance of passing over a true
#: neighbour falls with exp(-WIDTH^2 / 2).
WIDTH = 4.0
#: Codes that are estimated at a time.
_CHUNK = 2048
RESULT = "query long, query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<double>): vectors that take part.

    Null vectors, vectors with null or non-finite components, zero and empty
    vectors, and rows of null vec_id take no part.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("x", lambda v: v != 0))


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # large components don't overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centre(rows: DataFrame) -> np.ndarray:
    """Mean of the unit vectors, over all rows; one partial sum a task."""
    def run(batches):
        import pyarrow as pa

        total, n = 0.0, 0
        for batch in batches:
            if batch.num_rows:
                total = total + _units(_matrix(batch.column("x"))).sum(axis=0)
                n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()])], ["n", "s"])

    sums = (rows.select("x").mapInArrow(run, "n long, s array<double>")
            .select("n", F.posexplode("s").alias("i", "v")).groupBy("i")
            .agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("i").collect())
    return np.array([r.v / r.n for r in sums])


def encoded(rows: DataFrame, mid: np.ndarray) -> DataFrame:
    """(vec_id, x, code, rest, shift, correction) of every vector."""
    turn = rotation(len(mid))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("x"))
            if not len(x):
                continue
            rest = _units(x) - mid
            length = np.sqrt((rest * rest).sum(axis=1))
            shift = rest @ mid
            turned = rest @ turn / np.maximum(length, 1e-30)[:, None]
            code = np.packbits(turned >= 0, axis=1, bitorder="little")
            correction = np.abs(turned).sum(axis=1) / np.sqrt(len(mid))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"),
                 pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length),
                 pa.array(shift), pa.array(correction)],
                ["vec_id", "x", "code", "rest", "shift", "correction"])

    return rows.mapInArrow(run, "vec_id long, x array<double>, code binary, rest double, "
                                "shift double, correction double")


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact cosines of rows of x with q, each computed alone and alike."""
    x, q = x / np.abs(x).max(axis=1, keepdims=True), q / np.abs(q).max()
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def _search(shared, k: int):
    """mapInArrow over codes: the k best exact cosines a query among a task's rows."""
    def run(batches):
        import pyarrow as pa

        numbers, ids, queries, mid = shared.value
        dim = len(mid)
        turn = rotation(dim)
        rest = _units(queries) - mid
        length = np.sqrt((rest * rest).sum(axis=1))
        turned = (rest @ turn / np.maximum(length, 1e-30)[:, None]).astype(np.float32)
        on_mid = _units(queries) @ mid
        m = len(ids)
        best = np.full((m, k), -np.inf)
        who = np.full((m, k), np.iinfo(np.int64).max)
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(at, _CHUNK)
                vec_id = part.column("vec_id").to_numpy()
                x = _matrix(part.column("x"))
                bits = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8)
                bits = np.unpackbits(bits.reshape(len(x), -1), axis=1, bitorder="little")[:, :dim]
                r, c = (part.column(n).to_numpy() for n in ("rest", "correction"))
                signs = (2.0 * bits - 1).astype(np.float32) / np.float32(np.sqrt(dim))
                c = np.maximum(c, 1e-6)
                # <x, q> = <mid, q> + <rest x, mid> + |rest x| |rest q| <unit rest x, unit rest q>
                estimate = (signs @ turned.T) / c[:, None]
                error = WIDTH * np.sqrt(np.maximum(1 - c * c, 0)) / (c * np.sqrt(max(dim - 1, 1))) + 1e-5
                upper = (on_mid[None, :] + part.column("shift").to_numpy()[:, None]
                         + (r[:, None] * length[None, :]) * np.minimum(estimate + error[:, None], 1.0) + 1e-6)
                close = upper >= best[:, -1][None, :]
                for j in np.flatnonzero(close.any(axis=0)).tolist():
                    # nearest estimates first: their exact cosines raise the bar for the rest
                    order = np.flatnonzero(close[:, j] & (vec_id != ids[j]))
                    order = order[np.argsort(-upper[order, j], kind="stable")]
                    for lo in range(0, len(order), 64):
                        some = order[lo:lo + 64]
                        some = some[upper[some, j] >= best[j, -1]]
                        if not len(some):
                            break
                        score = np.concatenate([best[j], cosines(x[some], queries[j])])
                        names = np.concatenate([who[j], vec_id[some]])
                        top = np.lexsort((names, -score))[:k]
                        best[j], who[j] = score[top], names[top]
        keep = np.isfinite(best)
        rows = np.nonzero(keep)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers[rows]), pa.array(ids[rows]), pa.array(who[keep]), pa.array(best[keep])],
            ["query", "query_id", "vec_id", "score"])
    return run


def search(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``vectors`` for each query.

    Both have (vec_id, embedding).  Every query row has a result of its own, so two
    query rows of one id give two lists.  Rows of the query's own id are no
    candidates; any other row is one of its own, repeated ids too.  Vectors of
    different lengths have no cosine: a query's candidates are those of its length.
    Nearest first, ties to the smaller vec_id; fewer rows where there are fewer
    candidates.  Unusable vectors (see ``usable``) take no part on either side.
    """
    spark = vectors.sparkSession
    rows = common.written(usable(vectors), "vectors")
    asked = common.written(usable(queries).withColumn("query", F.monotonically_increasing_id()), "asked")
    parts = []
    for r in asked.select(F.size("x").alias("n")).distinct().orderBy("n").collect():
        same = F.size("x") == r.n
        parts += _found(asked.filter(same), rows.filter(same), k)
    found = parts[0] if parts else spark.createDataFrame([], RESULT)
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _found(asked: DataFrame, rows: DataFrame, k: int) -> list[DataFrame]:
    """Results of the tasks, a frame for each block of queries; all vectors are of one length."""
    if rows.isEmpty():
        return []
    spark = rows.sparkSession
    mid = centre(rows)
    codes = common.written(encoded(rows, mid), "codes")
    number = F.row_number().over(Window.partitionBy("bin").orderBy("vec_id", "query")) - 1
    # blocks of at most BLOCK queries: a hash deals them out to enough bins
    total = asked.count()
    bins = max(1, -(-2 * total // BLOCK)) if total > BLOCK else 1
    dealt = common.written(
        asked.withColumn("bin", F.pmod(F.xxhash64("vec_id", "query"), F.lit(bins)))
        .withColumn("block", F.floor(number / BLOCK)), "queries")
    parts = []
    for b in dealt.select("bin", "block").distinct().orderBy("bin", "block").collect():
        block = dealt.filter((F.col("bin") == b.bin) & (F.col("block") == b.block)).orderBy("vec_id", "query").collect()
        shared = spark.sparkContext.broadcast(
            (np.array([r["query"] for r in block], np.int64), np.array([r.vec_id for r in block], np.int64),
             np.array([r.x for r in block]), mid))
        parts.append(common.written(codes.mapInArrow(_search(shared, k), RESULT), "found"))
    return parts
