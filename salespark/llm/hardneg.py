"""Hard negatives by lists that the anchors of a cluster share.

Scores are inner products of integer vectors.  Anchors are clustered by direction.
For a cluster with centre c and widest member angle w, the score of a member a with
a candidate x is at most |a| |x| cos(max(angle(c, x) - w, 0)).  That bound, without
|a|, orders the candidates once a cluster; every member walks the same list from its
top, scoring a stretch at a time, until the bound of what is left proves that no more
can enter its result.

Two walks give the result.  The first finds the best rows of an anchor's own label
(its positives).  The second finds, for each positive, the best rows of other labels
whose score lies in the positive's window; a walk ends when all its windows are full
with better rows than the bound, or the bound lies under the lowest window.

Candidates are read by Spark in shards of about ``SHARD`` numbers, each with a list of its own
for each cluster; a shard's results are merged by ``row_number``.  Anchors go over the
shards in blocks of at most ``BLOCK`` rows, which bounds what is sent to the tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salespark.llm import common

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of its positive's, at least and at most.
LEAST, MOST = 50, 95
SCALE = 256
#: Anchors that go over the candidates at a time, at most; components of a shard, about.
BLOCK, SHARD = 4096, 1 << 22
#: Anchors of a cluster on average; rounds of clustering; candidates scored at a time.
CLUSTER, ROUNDS, STRETCH = 64, 8, 512
_LAST = np.iinfo(np.int64).max

FOUND = "anchor long, tie long, vec_id long, score long"
WINDOWED = "anchor long, positive int, tie long, vec_id long, score long"


def prepared(vectors: DataFrame, label: Column) -> DataFrame:
    """(tie, vec_id, label, x): rows that take part, components as whole numbers.

    Left out: null labels, null vectors, null or non-finite components.  Components
    are floor(SCALE * x) in double precision, at most 2^62 in size.  ``tie`` numbers
    the rows; it parts rows of one vec_id and is the last order of equal scores.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.transform("x", lambda v: F.greatest(F.least(F.floor(v * SCALE).cast("double"), F.lit(2.0 ** 62)), F.lit(-2.0 ** 62)))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
            .filter(F.col("label").isNotNull() & F.col("x").isNotNull()
                    & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
            .select(F.monotonically_increasing_id().alias("tie"), "vec_id", "label", whole.alias("x")))


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix of ``dim`` columns, zeros behind short rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def clustered(x: np.ndarray, seed: int = 3) -> np.ndarray:
    """Cluster of each row by direction (spherical k-means)."""
    norm = np.sqrt((x * x).sum(axis=1))
    unit = x / np.maximum(norm, 1e-300)[:, None]
    k = max(1, len(x) // CLUSTER)
    centres = unit[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return (unit @ centres.T).argmax(axis=1)


class Lists:
    """A shard's candidates, and for any cluster the order of their bounds."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.unit = x / np.maximum(self.norm, 1e-300)[:, None]
        #: products and their sums are exact in double precision up to here
        self.exact = 2.0 ** 53

    def bounds(self, members: np.ndarray) -> np.ndarray:
        """Bound of every candidate's score with any member, a unit of the member's length."""
        size = np.sqrt((members * members).sum(axis=1))
        unit = members / np.maximum(size, 1e-300)[:, None]
        centre = unit.sum(axis=0)
        centre = centre / max(float(np.sqrt(centre @ centre)), 1e-300)
        widest = np.arccos(np.clip(unit @ centre, -1, 1)).max()
        angle = np.arccos(np.clip(self.unit @ centre, -1, 1))
        # a little more than the rounding of the angles can be off
        return self.norm * np.minimum(np.cos(np.maximum(angle - widest - 1e-6, 0.0)) + 1e-9, 1.0)

    def scores(self, members: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Exact inner products (members x some), clipped to 64 bits."""
        chosen = self.x[some]
        top = np.sqrt((members * members).sum(axis=1)).max() * (self.norm[some].max() if len(some) else 0.0)
        if top < self.exact:
            return (members @ chosen.T).astype(np.int64)
        whole = [[int(v) for v in row] for row in members]
        return np.array([[min(max(sum(a * int(b) for a, b in zip(m, c) if a), -_LAST), _LAST) for c in chosen]
                         for m in whole], np.int64).reshape(len(members), len(some))


def _top(k: int, score: np.ndarray, names: tuple[np.ndarray, ...]) -> np.ndarray:
    """Places of the k first: greatest score, then least names."""
    if len(score) > 8 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
        return at[np.lexsort((*[n[at] for n in reversed(names)], -score[at]))[:k]]
    return np.lexsort((*reversed(names), -score))[:k]


def walk(lists: Lists, members: np.ndarray, accept, low: np.ndarray, high: np.ndarray, owner: np.ndarray,
         names: tuple[np.ndarray, ...], k: int):
    """The ``k`` first candidates of every window, and the number of scores computed.

    Windows (``owner`` is a window's member) hold scores from ``low`` to ``high``;
    ``accept(members, candidates)`` says which candidates each member may take.  The
    members go down the list of their cluster's bounds, each until its windows are
    certain: full of better scores than the bound, or above it.
    """
    bound = lists.bounds(members)
    order = np.argsort(-bound, kind="stable")
    size = np.sqrt((members * members).sum(axis=1))
    score = [np.zeros(0, np.int64) for _ in owner]
    who = [np.zeros(0, np.int64) for _ in owner]
    worst = low.astype(np.int64)  # least score that can still enter a window
    open_, spent = np.arange(len(owner)), 0
    for at in range(0, len(order), STRETCH):
        # one unit and a share of 1e-9 more than rounding can be off
        open_ = open_[size[owner[open_]] * bound[order[at]] * (1 + 1e-9) + 1.0 >= worst[open_]]
        if not len(open_):
            break
        some = order[at:at + STRETCH]
        active, row = np.unique(owner[open_], return_inverse=True)
        found = lists.scores(members[active], some)
        spent += found.size
        allowed = accept(active, some)
        near = (found[row] >= worst[open_][:, None]) & (found[row] <= high[open_][:, None]) & allowed[row]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            w = open_[i]
            s, c = np.concatenate([score[w], found[row[i], near[i]]]), np.concatenate([who[w], some[near[i]]])
            first = _top(k, s, tuple(n[c] for n in names))
            score[w], who[w] = s[first], c[first]
            if len(first) == k:
                worst[w] = max(worst[w], s[first[-1]])
    return score, who, spent


def _shards(batches, dim: int):
    """Arrow batches gathered to shards: (Lists, vec_id with nulls last, its nulls, tie, label)."""
    import pyarrow as pa

    held, rows, most = [], 0, max(SHARD // dim, 1024)

    def shard():
        whole = pa.Table.from_batches(held).combine_chunks()
        ids = whole.column("vec_id").combine_chunks()
        return (Lists(_matrix(whole.column("x").combine_chunks(), dim)), ids.fill_null(_LAST).to_numpy(),
                ids.is_null().to_numpy(zero_copy_only=False), whole.column("tie").to_numpy(), whole.column("label").to_numpy())

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            if rows and rows + part.num_rows > most:
                yield shard()
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if rows:
        yield shard()


def _mine(shared, windowed: bool):
    """mapInArrow over candidates: first rows of every anchor (or of its windows) a shard."""
    def run(batches):
        import pyarrow as pa

        ties, labels, x, clusters, low, high, owner = shared.value
        groups = [np.flatnonzero(clusters == c) for c in range(int(clusters.max()) + 1)]
        place = np.arange(len(owner)) if not windowed else _numbers(owner)
        for lists, ids, unnamed, tie, label in _shards(batches, x.shape[1]):
            anchor, number, who, score = [], [], [], []
            for group in groups:
                if not len(group):
                    continue
                mine = np.flatnonzero(np.isin(owner, group))
                local = np.searchsorted(group, owner[mine])

                def accept(m, some, group=group):
                    a = group[m][:, None]
                    if windowed:
                        return label[some] != labels[a]
                    return (label[some] == labels[a]) & (tie[some] != ties[a])

                s, c, _ = walk(lists, x[group], accept, low[mine], high[mine], local, (ids, tie),
                               NEGATIVES if windowed else POSITIVES)
                for w, ss, cc in zip(mine, s, c):
                    anchor += [ties[owner[w]]] * len(ss)
                    number += [place[w]] * len(ss)
                    who.append(cc)
                    score.append(ss)
            if not anchor:
                continue
            who, score = np.concatenate(who), np.concatenate(score)
            columns = [pa.array(anchor, pa.int64()), pa.array(tie[who]),
                       pa.array(ids[who], mask=unnamed[who]), pa.array(score)]
            names = ["anchor", "tie", "vec_id", "score"]
            if windowed:
                columns.insert(1, pa.array(number, pa.int32()))
                names.insert(1, "positive")
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def _numbers(owner: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run of equal owners (owners ascend)."""
    first = np.searchsorted(owner, owner, side="left")
    return np.arange(len(owner)) - first


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "tie")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _sent(rows, dim: int):
    """Ties, labels, matrix and clusters of collected anchors."""
    x = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        x[i, :len(r.x)] = r.x
    return np.array([r.tie for r in rows], np.int64), np.array([r.label for r in rows], np.int64), x, clustered(x)


def mine(vectors: DataFrame, anchors: Column, label: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has (vec_id, embedding) and what the columns ``anchors`` (a condition
    on vec_id) and ``label`` read.  An anchor's positives are its ``POSITIVES`` first
    other rows of its label; for each, its ``NEGATIVES`` first rows of other labels with
    LEAST * positive_score <= 100 * negative_score <= MOST * positive_score.  First
    means the greater score, then the smaller vec_id, then the order of rows.

    Rows of one vec_id are rows of their own, as anchors and as candidates; a null
    vec_id comes last among equal scores and is no anchor.  A vector shorter than
    another counts as followed by zeros; empty ones score 0.  Scores beyond 64 bits
    count as the greatest or least 64-bit number.  Extra columns are left out.  Fewer
    rows where there are fewer; an empty table gives none.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    rows = common.written(prepared(vectors, label), "hard-vectors")
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    asked = rows.filter(anchors)
    total = asked.count()
    if not total:
        return spark.createDataFrame([], schema)
    dim = max(dim, 1)
    # blocks of at most BLOCK anchors: a hash deals them out to enough bins
    bins = 1 if total <= BLOCK else -(-2 * total // BLOCK)
    number = F.row_number().over(Window.partitionBy("bin").orderBy("tie")) - 1
    dealt = common.written(asked.withColumn("bin", F.pmod(F.xxhash64("tie"), F.lit(bins)))
                           .withColumn("block", F.floor(number / BLOCK)), "hard-anchors")
    candidates = rows.select("tie", "vec_id", "label", "x")
    out = None
    for b in dealt.select("bin", "block").distinct().orderBy("bin", "block").collect():
        block = dealt.filter((F.col("bin") == b.bin) & (F.col("block") == b.block)).orderBy("tie").collect()
        ties, labels, x, clusters = _sent(block, dim)
        least, most = np.full(len(block), -_LAST), np.full(len(block), _LAST)
        shared = spark.sparkContext.broadcast((ties, labels, x, clusters, least, most, np.arange(len(block))))
        positives = common.written(_ranked(candidates.mapInArrow(_mine(shared, False), FOUND), ["anchor"], POSITIVES),
                                   "hard-positives")
        # at most POSITIVES rows an anchor of the block; no score fits where a positive's is negative
        chosen = positives.filter("score >= 0").orderBy("anchor", "rank").collect()
        if not chosen:
            continue
        owner = np.searchsorted(ties, np.array([r.anchor for r in chosen], np.int64))
        low = np.array([-(-LEAST * r.score // 100) for r in chosen], np.int64)
        high = np.array([MOST * r.score // 100 for r in chosen], np.int64)
        windows = spark.createDataFrame(
            [(r.anchor, n, r.vec_id, r.score) for r, n in zip(chosen, _numbers(owner).tolist())],
            "anchor long, positive int, positive_id long, positive_score long")
        shared = spark.sparkContext.broadcast((ties, labels, x, clusters, low, high, owner))
        found = _ranked(candidates.mapInArrow(_mine(shared, True), WINDOWED), ["anchor", "positive"], NEGATIVES)
        names = dealt.select(F.col("tie").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        part = common.written(
            found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
            .join(windows, ["anchor", "positive"]).join(names, "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                    "positive_score", "negative_score"), "hard-found")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def op12_anchor() -> Column:
    """Rows whose vec_id is divisible by 50."""
    return F.col("vec_id") % 50 == 0


def op12_label() -> Column:
    """The label, moved on by one (modulo 10) where vec_id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def oracle() -> str:
    """The same result as DuckDB SQL, for vectors of one length and distinct vec_ids."""
    return f"""WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n
  FROM s WHERE same) WHERE n <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score) WHERE rank <= {NEGATIVES}"""
