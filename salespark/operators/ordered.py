"""Global order without a single-partition window.

A window with ``orderBy`` but no ``partitionBy`` moves every row to one task.
``ordered_offsets`` gives the same answer (1-based position and running sums
in a total order, over all rows or within groups) with bounded tasks, by one
plan at every size:

1. count the rows; ``k = ceil(n / rows_per_bucket)``, without an upper bound;
2. range-partition the rows by (group, sort key) into ``k`` value ranges and
   sort each.  The key ends in a unique column, so a heavily tied metric is
   split too, inside its ties;
3. number the rows of each range as they lie and write them to the shared
   folder: ranges and numbers are then fixed, whatever executors are lost
   later, and chained passes carry no growing lineage;
4. count and sum each range and group.  These totals, ``k`` rows and one more for
   each group at most (one for half a million rows; groups are few: the metrics or
   columns of a query), are added up on the driver: no window runs over all ranges;
5. join these offsets to the rows of their range.

``exact_quantiles`` puts the values of several columns through one such pass.

Frames that several actions read are persisted.  ``keeping()`` names their owner:
what was persisted or written inside it is dropped by its ``close``.
"""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Target rows of a value range.
ROWS_PER_BUCKET = 500_000


class Kept:
    """Frames and folders that some owner's queries keep until it closes."""

    def __init__(self):
        self.frames: list[DataFrame] = []
        self.folders: list[tuple] = []

    def close(self) -> None:
        """Drop them; frames that read a dropped folder can't be used any more."""
        while self.frames:
            self.frames.pop().unpersist()
        while self.folders:
            spark, path = self.folders.pop()
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_SESSION = Kept()
_OWNER: ContextVar[Kept] = ContextVar("owner", default=_SESSION)


@contextmanager
def keeping(owner: Kept):
    """What operators keep inside the block belongs to ``owner``."""
    token = _OWNER.set(owner)
    try:
        yield owner
    finally:
        _OWNER.reset(token)


def release_cached() -> None:
    """Drop what was kept outside any ``keeping`` block."""
    _SESSION.close()


def cache(df: DataFrame) -> DataFrame:
    """Persist a frame that several actions will read, until its owner closes."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _OWNER.get().frames.append(kept)
    return kept


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back."""
    from ..plans.session import ensure_checkpoint_dir

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _OWNER.get().folders.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def local_rows(spark, rows: list[list], schema: T.StructType) -> DataFrame:
    """A small frame of driver rows whose size Spark's planner knows (by way of Arrow)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields))


def _sort_exprs(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last() for c, asc in keys]


def value_ranges(df: DataFrame, keys: list[tuple[str, bool]], by: list[str], buckets: int) -> DataFrame:
    """``df`` in ``buckets`` sorted value ranges of (by, keys), written; ``__part`` is a
    row's range, ``__at`` its number there."""
    order = [F.col(c).asc_nulls_first() for c in by] + _sort_exprs(keys)
    # the id is made of the partition's number and the row's number in it
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumn("__id", place)
    return written(ranged.withColumns({
        "__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id"), "ranges")


def range_offsets(rows: DataFrame, by: list[str], sums: dict[str, str]) -> list[dict]:
    """Per (by, __part), in order: its first number and row count, and the count and
    the sums (each by its output name) over the group's earlier ranges."""
    totals = rows.groupBy(*by, "__part").agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"),
        *[F.coalesce(F.sum(src), F.lit(0)).alias("__tot_" + name) for name, src in sums.items()]).collect()
    out, group, before = [], None, {}
    for r in sorted(totals, key=lambda r: (*(r[c] for c in by), r["__part"])):
        if group != tuple(r[c] for c in by):
            group, before = tuple(r[c] for c in by), {"__before": 0} | {name: 0 for name in sums}
        out.append(r.asDict() | {"__off_" + c: v for c, v in before.items()})
        before = {c: v + (r["__rows"] if c == "__before" else r["__tot_" + c]) for c, v in before.items()}
    return out


def ordered_offsets(df: DataFrame, keys: list[tuple[str, bool]],
                    sums: dict[str, str] | None = None, rank_col: str = "rank",
                    count_col: str | None = "n", rows_per_bucket: int | None = None,
                    buckets: int | None = None, by: list[str] | None = None) -> DataFrame:
    return ordered_offsets_n(df, keys, sums, rank_col, count_col, rows_per_bucket, buckets, by)[0]


def ordered_offsets_n(df: DataFrame, keys: list[tuple[str, bool]],
                      sums: dict[str, str] | None = None, rank_col: str = "rank",
                      count_col: str | None = "n", rows_per_bucket: int | None = None,
                      buckets: int | None = None, by: list[str] | None = None,
                      n: int | None = None) -> tuple[DataFrame, int]:
    """Add the 1-based position ``rank_col`` in the order ``keys``, within each group
    of ``by`` if given, and return the row count too.

    ``keys`` is a list of ``(column, ascending)``; it should be a total order
    (end in a unique column) for a deterministic position.  Columns of ``by``
    must be non-NULL.  ``sums`` maps an output column to a source column whose
    running sum (this row included) is added.  ``count_col`` receives the count of
    all rows.  ``buckets`` forces the number of ranges (tests).  A known row count
    ``n`` saves a count.
    """
    sums, by = sums or {}, by or []
    if n is None:
        df = cache(df)
        n = df.count()
    k = buckets or max(1, math.ceil(n / (rows_per_bucket or ROWS_PER_BUCKET)))
    rows = value_ranges(df, keys, by, k)
    out = _placed(rows, range_offsets(rows, by, sums), by, sums, df.columns, rank_col)
    return (out.withColumn(count_col, F.lit(n).cast("long")) if count_col else out), n


def _placed(rows: DataFrame, offsets: list[dict], by: list[str], sums: dict[str, str], columns: list[str],
            rank_col: str) -> DataFrame:
    """Rows of the ranges named by ``offsets`` with their position and running sums."""
    if sums:
        running = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumns({"__run_" + name: F.sum(src).over(running) for name, src in sums.items()})
    names = [*by, "__part", "__first", "__off___before", *["__off_" + s for s in sums]]
    kinds = [rows.schema[c].dataType for c in [*by, "__part"]] + [T.LongType(), T.LongType()] + [
        rows.schema["__run_" + s].dataType for s in sums]
    # one row a range and group: Spark broadcasts them as long as they are few
    known = local_rows(rows.sparkSession, [[_as(o[c], k) for c, k in zip(names, kinds)] for o in offsets],
                       T.StructType([T.StructField(c, k) for c, k in zip(names, kinds)]))
    joined = rows.join(known, [*by, "__part"])
    return joined.select(
        *columns, (F.col("__off___before") + F.col("__at") - F.col("__first") + 1).cast("long").alias(rank_col),
        *[(F.col("__off_" + name) + F.col("__run_" + name)).alias(name) for name in sums])


def _as(value, kind: T.DataType):
    """A sum as a value of its column's type (a sum of nothing is an int 0)."""
    if isinstance(kind, T.DecimalType):
        return Decimal(value)
    return float(value) if isinstance(kind, T.DoubleType) else value


def exact_quantiles_of(df: DataFrame, wanted: dict[str, tuple[Column, float]],
                       rows_per_bucket: int | None = None, buckets: int | None = None) -> DataFrame:
    """One row of exact linear-interpolation quantiles: each name of ``wanted`` has
    a value (as an expression) and a probability.

    NULL values are skipped; without values a quantile is NULL.  Equal values of an
    expression are counted first (map-side), then all expressions' values go through
    one ordered pass; the running counts tell which values hold the positions around
    ``(n - 1) * p``.  No task gathers all values, and ties weigh nothing.
    """
    exprs = {str(value): value for value, _ in wanted.values()}
    number = {text: i for i, text in enumerate(exprs)}
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(number[text]).alias("__col"), value.cast("double").alias("__v"))
        for text, value in exprs.items()])).alias("__s")).select("__s.*")
    counted = cache(stacked.where(F.col("__v").isNotNull()).groupBy("__col", "__v")
                    .agg(F.count(F.lit(1)).alias("__c")))
    sizes = {r["__col"]: r for r in counted.groupBy("__col").agg(
        F.count(F.lit(1)).alias("distinct"), F.sum("__c").alias("n")).collect()}  # one row an expression
    if not sizes:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(nm) for nm in wanted])
    rows = value_ranges(counted, [("__v", True)], ["__col"], buckets or max(
        1, math.ceil(sum(r["distinct"] for r in sizes.values()) / (rows_per_bucket or ROWS_PER_BUCKET))))
    offsets = range_offsets(rows, ["__col"], {"__upto": "__c"})
    # only ranges that hold a wanted position are read again
    places = {(number[str(value)], place) for value, p in wanted.values() if number[str(value)] in sizes
              for place in _positions(sizes[number[str(value)]]["n"], p)}
    held = [o for o in offsets if any(
        c == o["__col"] and o["__off___upto"] < at <= o["__off___upto"] + o["__tot___upto"] for c, at in places)]
    rows = rows.where(F.col("__part").isin(sorted({o["__part"] for o in held})))
    ranked = _placed(rows, held, ["__col"], {"__upto": "__c"}, counted.columns, "__r")

    def at(col: int, position: int) -> Column:
        holds = ((F.col("__col") == col) & (F.col("__upto") >= position)
                 & (F.col("__upto") - F.col("__c") < position))
        return F.max(F.when(holds, F.col("__v")))

    aggs = []
    for name, (value, p) in wanted.items():
        col = number[str(value)]
        if col not in sizes:
            aggs.append(F.max(F.lit(None).cast("double")).alias(name))
            continue
        pos = (sizes[col]["n"] - 1) * p
        lo, hi = (at(col, place) for place in _positions(sizes[col]["n"], p))
        aggs.append((lo + (hi - lo) * F.lit(float(pos - math.floor(pos)))).alias(name))
    return ranked.agg(*aggs)


def _positions(n: int, p: float) -> tuple[int, int]:
    """1-based positions of n sorted values between which the quantile p lies."""
    return math.floor((n - 1) * p) + 1, math.ceil((n - 1) * p) + 1


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float],
                    names: list[str] | None = None, rows_per_bucket: int | None = None,
                    buckets: int | None = None) -> DataFrame:
    """One row with the exact quantiles of one column (see ``exact_quantiles_of``)."""
    names = names or [f"q{int(round(p * 100)):02d}" for p in probs]
    return exact_quantiles_of(df, {nm: (F.col(value_col), p) for nm, p in zip(names, probs)},
                              rows_per_bucket, buckets)


def grouped_quantiles(counted: DataFrame, group: str, value: str, count: str, wanted: dict[str, float],
                      rows_per_bucket: int | None = None, buckets: int | None = None) -> DataFrame:
    """Exact quantiles of each group's values, from (group, value, count) rows.

    One ordered pass over (group, value): a group's values lie in as many ranges as
    they need, so no task holds a group, and only the ranges with a wanted position
    are read again.  Groups are few (the boxes of a chart); their sizes are known on
    the driver.  Columns: group, the names of ``wanted`` (probability by name).
    """
    pairs = cache(counted.select(F.col(group), F.col(value).cast("double").alias("__v"), F.col(count).alias("__c")))
    k = buckets or max(1, math.ceil(pairs.count() / (rows_per_bucket or ROWS_PER_BUCKET)))
    rows = value_ranges(pairs, [("__v", True)], [group], k)
    offsets = range_offsets(rows, [group], {"__upto": "__c"})
    sizes = {o[group]: o["__off___upto"] + o["__tot___upto"] for o in offsets}  # the last range's counts
    held = [o for o in offsets if any(
        o["__off___upto"] < at <= o["__off___upto"] + o["__tot___upto"]
        for p in wanted.values() for at in _positions(sizes[o[group]], p))]
    rows = rows.where(F.col("__part").isin(sorted({o["__part"] for o in held})))
    ranked = _placed(rows, held, [group], {"__upto": "__c"}, pairs.columns, "__r")
    known = local_rows(pairs.sparkSession, [list(x) for x in sizes.items()], T.StructType(
        [pairs.schema[group], T.StructField("__n", T.LongType())]))
    held_rows = ranked.join(known, group)

    def at(position: Column) -> Column:
        holds = (F.col("__upto") >= position) & (F.col("__upto") - F.col("__c") < position)
        return F.max(F.when(holds, F.col("__v")))

    place = {name: (F.col("__n") - 1) * F.lit(float(p)) for name, p in wanted.items()}
    found = held_rows.groupBy(group, "__n").agg(*[
        at(end(place[name]) + 1).alias(f"__{side}_{name}") for name in wanted
        for side, end in (("lo", F.floor), ("hi", F.ceil))])
    return found.select(group, *[
        (F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * (place[name] - F.floor(place[name])))
        .alias(name) for name in wanted])
