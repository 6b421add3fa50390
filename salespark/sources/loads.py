"""Committed loads of the three stored tables.

A load is one transaction over ``customers``, ``products`` and ``orders``.  Its files
go to a folder of the attempt that writes them; nothing is read from there until the
attempt is committed by a small file below ``_commits``, which comes into being by a
rename.  Readers take, of each load id, the attempt that was committed last, and no
other files.  So a reader between the writes sees the state before, a failed attempt
is never seen, a replay replaces its load in one step, and two loads at once don't
disturb each other: no load reads what another has stored.

Every load stores all customers and products that its lines point to.  Which row
counts where several loads have one is settled by readers: that of the load that was
first committed first (a replay keeps its load's place).  A load that no longer has
a customer takes nothing away from other loads' orders.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema

#: Columns of the orders files with Parquet bloom filters, for point filters.
LOOKUPS = ("customer_id", "product_id")


@dataclass(frozen=True)
class Commit:
    load_id: str
    version: int     # 0 for the load's first commit, one more for each replay
    order: int       # milliseconds of the first commit
    attempt: str     # folder of the files

    @property
    def folder(self) -> str:
        return f"load_id={_quoted(self.load_id)}/attempt={self.attempt}"


def _quoted(text: str) -> str:
    from urllib.parse import quote

    return "l-" + quote(text, safe="")


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def commits(spark: SparkSession, base_path: str) -> list[Commit]:
    """The commit that counts of each load, in load order: one small row a load."""
    folder = f"{base_path.rstrip('/')}/_commits"
    fs, where = _path(spark, folder)
    if not fs.exists(where):
        return []
    kinds = T.StructType([T.StructField("load_id", T.StringType()), T.StructField("version", T.LongType()),
                          T.StructField("order", T.LongType()), T.StructField("attempt", T.StringType())])
    last: dict[str, Commit] = {}
    for row in spark.read.schema(kinds).option("pathGlobFilter", "*.json").json(folder).collect():
        found = Commit(**row.asDict())
        known = last.get(found.load_id)
        if known is None or (known.version, known.attempt) < (found.version, found.attempt):
            last[found.load_id] = found
    return sorted(last.values(), key=lambda c: (c.order, c.load_id))


def begin(spark: SparkSession, base_path: str, load_id: str) -> Commit:
    """What the next attempt of a load will be committed as."""
    before = next((c for c in commits(spark, base_path) if c.load_id == load_id), None)
    return Commit(load_id, before.version + 1 if before else 0,
                  before.order if before else time.time_ns() // 1_000_000, f"a-{uuid.uuid4().hex}")


def write(frame: DataFrame, name: str, base_path: str, load: Commit) -> None:
    """Store one table of an attempt.

    ``orders`` is partitioned by order month (date filters prune files; ``rebalance``
    keeps that to a few files a month), sorted by customer within a file and has bloom
    filters for ``LOOKUPS``, so point filters skip row groups.
    """
    frame = frame.withColumn("load_order", F.lit(load.order).cast("long"))
    path = f"{base_path.rstrip('/')}/{name}/{load.folder}"
    if name == "orders":
        month = frame.withColumn("order_month", F.substring("order_date", 1, 7))
        writer = (month.hint("rebalance", "order_month").sortWithinPartitions("order_month", "customer_id", "product_id")
                  .write.partitionBy("order_month"))
        for c in LOOKUPS:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    else:
        writer = frame.write
    writer.parquet(path)


def commit(spark: SparkSession, base_path: str, load: Commit) -> None:
    """Make an attempt's files the load: the commit file appears by a rename."""
    folder = f"{base_path.rstrip('/')}/_commits"
    name = f"{_quoted(load.load_id)}.{load.version:08d}.{load.attempt}"
    fs, draft = _path(spark, f"{folder}/_{name}.draft")
    out = fs.create(draft, True)
    out.write(bytearray((json.dumps(asdict(load)) + "\n").encode("utf-8")))
    out.close()
    if not fs.rename(draft, _path(spark, f"{folder}/{name}.json")[1]):
        raise OSError(f"load {load.load_id!r} could not be committed")


def read(spark: SparkSession, base_path: str, name: str, committed: list[Commit] | None = None,
         without: str | None = None) -> DataFrame | None:
    """Rows of a table over all committed loads (but ``without``), as stored; None if there are none."""
    chosen = [c for c in (commits(spark, base_path) if committed is None else committed) if c.load_id != without]
    base = f"{base_path.rstrip('/')}/{name}"
    paths = [f"{base}/{c.folder}" for c in chosen]
    if name == "orders":  # an attempt without orders has no file
        paths = [p for p in paths if _path(spark, p)[0].exists(_path(spark, p)[1])]
    return spark.read.option("basePath", base).parquet(*paths) if paths else None


def first_stored(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key: that of the load first committed first (a grouped ``min``, partial map-side)."""
    others = [c for c in columns if c != key]
    picked = rows.groupBy(key).agg(F.min(F.struct("load_order", "load_id", *others)).alias("__row"))
    return picked.select(*[F.col(key) if c == key else F.col(f"__row.{c}").alias(c) for c in columns])


def remove_superseded(spark: SparkSession, base_path: str) -> int:
    """Delete the files of attempts that a later commit of their load replaced; returns
    their number.  For times without readers that began before the replay."""
    kept = {c.folder for c in commits(spark, base_path)}
    folder, gone = f"{base_path.rstrip('/')}/_commits", 0
    fs, where = _path(spark, folder)
    for row in spark.read.json(folder).collect() if kept else []:
        old = Commit(row.load_id, row.version, row.order, row.attempt)
        if old.folder in kept:
            continue
        for name in ("customers", "products", "orders"):
            fs.delete(_path(spark, f"{base_path.rstrip('/')}/{name}/{old.folder}")[1], True)
        gone += 1
    return gone


def required(frame: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """``frame`` whose write fails with the column's name where one of ``columns`` is NULL."""
    def checked(c: str) -> Column:
        kind = frame.schema[c].dataType
        return F.when(F.col(c).isNotNull(), F.col(c)).otherwise(
            F.raise_error(F.lit(f"NULL in {table}.{c}, which is declared NOT NULL")).cast(kind)).alias(c)

    return frame.select(*[checked(c) if c in columns else F.col(c) for c in frame.columns])


#: Columns declared NOT NULL: keys and names always, all others too where a load says so.
ALWAYS = {"customers": ["customer_id", "customer_name"], "products": ["product_id"], "orders": ["order_id"]}
DECLARED = {"customers": schema.CUSTOMER_COLUMNS, "products": schema.PRODUCT_COLUMNS, "orders": schema.ORDER_COLUMNS}
