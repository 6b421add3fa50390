"""Sums of the stored orders, kept by load and refreshed by new loads only.

For every committed attempt of a load, ``refresh`` writes its sums once: by day, by
product, by customer and month, by discount, and its distinct (order, customer) pairs.
Sums of sums are sums, so any later read-out adds up the loads' small tables; only
loads that were committed since the last refresh have their orders read.  A replay is
a new attempt: its sums replace those of the old one as its files do.

Sums are kept by the orders' own keys.  What customers and products are called, and
which region or category they belong to, is looked up when they are read, so a
corrected customer needs no order to be read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import band_index, is_returned
from ..operators.ordered import written
from ..operators.products import DEFAULT_DISCOUNT_EDGES
from ..operators.profile import BAND, GROUPINGS, MEASURES, MONTH, Profile
from ..sources import flatfile, loads

# The stored groupings: name -> columns.
STORED = {"day": ["order_date"], "product": ["product_id"], "customer_month": ["customer_id", MONTH],
          "discount": ["discount"], "order": ["order_id", "customer_id"]}
_COLUMNS = list(dict.fromkeys(c for keys in STORED.values() for c in keys))


def _folder(base_path: str, commit: loads.Commit) -> str:
    return f"{base_path.rstrip('/')}/_sums/attempt={commit.attempt}"


def _sums(orders: DataFrame) -> DataFrame:
    """Sums of order lines by every stored grouping, in one pass.  Lines without a
    customer or a product have no row in the joined fact and none here."""
    lines = flatfile.typed_orders(orders).where(F.col("customer_id").isNotNull() & F.col("product_id").isNotNull())
    lines = lines.withColumns({MONTH: F.trunc("order_date", "month"), "__ret": is_returned().cast("int")})
    ids = {sum(1 << i for i, c in enumerate(reversed(_COLUMNS)) if c not in keys): name for name, keys in STORED.items()}
    names = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return (lines.groupingSets([[F.col(c) for c in keys] for keys in STORED.values()], *_COLUMNS)
            .agg(F.sum("revenue").alias("rev"), F.sum("profit").alias("prof"),
                 F.sum("quantity").cast("long").alias("units_sold"), F.count(F.lit(1)).alias("lines"),
                 F.sum("__ret").alias("returned_lines"), F.grouping_id().cast("int").alias("__id"))
            .withColumn("kept_by", names[F.col("__id")]).drop("__id"))


def refresh(spark: SparkSession, base_path: str) -> list[str]:
    """Bring the kept sums up to the committed loads; returns the loads whose orders were read."""
    read = []
    for commit in loads.commits(spark, base_path):
        fs, done = loads._path(spark, f"{_folder(base_path, commit)}/_SUCCESS")
        if fs.exists(done):
            continue
        orders = loads.read(spark, base_path, "orders", [commit])
        if orders is None:
            continue
        _sums(orders).write.mode("overwrite").partitionBy("kept_by").parquet(_folder(base_path, commit))
        read.append(commit.load_id)
    return read


def kept(spark: SparkSession, base_path: str) -> DataFrame | None:
    """The kept sums of all committed loads, a row a load and key; None without loads."""
    paths = []
    for commit in loads.commits(spark, base_path):
        fs, done = loads._path(spark, f"{_folder(base_path, commit)}/_SUCCESS")
        if fs.exists(done):
            paths.append(_folder(base_path, commit))
    if not paths:
        return None
    return spark.read.option("basePath", f"{base_path.rstrip('/')}/_sums").parquet(*paths).drop("attempt")


def stored_profile(spark: SparkSession, base_path: str, edges: list[float] | None = None) -> Profile | None:
    """The profile of the stored fact from the kept sums: equal to ``sales_profile`` of the
    joined tables, without reading an order.  Its ``fact`` has the distinct (order,
    customer) pairs, enough for the distinct counts of the summary."""
    sums = kept(spark, base_path)
    if sums is None:
        return None
    edges = edges or DEFAULT_DISCOUNT_EDGES
    customers, products, _ = flatfile.read_tables(spark, base_path)

    def by(name: str) -> DataFrame:
        return sums.where(F.col("kept_by") == name)

    sources = {
        "products": by("product").drop("category").join(products.drop("unit_price", "cost"), "product_id"),
        "categories": by("product").join(products.select("product_id", "category"), "product_id"),
        "region_months": by("customer_month").join(customers.select("customer_id", "region"), "customer_id"),
        "bands": by("discount").withColumn(BAND, band_index("discount", edges)),
        "days": by("day"),
    }
    rows = None
    for name, source in sources.items():
        added = source.groupBy(*GROUPINGS[name]).agg(*[F.sum(m).alias(m) for m in MEASURES]).withColumn("grouping", F.lit(name))
        rows = added if rows is None else rows.unionByName(added, allowMissingColumns=True)
    return Profile(by("order").select("order_id", "customer_id").distinct(), written(rows, "profile"), edges)
