"""The joined sales fact: one row per order line with customer and product attributes.

Two ways to build it:

* ``fact_from_tables`` joins normalised ``orders``, ``customers`` and
  ``products`` tables (the reference star schema, e.g. written by
  ``sources.flatfile.write_tables``);
* ``sales_fact`` maps the driver's TPC-H-like parquet tables onto the same 26
  columns.

Both are lazy.  Catalyst prunes the columns an operator does not use, and the
parquet scans receive pushed filters.  ``materialize_fact`` writes the fact
once (partitioned by order month) for repeated use at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema

# A join side is broadcast only when its bytes (exact row count by the width of its
# columns) are at most this; beyond it the join is a sort-merge join (AQE splits
# skewed partitions).
BROADCAST_MAX_BYTES = 64 << 20
# Bytes a text is counted with: names, dates and codes of the dimensions are shorter.
TEXT_BYTES = 32
# Lines (or orders) a task of a sort-merge join of the fact takes, about, however many there are: the
# session's number of shuffle partitions and AQE's merging of them let a task grow with the table.
LINES_PER_TASK = 250_000

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Exact row count of a parquet table, answered from its file footers (read anew
    each time, so a table that grows is never taken for its former size)."""
    return read_table(spark, sf_dir, name).count()


def row_bytes(side: DataFrame) -> int:
    """Bytes of a row: fixed widths as they are, texts as ``TEXT_BYTES``, and a row's own cost."""
    fixed = {"byte": 1, "boolean": 1, "short": 2, "integer": 4, "float": 4, "date": 4}
    texts = {"string", "binary", "varchar", "char"}
    return 16 + sum(TEXT_BYTES if f.dataType.typeName() in texts else fixed.get(f.dataType.typeName(), 16)
                    for f in side.schema.fields)


def broadcast_if_small(side: DataFrame, bound_rows: int, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Hint ``side`` for broadcast when ``bound_rows`` rows of its width (the exact row
    count of a table with at least as many rows, e.g. the parquet table ``side`` is
    derived from; see ``table_rows``) are at most ``max_bytes``.

    The count of an unfiltered parquet scan is answered from file footers,
    so the check costs no data scan at any size.  Without the hint the
    planner's static estimate for a join output is the product of its
    inputs, which would make the fact look like the small side.
    """
    return F.broadcast(side) if bound_rows * row_bytes(side) <= max_bytes else side


def join_side(side: DataFrame, key: str | list[str], bound_rows: int, lines: int, merge: bool = False) -> DataFrame:
    """``side`` of a join of ``lines`` rows: broadcast if small, else dealt out by ``key`` over
    so many partitions that a task has about ``LINES_PER_TASK`` lines.  Spark shuffles the
    lines alike, if it shuffles them; they aren't touched where it broadcasts the side after all,
    which ``merge`` forbids: the lines then lie by ``key``."""
    hinted = broadcast_if_small(side, bound_rows)
    if hinted is not side:
        return hinted
    keys = [key] if isinstance(key, str) else key
    dealt = side.repartition(max(1, -(-lines // LINES_PER_TASK)), *keys)
    return dealt.hint("merge") if merge else dealt


def customer_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer ⋈ nation ⋈ region as the customer dimension.

    ``nation`` and ``region`` are tiny; the planner broadcasts them through
    its size check.  ``customer`` itself is joined by key (it grows with the
    data and is not assumed to fit in a broadcast).
    """
    region = read_table(spark, sf_dir, "region").select(
        F.col("r_regionkey"), F.col("r_name").alias("region"))
    nation = read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey"), F.col("n_name").alias("state"), F.col("n_regionkey"))
    geo = nation.join(broadcast_if_small(region, table_rows(spark, sf_dir, "region")),
                      nation.n_regionkey == region.r_regionkey, "inner")
    geo = broadcast_if_small(geo, table_rows(spark, sf_dir, "nation"))
    cust = read_table(spark, sf_dir, "customer")
    return cust.join(geo, cust.c_nationkey == geo.n_nationkey, "inner").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.lit(None).cast("int").alias("age"),
        F.lit(None).cast("string").alias("gender"),
        F.col("c_mktsegment").alias("city"),
        "state",
        "region",
        F.lit(None).cast("string").alias("country"),
    )


def product_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
        F.col("p_name").alias("product_name"),
        F.col("p_retailprice").cast(schema.PRICE).alias("cost"),
    )


def numbered_rows(dim: DataFrame, key: str, number: str) -> DataFrame:
    """``dim`` with each row's number among those of its key: 1 throughout where the key is unique.
    Rows that differ get the same numbers each time they are read."""
    others = [c for c in dim.columns if c != key]
    return dim.where(F.col(key).isNotNull()) \
        .withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(*others)))


def sales_fact(spark: SparkSession, sf_dir: str, trust_foreign_keys: bool = False,
               read_again: bool = False) -> DataFrame:
    """The 26-column joined fact built from the driver's parquet tables.

    Join order: orders ⋈ customer first (orders is the smaller fact side),
    then lineitem ⋈ that on the order key, then ⋈ part.  Each join is an
    inner equi-join; rows without a match drop, as in the reference.
    Lineitem is always the streamed side; the others are broadcast only
    below ``BROADCAST_MAX_BYTES`` (exact footer counts by column widths), else joined by
    sort-merge on the key.

    ``trust_foreign_keys=True`` (for data whose integrity report shows unique
    keys and no orphans) joins left outer against dimensions made unique on
    their key.
    Catalyst then removes every join whose columns a query does not use, so
    e.g. product measures never touch orders or customers.  With no orphans
    the rows are the same as with inner joins.

    ``read_again=True`` (for queries that read the fact several times, each time with other
    columns) gives the same rows.  The lines joined with orders and products keep all their
    columns, whichever are used, so Spark shuffles them once and reads that again.  Up to there
    a customer is its key and the number of its row; the texts follow in a last join, left
    outer and unique, which Catalyst removes for those who don't use them.  (Trusted keys have
    columns and joins pruned in each reading instead.)
    """
    how = "left" if trust_foreign_keys else "inner"
    read_again = read_again and not trust_foreign_keys

    def dim(df: DataFrame, key: str) -> DataFrame:
        return df.dropDuplicates([key]) if trust_foreign_keys else df

    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), F.col("o_custkey"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderpriority").alias("sales_channel"),
        F.col("o_orderstatus").alias("payment_method"),
    )
    n_orders, n_lines = table_rows(spark, sf_dir, "orders"), table_rows(spark, sf_dir, "lineitem")
    n_customers = table_rows(spark, sf_dir, "customer")
    customers = dim(customer_dim(spark, sf_dir), "customer_id")
    if read_again:
        customers = numbered_rows(customers, "customer_id", "__row")
    cust = customers.select("customer_id", "__row") if read_again else customers
    cust = join_side(cust, "customer_id", n_customers, n_orders)
    orders_c = dim(orders, "o_orderkey").join(cust, orders.o_custkey == cust.customer_id, how)
    orders_c = join_side(orders_c, "o_orderkey", n_orders, n_lines)

    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_shipdate")
    lines = li.join(orders_c, li.l_orderkey == orders_c.o_orderkey, how)
    prod = join_side(dim(product_dim(spark, sf_dir), "product_id"), "product_id",
                     table_rows(spark, sf_dir, "part"), n_lines, merge=read_again)
    joined = lines.join(prod, lines.l_partkey == prod.product_id, how)
    if read_again:
        # a generator of one row takes all columns, so none is pruned below it; the key stays
        # outside, so Spark knows that the lines lie by product
        whole = [c for c in joined.columns if c not in ("l_partkey", "o_orderkey", "o_custkey", "product_id")]
        joined = joined.select("product_id", F.inline(F.array(F.struct(*whole))))
        unique = customers.dropDuplicates(["customer_id", "__row"])
        unique = join_side(unique, ["customer_id", "__row"], n_customers, n_lines, merge=True)
        joined = joined.join(unique, ["customer_id", "__row"], "left")

    discount = F.col("l_discount").cast(schema.RATE)
    quantity = F.col("l_quantity").cast("int")
    revenue = (F.col("l_extendedprice").cast(schema.PRICE) * (F.lit(1) - discount)).cast(schema.MONEY)
    ship_date = F.col("l_shipdate").cast("date")
    return joined.select(
        F.col("l_orderkey").alias("order_id"),
        "order_date",
        ship_date.alias("ship_date"),
        quantity.alias("quantity"),
        discount.alias("discount"),
        revenue.alias("revenue"),
        (revenue - quantity * F.col("cost")).cast(schema.MONEY).alias("profit"),
        "sales_channel",
        "payment_method",
        F.when(F.col("l_returnflag") == "R", "Yes").otherwise("No").alias("returned"),
        F.datediff(ship_date, F.col("order_date")).alias("delivery_time"),
        (F.lit(1) + quantity % 5).alias("rating"),
        "customer_id", "customer_name", "age", "gender", "city", "state", "region", "country",
        "product_id", "category", "sub_category", "product_name",
        unit_price_expr("l_extendedprice", "l_quantity").alias("unit_price"),
        "cost",
    )


def unit_price_expr(extended_price: str, quantity: str):
    """Line price per unit, rounded half up to cents in exact integer arithmetic
    (NULL for a zero quantity)."""
    cents = f"CAST(CAST({extended_price} AS DECIMAL(12,2)) * 100 AS BIGINT)"
    qty = f"CAST({quantity} AS BIGINT)"
    return F.expr(f"CASE WHEN {qty} > 0 THEN CAST(CAST(({cents} * 2 + {qty}) div (2 * {qty}) "
                  f"AS DECIMAL(14,0)) * 0.01 AS DECIMAL(12,2)) END")


def fact_from_tables(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """The reference's single join: orders ⋈ products ⋈ customers (inner).

    Products come first: lines that already lie by product aren't shuffled again, and the
    shuffle by customer carries the few product columns, not the customers'."""
    cust = customers.select(*schema.CUSTOMER_COLUMNS)
    prod = products.select(*schema.PRODUCT_COLUMNS)
    fact = (orders.join(prod, "product_id", "inner")
            .join(cust, "customer_id", "inner"))
    return fact.select(*schema.FACT_COLUMNS)


def materialize_fact(fact: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write the fact as parquet partitioned by order month and read it back.

    The result keeps the ``order_month`` partition column (``yyyy-MM``);
    ``operators.filters`` adds a month predicate to every date-range filter
    on such a frame, so date filters prune whole partitions.  Every later
    query starts from one scan instead of re-running the star join.
    ``path`` must be shared storage on a cluster.
    """
    # ``rebalance`` shuffles by month once; AQE then splits a hot month over
    # several tasks and merges small months, so files stay near the advisory
    # partition size instead of one file per (task, month).
    (fact.withColumn("order_month", F.date_format("order_date", "yyyy-MM"))
     .hint("rebalance", "order_month")
     .write.mode(mode).partitionBy("order_month").parquet(path))
    return fact.sparkSession.read.parquet(path)


def output_frame(df: DataFrame) -> DataFrame:
    """Cast DECIMAL columns to DOUBLE for hand-off (reports, oracle checks)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "decimal":
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
