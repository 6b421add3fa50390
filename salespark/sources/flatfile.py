"""Flat order export (CSV, Title_Case headers) and its split into three tables.

The flat file has one row per order line with customer and product
attributes repeated.  ``normalize`` splits it into ``customers``,
``products`` and ``orders``; customers and products keep the attributes of
their earliest order line.  All functions are lazy.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import col
from ..plans.session import ensure_checkpoint_dir
from . import loads, schema


def read_flat_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Read the flat export with its explicit schema (no inference).

    Quotes inside quoted fields are doubled.  A malformed line raises.  Fields with
    line breaks need ``multiline``: a file is then read whole by one task, so large
    exports should come in many files; without it such a field raises.
    """
    return (spark.read.schema(schema.FLAT).option("header", True).option("escape", '"')
            .option("multiLine", multiline).option("dateFormat", "yyyy-MM-dd").option("mode", "FAILFAST").csv(path))


def write_flat_csv(flat: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the flat export as CSV with a header line (one file per partition).

    White space around a text stays.  NULL and the empty text are both an empty field,
    which reads as NULL."""
    (flat.select(*schema.FLAT.fieldNames()).write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("emptyValue", "").option("dateFormat", "yyyy-MM-dd").csv(path))


def round_trip(flat: DataFrame) -> DataFrame:
    """``flat`` written as a CSV export to the shared checkpoint folder and read back."""
    spark = flat.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/flat-{uuid.uuid4().hex}"
    write_flat_csv(flat, path)
    return read_flat_csv(spark, path)


def to_flat(fact: DataFrame) -> DataFrame:
    """The joined fact in the flat export layout (26 Title_Case columns)."""
    return fact.select(*[F.col(snake).alias(flat) for flat, snake in schema.FLAT_TO_SNAKE.items()])


def to_snake_case(flat: DataFrame) -> DataFrame:
    """Rename every flat header to its snake_case column name."""
    mapping = {c: schema.FLAT_TO_SNAKE[c] for c in flat.columns if c in schema.FLAT_TO_SNAKE}
    return flat.withColumnsRenamed(mapping)


def _first_per_key(flat: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Attributes of each key's earliest line (by order date, then order id).

    A grouped ``min`` over a struct whose leading fields are the order
    columns.  It aggregates map-side before the shuffle, so one very hot key
    costs one small partial row per partition, not a one-task sort of all
    its lines.  Later struct fields only break exact ties deterministically.
    (A struct buffer is not fixed-width, so Spark runs this as a sort-based
    aggregate: each partition is sorted by key, with spill, and reduced.)
    """
    others = [c for c in columns if c != key]
    ordered = F.struct(F.col("Order_Date").alias("__d"), F.col("Order_ID").alias("__o"),
                       *[F.col(c) for c in others])
    picked = flat.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ordered).alias("__first"))
    return picked.select(F.col(key), *[F.col("__first." + c).alias(c) for c in others]) \
        .select(*columns)


def extract_customers(flat: DataFrame) -> DataFrame:
    cols = [schema.SNAKE_TO_FLAT[c] for c in schema.CUSTOMER_COLUMNS]
    return to_snake_case(_first_per_key(flat, "Customer_ID", cols))


def extract_products(flat: DataFrame) -> DataFrame:
    cols = [schema.SNAKE_TO_FLAT[c] for c in schema.PRODUCT_COLUMNS]
    return to_snake_case(_first_per_key(flat, "Product_ID", cols))


def extract_orders(flat: DataFrame) -> DataFrame:
    """The orders table: 14 columns, dates as ISO ``yyyy-MM-dd`` text."""
    out = []
    for c in schema.ORDER_COLUMNS:
        src = F.col(schema.SNAKE_TO_FLAT[c])
        if c in ("order_date", "ship_date"):
            src = F.date_format(src, "yyyy-MM-dd")
        out.append(src.alias(c))
    return flat.select(*out)


def normalize(flat: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return extract_customers(flat), extract_products(flat), extract_orders(flat)


def order_measures(lines: DataFrame, quantity: str = "quantity", unit_price: str = "unit_price",
                   discount: str = "discount", cost: str = "cost", order_date: str = "order_date",
                   ship_date: str = "ship_date") -> DataFrame:
    """Derived line measures, exact in DECIMAL:

    revenue = round(quantity * unit_price * (1 - discount), 2),
    profit = round(revenue - quantity * cost, 2),
    delivery_time = days from order to ship date.
    """
    q = col(quantity).cast("decimal(10,0)")
    revenue = F.round(q * col(unit_price).cast(schema.PRICE)
                      * (F.lit(1) - col(discount).cast(schema.RATE)), 2)
    profit = F.round(revenue - q * col(cost).cast(schema.PRICE), 2)
    return lines.withColumns({
        "revenue_calc": revenue.cast(schema.MONEY),
        "profit_calc": profit.cast(schema.MONEY),
        "delivery_days": F.datediff(col(ship_date), col(order_date)),
    })


def write_tables(customers: DataFrame, products: DataFrame, orders: DataFrame, base_path: str,
                 load_id: str | None = None, unique_orders: bool = False, all_required: bool = False) -> None:
    """Store one load of the three tables under ``base_path``, as one transaction
    (``sources.loads``): readers see all of it or nothing.

    Writing a load again replaces it: a replayed load changes nothing, a corrected one
    what was wrong, and every order line given is stored, whichever other lines of its
    order came before.  Without ``load_id`` the load gets a new name.

    ``unique_orders`` declares one line per order: a load that repeats an
    ``order_id``, or holds one that another load stored, raises ``ValueError``.
    NULL keys and customer names fail the load; ``all_required`` fails it for a NULL
    in any column declared NOT NULL.  A failed load is never seen.
    """
    spark = orders.sparkSession
    load = loads.begin(spark, base_path, load_id or uuid.uuid4().hex)
    if unique_orders:
        known = loads.read(spark, base_path, "orders", without=load.load_id)
        given = orders.groupBy("order_id").count()
        clash = given.where("count > 1")
        if known is not None:
            clash = clash.unionByName(given.join(known.select("order_id"), "order_id", "left_semi"))
        if not clash.isEmpty():
            raise ValueError(f"order_id is not unique: {clash.first()['order_id']!r}")
    columns = loads.DECLARED if all_required else loads.ALWAYS
    for name, frame in (("customers", customers), ("products", products), ("orders", orders)):
        loads.write(loads.required(frame, name, columns[name]), name, base_path, load)
    loads.commit(spark, base_path, load)


def load_csv_to_tables(spark: SparkSession, csv_path: str, base_path: str,
                       load_id: str | None = None, unique_orders: bool = False,
                       all_required: bool = True) -> None:
    """Read a flat export, split it into the three tables and store them.

    The load is named after the path unless ``load_id`` is given, so loading
    the same path again replaces its rows instead of adding them twice.  A NULL in a
    column declared NOT NULL fails the load.
    """
    name = load_id or hashlib.sha1(csv_path.encode("utf-8")).hexdigest()
    customers, products, orders = normalize(read_flat_csv(spark, csv_path))
    write_tables(customers, products, orders, base_path, name, unique_orders, all_required)


def read_tables(spark: SparkSession, base_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables over all committed loads, one snapshot of them, with their
    declared types.  Of a customer or product that several loads stored, the row of
    the earliest load counts."""
    committed = loads.commits(spark, base_path)
    customers, products, orders = (loads.read(spark, base_path, t, committed) for t in ("customers", "products", "orders"))
    customers = (loads.first_stored(customers, "customer_id", schema.CUSTOMER_COLUMNS) if customers is not None
                 else spark.createDataFrame([], schema.CUSTOMERS))
    products = (loads.first_stored(products, "product_id", schema.PRODUCT_COLUMNS) if products is not None
                else spark.createDataFrame([], schema.PRODUCTS))
    if orders is None:
        return customers, products, spark.createDataFrame([], schema.ORDERS)
    return customers, products, typed_orders(orders.select(*schema.ORDER_COLUMNS))


def typed_orders(orders: DataFrame) -> DataFrame:
    """Orders with their ISO text dates as dates."""
    return orders.withColumns({
        "order_date": F.to_date("order_date"), "ship_date": F.to_date("ship_date")})
