"""Integrity rules of the star schema, checked as distributed aggregates.

Primary keys unique, foreign keys resolve, declared NOT NULL columns hold no
NULLs.  Parquet has no constraints, so ``constraint_report`` computes the
violations instead of rejecting rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schema

# Primary key, NOT NULL columns and foreign keys of each table.
PRIMARY_KEYS = {"customers": "customer_id", "products": "product_id", "orders": "order_id"}
NOT_NULL = {
    "customers": schema.CUSTOMER_COLUMNS,
    "products": schema.PRODUCT_COLUMNS,
    "orders": schema.ORDER_COLUMNS,
}
FOREIGN_KEYS = [("orders", "customer_id", "customers"), ("orders", "product_id", "products")]

REPORT_COLUMNS = ["table_name", "rule", "column_name", "violations"]


def _rows(table: str, counts: DataFrame, items: list[tuple[str, str, str]]) -> DataFrame:
    """Unpivot a one-row frame of counts into report rows; ``items`` are
    (rule, column name, count column)."""
    stacked = counts.select(F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column_name"),
                 F.col(src).cast("long").alias("violations"))
        for rule, c, src in items])).alias("r"))
    return stacked.select(F.lit(table).alias("table_name"), "r.rule", "r.column_name",
                          "r.violations")


def constraint_report(customers: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per (table, rule, column) with the number of violating rows.

    * ``primary_key``: rows beyond the first per key value (plus NULL keys);
    * ``not_null``: NULLs in a declared NOT NULL column;
    * ``foreign_key``: rows whose reference has no parent (``left_anti``).
    """
    tables = {"customers": customers, "products": products, "orders": orders}
    parts = []
    for name, frame in tables.items():
        key = PRIMARY_KEYS[name]
        cols = [c for c in NOT_NULL[name] if c in frame.columns]
        # One pass per table: NULL counts, row count and distinct keys together.
        agg = frame.agg(
            *[F.count_if(F.col(c).isNull()).alias(c) for c in cols],
            (F.count(F.lit(1)) - F.count_distinct(F.col(key))).alias("__dup"),
        )
        parts.append(_rows(name, agg, [("not_null", c, c) for c in cols]
                           + [("primary_key", key, "__dup")]))
    for child, fk, parent in FOREIGN_KEYS:
        parts.append(_rows(child, _orphans(tables[child], fk, tables[parent], PRIMARY_KEYS[parent]),
                           [("foreign_key", fk, "n")]))
    return reduce(DataFrame.unionByName, parts)


def _orphans(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """One row ``n``: rows of ``child`` whose reference has no parent.

    The child is reduced to (key, rows) first (map-side partial aggregate), so
    the anti-join shuffles distinct keys, not every row of a hot key.
    """
    parent_keys = parent.select(F.col(key).alias(fk)).distinct()
    per_key = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("__rows"))
    return per_key.join(parent_keys, fk, "left_anti").agg(
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("n"))


def foreign_key_report(tables: dict[str, DataFrame],
                       keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """One row per (child table, column, parent table, parent key): rows without a parent
    and parent rows beyond the first of their key (``left_anti``, grouped counts).

    Zeros throughout are what ``sales_fact(trust_foreign_keys=True)`` relies on.
    """
    parts = []
    for child, fk, parent, key in keys:
        orphans = _orphans(tables[child], fk, tables[parent], key).scalar()
        repeated = tables[parent].agg(
            (F.count(key) - F.count_distinct(key)).cast("long").alias("repeated_keys"))
        parts.append(repeated.select(F.lit(child).alias("table_name"), F.lit(fk).alias("column_name"),
                                     F.lit(parent).alias("parent"), orphans.cast("long").alias("orphans"),
                                     "repeated_keys"))
    return reduce(DataFrame.unionByName, parts)
