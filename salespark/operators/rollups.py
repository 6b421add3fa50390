"""Fixed aggregate views that the reference runs as SQL in its store.

Row counts here are ``COUNT(*)`` over order lines (not distinct orders),
amounts are rounded to 2 dp, as in those views.  Each is one grouped
aggregate with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dround, money

TOP_BY = ("revenue", "profit")


def region_rollup(fact: DataFrame) -> DataFrame:
    """Revenue, profit (2 dp) and line count per customer region."""
    return (fact.groupBy("region")
            .agg(money(F.sum("revenue")).alias("revenue"), money(F.sum("profit")).alias("profit"),
                 F.count(F.lit(1)).alias("orders"))
            .orderBy(F.col("revenue").desc(), "region"))


def top_products_rollup(fact: DataFrame, n: int = 10, by: str = "revenue") -> DataFrame:
    """Top ``n`` products by total revenue or profit (2 dp) with units sold."""
    if by not in TOP_BY:
        raise ValueError("by must be 'revenue' or 'profit'")
    n = int(n)
    # grouped by all three, as the view does (numeric buffers: a hash aggregate)
    g = (fact.groupBy("product_id", "product_name", "category")
         .agg(money(F.sum("revenue")).alias("revenue"), money(F.sum("profit")).alias("profit"),
              F.sum("quantity").cast("long").alias("units_sold")))
    return (g.orderBy(F.col(by).desc(), F.col("product_id"))
            .limit(n).select("product_name", "category", "revenue", "profit", "units_sold"))


def monthly_rollup(fact: DataFrame) -> DataFrame:
    """Revenue, profit and line count per ``yyyy-MM`` month that has sales
    (months without sales are absent)."""
    return (fact.groupBy(F.date_format("order_date", "yyyy-MM").alias("month"))
            .agg(money(F.sum("revenue")).alias("revenue"), money(F.sum("profit")).alias("profit"),
                 F.count(F.lit(1)).alias("orders"))
            .orderBy("month"))


def return_rate_by_category(fact: DataFrame) -> DataFrame:
    """Return rate % (1 dp) and line count per category, highest rate first."""
    g = fact.groupBy("category").agg(
        F.sum(F.when(F.col("returned") == "Yes", 1).otherwise(0)).alias("__ret"),
        F.count(F.lit(1)).alias("orders"))
    return g.select("category",
                    dround(F.lit(100.0) * F.col("__ret") / F.col("orders"), 1)
                    .alias("return_rate_pct"), "orders") \
        .orderBy(F.col("return_rate_pct").desc(), "category")
