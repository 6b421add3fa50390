"""Headline KPIs and half-period revenue growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dround, is_returned, money


def daily_totals(fact: DataFrame) -> DataFrame:
    """Revenue per observed order date (one row per day: bounded by the calendar)."""
    return (fact.where(F.col("order_date").isNotNull())
            .groupBy("order_date")
            .agg(F.sum("revenue").alias("revenue")))


def period_growth(fact: DataFrame) -> DataFrame:
    """Second half of the date range against the first half, in percent.

    The midpoint is ``min + (max - min) / 2``; a date is in the first half
    when ``2 * (date - min) < (max - min)`` (exact in whole days, also for
    odd spans).  Growth is NULL for an empty input, a single date, or a zero
    first half.  One pass over the fact, to one row per calendar day.
    """
    return growth_of_days(daily_totals(fact))


def growth_of_days(daily: DataFrame, *sums: Column) -> DataFrame:
    """``period_growth`` from the revenue of each day (order_date, revenue), in one
    aggregate: the days, as many as the calendar has at most, are gathered in one
    row.  Days without a date count for ``sums`` alone."""
    dated = F.col("order_date").isNotNull()
    row = daily.agg(
        F.collect_list(F.when(dated, F.struct(F.col("order_date").alias("day"), F.col("revenue").alias("rev")))).alias("days"),
        F.min("order_date").alias("start_date"), F.max("order_date").alias("end_date"), *sums)
    span = F.datediff("end_date", "start_date")

    def half(later: bool) -> Column:
        def add(acc, day):
            in_first = F.datediff(day["day"], F.col("start_date")) * 2 < span
            return F.when(~in_first if later else in_first, (acc + F.coalesce(day["rev"], F.lit(0))).cast("decimal(38,4)")).otherwise(acc)
        return F.aggregate("days", F.lit(0).cast("decimal(38,4)"), add)

    halves = row.withColumns({"first_half": half(False), "second_half": half(True)})
    growth = F.when(
        F.col("start_date").isNull() | (F.col("start_date") == F.col("end_date"))
        | (F.col("first_half") == 0), F.lit(None).cast("double")
    ).otherwise(
        dround((F.col("second_half") - F.col("first_half")).cast("double")
               / F.col("first_half").cast("double") * 100, 1))
    return halves.select(
        "start_date", "end_date",
        money("first_half").alias("first_half_revenue"),
        money("second_half").alias("second_half_revenue"),
        growth.alias("revenue_growth_pct"),
        *[c for c in row.columns if c not in ("days", "start_date", "end_date")],
    )


def _distinct(c: str, approx: bool) -> Column:
    return F.approx_count_distinct(c) if approx else F.count_distinct(F.col(c))


def executive_summary(fact: DataFrame, approx: bool = False, profile=None) -> DataFrame:
    """One row of headline KPIs over every row of ``fact``.

    Revenue and profit (2 dp), distinct orders and customers, average order
    value (2 dp, 0 without orders), margin % and row-based return rate %
    (1 dp, 0 for an empty input) and half-period growth % (NULL when
    undefined).  ``approx=True`` uses HyperLogLog distinct counts.  A ``profile``
    of the fact (``profile.sales_profile``) has the sums already; the fact is then
    read for the distinct counts alone.
    """
    distinct = [_distinct("order_id", approx).alias("orders"), _distinct("customer_id", approx).alias("customers")]
    if profile is None:
        totals = fact.agg(
            F.coalesce(F.sum("revenue"), F.lit(0)).alias("rev"),
            F.coalesce(F.sum("profit"), F.lit(0)).alias("prof"),
            *distinct,
            F.count_if(is_returned()).alias("returned_rows"),
            F.count(F.lit(1)).alias("rows"),
        )
        growth = period_growth(fact)
    else:
        days = growth_of_days(
            profile.by("days").withColumnRenamed("rev", "revenue"),
            F.coalesce(F.sum("revenue"), F.lit(0)).alias("rev"), F.coalesce(F.sum("prof"), F.lit(0)).alias("prof"),
            F.coalesce(F.sum("returned_lines"), F.lit(0)).alias("returned_rows"),
            F.coalesce(F.sum("lines"), F.lit(0)).alias("rows")).select(F.struct("*")).scalar()
        totals = fact.agg(*distinct).withColumn("__days", days).select("orders", "customers", "__days.*")
        growth = None
    growth = F.col("revenue_growth_pct") if growth is None else growth.select("revenue_growth_pct").scalar()
    rev_d = F.col("rev").cast("double")
    return totals.select(
        money("rev").alias("total_revenue"),
        money("prof").alias("total_profit"),
        F.col("orders").cast("long").alias("total_orders"),
        F.col("customers").cast("long").alias("total_customers"),
        F.when(F.col("orders") > 0, dround(rev_d / F.col("orders"), 2))
        .otherwise(F.lit(0.0)).alias("average_order_value"),
        F.when(F.col("rev") != 0, dround(F.col("prof").cast("double") / rev_d * 100, 1))
        .otherwise(F.lit(0.0)).alias("profit_margin_pct"),
        F.when(F.col("rows") > 0, dround(F.col("returned_rows") / F.col("rows") * 100, 1))
        .otherwise(F.lit(0.0)).alias("return_rate_pct"),
        growth.alias("revenue_growth_pct"),
    )
