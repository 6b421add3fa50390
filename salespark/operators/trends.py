"""Revenue/profit over time, breakdowns by a dimension, Pareto tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import money, month_end, ratio_pct, week_ending_sunday
from .ordered import cache, ordered_offsets

FREQS = ("D", "W", "ME")


def _bucket(freq: str):
    if freq == "D":
        return F.col("order_date")
    if freq == "W":
        return week_ending_sunday("order_date")
    if freq == "ME":
        return month_end("order_date")
    raise ValueError(f"freq must be one of {FREQS}")


def date_spine(bounds: DataFrame, freq: str, lo: str = "lo", hi: str = "hi",
               out: str = "order_date") -> DataFrame:
    """Every bucket label from ``lo`` to ``hi`` (one-row ``bounds``).

    Days and weeks step by 1 / 7 days; months step over month starts and are
    labelled by month end (stepping month ends would drift: Jan 31 + 1 month
    is Feb 28, then Mar 28).  The spine is as long as the calendar span.
    """
    if freq == "ME":
        seq = F.sequence(F.trunc(F.col(lo), "month"), F.trunc(F.col(hi), "month"),
                         F.expr("interval 1 month"))
        return bounds.select(F.explode(seq).alias("m")).select(F.last_day("m").alias(out))
    step = F.expr("interval 1 day") if freq == "D" else F.expr("interval 7 days")
    return bounds.select(F.explode(F.sequence(F.col(lo), F.col(hi), step)).alias(out))


def revenue_profit_trend(fact: DataFrame, freq: str = "ME") -> DataFrame:
    """Revenue, profit, distinct orders and margin per day / week / month.

    Buckets are labelled like a calendar resample: the day itself, the
    Sunday that ends the week, or the month end.  Buckets without sales
    between the first and last one are emitted with zeros (margin NULL).
    """
    bucketed = fact.where(F.col("order_date").isNotNull()).withColumn("__b", _bucket(freq))
    # one row per bucket, read by the bounds and by the join: kept, not recomputed
    agg = cache(bucketed.groupBy("__b").agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"),
        F.count_distinct("order_id").alias("orders")))
    bounds = agg.agg(F.min("__b").alias("lo"), F.max("__b").alias("hi"))
    spine = date_spine(bounds, freq)
    joined = spine.join(agg.withColumnRenamed("__b", "order_date"), "order_date", "left")
    revenue = F.coalesce(F.col("revenue"), F.lit(0))
    profit = F.coalesce(F.col("profit"), F.lit(0))
    return joined.select(
        "order_date",
        money(revenue).alias("revenue"),
        money(profit).alias("profit"),
        F.coalesce(F.col("orders"), F.lit(0)).cast("long").alias("orders"),
        F.when(revenue != 0, ratio_pct(profit, revenue)).alias("margin_pct"),
    ).orderBy("order_date")


def revenue_by_dimension(fact: DataFrame, dimension: str) -> DataFrame:
    """Revenue, profit, distinct orders and share of total revenue per value.

    NULL keys are dropped.  The total comes from a scalar subquery over the
    grouped rows (a one-value result), not from an unpartitioned window; the
    grouped rows are persisted so the fact is aggregated once.
    """
    grouped = cache(fact.where(F.col(dimension).isNotNull()).groupBy(dimension)
                    .agg(F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"),
                         F.count_distinct("order_id").alias("orders")))
    total = grouped.agg(F.sum("revenue")).scalar()
    share = F.when(total != 0, ratio_pct("revenue", total)).otherwise(F.lit(0.0))
    return grouped.select(
        dimension, money("revenue").alias("revenue"), money("profit").alias("profit"),
        F.col("orders").cast("long").alias("orders"),
        share.alias("revenue_share_pct"),
    ).orderBy(F.col("revenue").desc(), F.col(dimension))


def _pareto_groups(fact: DataFrame, dimension: str, metric: str) -> DataFrame:
    return (fact.where(F.col(dimension).isNotNull()).groupBy(dimension)
            .agg(F.coalesce(F.sum(metric), F.lit(0)).alias(metric)))


def pareto_analysis(fact: DataFrame, dimension: str = "product_name", metric: str = "revenue",
                    rows_per_bucket: int | None = None, buckets: int | None = None) -> DataFrame:
    """Items by ``metric`` (largest first, ties by the item), with the running
    total and the cumulative share of the overall total (1 dp, 0 if the total
    is 0).  The running total is computed with ``ordered_offsets``, so it
    never needs all items in one task.
    """
    grouped = _pareto_groups(fact, dimension, metric)
    ranked = ordered_offsets(grouped, [(metric, False), (dimension, True)],
                             sums={"cumulative": metric}, rank_col="position", count_col=None,
                             rows_per_bucket=rows_per_bucket, buckets=buckets)
    total = grouped.agg(F.sum(metric)).scalar()
    pct = F.when(total != 0, ratio_pct("cumulative", total)).otherwise(F.lit(0.0))
    return ranked.select(
        "position", dimension, money(metric).alias(metric),
        money("cumulative").alias("cumulative"), pct.alias("cumulative_pct"),
    ).orderBy("position")


def pareto_top(fact: DataFrame, dimension: str = "product_name", metric: str = "revenue",
               top_n: int = 20) -> DataFrame:
    """The first ``top_n`` Pareto rows.

    Only those rows are needed, so a distributed top-k (TakeOrderedAndProject:
    each partition keeps ``top_n`` rows) replaces the full running total; the
    cumulative share uses the overall total from a scalar subquery.
    """
    grouped = cache(_pareto_groups(fact, dimension, metric))
    top = grouped.orderBy(F.col(metric).desc(), F.col(dimension).asc()).limit(top_n)
    w = Window.orderBy(F.col(metric).desc(), F.col(dimension).asc())
    running = F.sum(metric).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = grouped.agg(F.sum(metric)).scalar()
    ranked = top.select(dimension, metric, F.row_number().over(w).cast("long").alias("position"),
                        running.alias("cumulative"))
    pct = F.when(total != 0, ratio_pct("cumulative", total)).otherwise(F.lit(0.0))
    return ranked.select(
        "position", dimension, money(metric).alias(metric),
        money("cumulative").alias("cumulative"), pct.alias("cumulative_pct"),
    ).orderBy("position")
