"""Customer analytics: RFM scoring and segments, churn risk, lifetime value,
repeat-purchase rate.  One row per customer; customers are a grouping key
that grows with the data, so nothing here gathers customers in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import money, quintile_score, ratio_pct, safe_div
from .ordered import cache, ordered_offsets_n

# Segment names in rule order, and the churn bands
# (right-closed day ranges) with their labels.
SEGMENTS = ("Champions", "Loyal customers", "New customers", "At risk", "Lost", "Needs attention")
RFM_METRICS = ("recency_days", "frequency", "monetary")
CHURN_BANDS = ((-1, 30, "Low"), (30, 90, "Medium"), (90, 10_000, "High"))


def _reference_date(fact: DataFrame, reference_date) -> Column:
    if reference_date is None:
        return fact.agg(F.max("order_date")).scalar()
    if isinstance(reference_date, (dt.date, str)):
        return F.to_date(F.lit(str(reference_date)))
    return reference_date


def customer_names(fact: DataFrame) -> DataFrame:
    """One name per customer (the smallest non-NULL one).

    Taken from the distinct (customer, name) pairs, a hash de-duplication
    that reduces map-side, so the string ``min`` only sees a few rows per
    customer.  Keeping strings out of the measures' aggregation lets that
    one run as a code-generated hash aggregate instead of sorting every
    fact row.
    """
    pairs = (fact.where(F.col("customer_id").isNotNull() & F.col("customer_name").isNotNull())
             .select("customer_id", "customer_name").distinct())
    return pairs.groupBy("customer_id").agg(F.min("customer_name").alias("customer_name"))


def rfm_base(fact: DataFrame, reference_date=None) -> DataFrame:
    """Per customer: name, last order date, distinct orders, revenue, recency.

    ``reference_date`` defaults to the latest order date in ``fact``, rows
    without a customer included.
    """
    dated = fact.where(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
    ref = _reference_date(fact, reference_date)
    measures = dated.groupBy("customer_id").agg(
        F.max("order_date").alias("last_order_date"),
        F.count_distinct("order_id").alias("frequency"),
        F.sum("revenue").alias("monetary"),
    )
    base = measures.join(customer_names(dated), "customer_id", "left").select(
        "customer_id", "customer_name", "last_order_date", "frequency", "monetary")
    return base.withColumn("recency_days", F.datediff(ref, F.col("last_order_date")))


def segment_expr(r: str = "r_score", f: str = "f_score", m: str = "m_score") -> Column:
    """Named segment from the three scores; the first matching rule wins."""
    r, f, m = F.col(r), F.col(f), F.col(m)
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), SEGMENTS[0])
            .when((r >= 3) & (f >= 3), SEGMENTS[1])
            .when((r >= 4) & (f <= 2), SEGMENTS[2])
            .when((r <= 2) & (f >= 4), SEGMENTS[3])
            .when((r <= 2) & (f <= 2) & (m <= 2), SEGMENTS[4])
            .otherwise(SEGMENTS[5]))


def compute_rfm(fact: DataFrame, reference_date=None, rows_per_bucket: int | None = None,
                buckets: int | None = None) -> DataFrame:
    """RFM scores 1..5 by equal-count quintiles of each metric's position.

    Positions break ties by customer id (first-come order of the sorted
    customers); a NULL metric comes last.  Recency scores are reversed (recent =
    5).  Positions come from one ``ordered_offsets`` pass over (metric, value,
    customer): bounded tasks at any customer count.
    """
    base = cache(rfm_base(fact, reference_date))
    n = base.count()
    # the three metrics as rows, so that one ordered pass ranks them all
    rows = base.select("customer_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("decimal(38,4)").alias("value"))
        for m in RFM_METRICS])).alias("__m")).select("customer_id", "__m.*")
    ranked, _ = ordered_offsets_n(rows, [("value", True), ("customer_id", True)], rank_col="__rank", count_col=None,
                                  rows_per_bucket=rows_per_bucket, buckets=buckets, by=["metric"],
                                  n=len(RFM_METRICS) * n)
    score = quintile_score("__rank", F.lit(n))
    scores = ranked.groupBy("customer_id").agg(*[
        F.max(F.when(F.col("metric") == m, score)).alias(m[0] + "_score") for m in RFM_METRICS])
    scored = base.join(scores, "customer_id").select(
        "customer_id", "customer_name", "last_order_date", "frequency", "monetary", "recency_days",
        (F.lit(6) - F.col("r_score")).alias("r_score"), "f_score", "m_score")
    return scored.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score")) \
        .withColumn("segment", segment_expr())


def segment_summary(rfm: DataFrame) -> DataFrame:
    """Customers and total monetary value per segment, largest value first."""
    return (rfm.groupBy("segment")
            .agg(F.count_distinct("customer_id").alias("customers"),
                 F.sum("monetary").alias("total_monetary"))
            .orderBy(F.col("total_monetary").desc(), "segment"))


def segment_counts(rfm: DataFrame) -> DataFrame:
    return rfm.groupBy("segment").agg(F.count(F.lit(1)).alias("customers")) \
        .orderBy(F.col("customers").desc(), "segment")


def customers_to_target(rfm: DataFrame) -> DataFrame:
    """One row: number of Champions and of At-risk customers."""
    return rfm.agg(F.count_if(F.col("segment") == SEGMENTS[0]).alias("champions"),
                   F.count_if(F.col("segment") == SEGMENTS[3]).alias("at_risk"))


def churn_band(recency: Column) -> Column:
    expr = None
    for lo, hi, label in CHURN_BANDS:
        cond = (recency > lo) & (recency <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def churn_risk(fact: DataFrame, reference_date=None) -> DataFrame:
    """Last order date, recency in days and a Low / Medium / High band.

    Recency outside the bands (e.g. a reference date before the last order)
    gets NULL.
    """
    dated = fact.where(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
    ref = _reference_date(fact, reference_date)
    last = dated.groupBy("customer_id").agg(F.max("order_date").alias("last_order_date"))
    recency = F.datediff(ref, F.col("last_order_date"))
    return last.select("customer_id", "last_order_date", recency.alias("recency_days"),
                       churn_band(recency).alias("churn_risk"))


def churn_counts(churn: DataFrame) -> DataFrame:
    return (churn.where(F.col("churn_risk").isNotNull()).groupBy("churn_risk")
            .agg(F.count(F.lit(1)).alias("customers"))
            .orderBy(F.col("customers").desc(), "churn_risk"))


def customer_lifetime_value(fact: DataFrame) -> DataFrame:
    """Revenue, profit, distinct orders and average order value per customer (a
    look-back measure), in no order: a sort of all customers is left to the caller
    (``top_customers`` ranks with a top-k)."""
    known = fact.where(F.col("customer_id").isNotNull())
    clv = (known.groupBy("customer_id")
           .agg(F.sum("revenue").alias("lifetime_revenue"),
                F.sum("profit").alias("lifetime_profit"),
                F.count_distinct("order_id").alias("orders"))
           .join(customer_names(known), "customer_id", "left"))
    return clv.select(
        "customer_id", "customer_name",
        money("lifetime_revenue").alias("lifetime_revenue"),
        money("lifetime_profit").alias("lifetime_profit"),
        F.col("orders").cast("long").alias("orders"),
        safe_div("lifetime_revenue", "orders", 2).alias("avg_order_value"),
    )


def top_customers(fact: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` customers with the highest lifetime profit (distributed top-k)."""
    return (customer_lifetime_value(fact)
            .orderBy(F.col("lifetime_profit").desc(), "customer_id").limit(n))


def repeat_customer_rate(fact: DataFrame) -> DataFrame:
    """One row: % of customers with more than one distinct order (0 if none)."""
    per_customer = (fact.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
                    .agg(F.count_distinct("order_id").alias("orders")))
    agg = per_customer.agg(F.count_if(F.col("orders") > 1).alias("repeat"),
                           F.count(F.lit(1)).alias("customers"))
    return agg.select(F.when(F.col("customers") > 0, ratio_pct("repeat", "customers"))
                      .otherwise(F.lit(0.0)).alias("repeat_rate_pct"))
