from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from salespark.operators.trends import (pareto_analysis, pareto_top, revenue_by_dimension,
                                        revenue_profit_trend)

from .conftest import rows_by


def test_revenue_by_region(sample_df):
    out = revenue_by_dimension(sample_df, "region")
    rows = out.collect()
    assert rows[0].region == "North"
    by = rows_by(out, "region")
    assert (by["North"]["revenue"], by["North"]["profit"], by["North"]["orders"],
            by["North"]["revenue_share_pct"]) == (1116.0, 386.0, 7, 66.1)
    assert (by["West"]["revenue"], by["West"]["profit"], by["West"]["revenue_share_pct"]) == \
        (324.0, 114.0, 19.2)
    assert by["East"]["revenue_share_pct"] == 13.3
    assert by["Central"]["revenue_share_pct"] == 1.4
    assert abs(sum(r.revenue_share_pct for r in rows) - 100) < 0.5


def test_null_keys_dropped(sample_df):
    with_null = sample_df.withColumn(
        "region", F.when(F.col("region") == "West", F.lit(None)).otherwise(F.col("region")))
    regions = [r.region for r in revenue_by_dimension(with_null, "region").collect()]
    assert None not in regions and len(regions) == 3


def test_monthly_trend(sample_df):
    rows = revenue_profit_trend(sample_df, "ME").collect()
    assert [(r.order_date, r.revenue, r.profit, r.orders) for r in rows] == [
        (dt.date(2025, 4, 30), 406.0, 104.0, 4),
        (dt.date(2025, 5, 31), 634.0, 214.0, 4),
        (dt.date(2025, 6, 30), 648.0, 224.0, 4),
    ]


def test_trend_gap_filled(sample_df):
    no_may = sample_df.where(F.month("order_date") != 5)
    rows = revenue_profit_trend(no_may, "ME").collect()
    assert [r.order_date for r in rows] == [dt.date(2025, 4, 30), dt.date(2025, 5, 31),
                                            dt.date(2025, 6, 30)]
    may = rows[1]
    assert (may.revenue, may.profit, may.orders, may.margin_pct) == (0.0, 0.0, 0, None)
    weeks = revenue_profit_trend(no_may, "W").collect()
    labels = [r.order_date for r in weeks]
    assert all(d.weekday() == 6 for d in labels)  # every label is a Sunday
    assert all((b - a).days == 7 for a, b in zip(labels, labels[1:]))
    assert labels[0] == dt.date(2025, 4, 6)  # Thu 2025-04-03 falls in the week ending Sun 04-06
    days = revenue_profit_trend(sample_df, "D").collect()
    assert len(days) == 84 and sum(r.revenue for r in days) == 1688.0


def test_pareto(sample_df):
    rows = pareto_analysis(sample_df, "product_name", "revenue").collect()
    assert [r.cumulative for r in rows] == [798.0, 1582.0, 1688.0]
    assert [r.cumulative_pct for r in rows] == [47.3, 93.7, 100.0]
    pcts = [r.cumulative_pct for r in rows]
    assert pcts == sorted(pcts) and pcts[-1] == 100.0


def test_pareto_bucketed_equals_plain(spark):
    # many items with heavy ties in the metric: value buckets must split ties
    df = spark.range(0, 3000).select(
        F.format_string("item%05d", F.col("id")).alias("product_name"),
        (F.col("id") % 7).cast("decimal(18,4)").alias("revenue"))
    plain = pareto_analysis(df, buckets=1).collect()
    bucketed = pareto_analysis(df, buckets=9).collect()
    assert plain == bucketed
    assert [r.position for r in bucketed] == list(range(1, 3001))


def test_pareto_top(sample_df):
    top = pareto_top(sample_df, "product_name", "revenue", 2).collect()
    assert [(r.product_name, r.cumulative_pct) for r in top] == [("Trail Boots", 47.3),
                                                                ("Desk Lamp", 93.7)]
