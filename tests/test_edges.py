"""Edge frames: empty input, one row, zero revenue, NULL flags (FIXTURES F-F)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salespark.operators import (charts, customers, forecast, insights, kpi, products, rollups,
                                 trends)
from salespark.operators.ordered import release_cached

OPERATORS = {
    "summary": kpi.executive_summary,
    "growth": kpi.period_growth,
    "trend_d": lambda f: trends.revenue_profit_trend(f, "D"),
    "trend_w": lambda f: trends.revenue_profit_trend(f, "W"),
    "trend_me": lambda f: trends.revenue_profit_trend(f, "ME"),
    "by_region": lambda f: trends.revenue_by_dimension(f, "region"),
    "pareto": trends.pareto_analysis,
    "pareto_top": trends.pareto_top,
    "perf": products.product_performance,
    "top": products.top_products,
    "category": products.category_contribution,
    "rollup": products.category_rollup,
    "discount": products.discount_impact,
    "inventory": products.inventory_recommendation,
    "repricing": products.repricing_candidates,
    "unprofitable": products.unprofitable_products,
    "rfm": customers.compute_rfm,
    "churn": customers.churn_risk,
    "clv": customers.customer_lifetime_value,
    "repeat": customers.repeat_customer_rate,
    "region_rollup": rollups.region_rollup,
    "monthly": rollups.monthly_rollup,
    "returns": rollups.return_rate_by_category,
    "heatmap": charts.weekday_month_heatmap,
    "histogram": charts.order_value_histogram,
    "box": charts.delivery_box_stats,
    "scatter": charts.scatter_sample,
    "daily": forecast.daily_revenue,
    "region_growth": insights.region_growth,
    "drivers": insights.profit_drivers,
    "insights": insights.summary_insights,
    "recommendations": insights.recommendations,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_and_single_row_inputs(sample_df, name):
    empty = sample_df.where(F.lit(False))
    one = sample_df.where(F.col("order_id") == "L01")
    OPERATORS[name](empty).collect()
    rows = OPERATORS[name](one).collect()
    assert rows is not None
    release_cached()


def test_empty_results(sample_df):
    empty = sample_df.where(F.lit(False))
    assert trends.revenue_profit_trend(empty).count() == 0
    assert customers.compute_rfm(empty).count() == 0
    assert insights.summary_insights(empty).select("kind").collect()[-1].kind == "order_value"
    with pytest.raises(ValueError):
        forecast.forecast_revenue(empty)


def test_zero_revenue_and_null_flags(spark, sample_df):
    zero = sample_df.withColumn("revenue", F.when(F.col("product_id") == "C9", F.lit(0))
                                .otherwise(F.col("revenue")).cast("decimal(18,4)"))
    perf = {r.product_id: r for r in products.product_performance(zero).collect()}
    assert perf["C9"].revenue == 0.0 and perf["C9"].margin_pct is None
    inv = {r.product_id: r.recommendation for r in products.inventory_recommendation(zero).collect()}
    assert set(inv.values()) <= {"Restock", "Hold", "Discontinue"}
    nulls = sample_df.withColumn("returned", F.lit(None).cast("string"))
    s = kpi.executive_summary(nulls).first()
    assert s.return_rate_pct == 0.0  # NULL counts as not returned, denominator all rows
    trend = trends.revenue_profit_trend(zero.where(F.col("product_id") == "C9"), "ME").collect()
    assert all(t.margin_pct is None for t in trend)


def test_even_span_midpoint(spark, sample_df):
    # 2026-01-01 .. 2026-01-05 (4 days): midpoint Jan 3 00:00, Jan 3 belongs to the second half
    rows = sample_df.where(F.col("order_id").isin("L01", "L02", "L03")).withColumn(
        "order_date", F.when(F.col("order_id") == "L03", F.lit(dt.date(2026, 1, 3)))
        .when(F.col("order_id") == "L02", F.lit(dt.date(2026, 1, 5)))
        .otherwise(F.lit(dt.date(2026, 1, 1))))
    g = kpi.period_growth(rows).first()
    assert (g.first_half_revenue, g.second_half_revenue) == (160.0, 166.0)
