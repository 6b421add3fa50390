from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from salespark.operators.kpi import executive_summary, period_growth


def test_totals(sample_df):
    s = executive_summary(sample_df).first()
    assert s.total_revenue == 1688.0
    assert s.total_profit == 542.0
    assert s.total_orders == 12
    assert s.total_customers == 5


def test_derived_ratios(sample_df):
    s = executive_summary(sample_df).first()
    assert s.average_order_value == 140.67
    assert s.profit_margin_pct == 32.1
    assert s.return_rate_pct == 25.0


def test_half_period_growth(sample_df):
    g = period_growth(sample_df).first()
    # span 83 days, midpoint 2025-05-14 12:00 -> 760 before, 928 from then on
    assert g.first_half_revenue == 760.0
    assert g.second_half_revenue == 928.0
    assert g.revenue_growth_pct == 22.1
    assert executive_summary(sample_df).first().revenue_growth_pct == 22.1


def test_empty_input_does_not_raise(sample_df):
    s = executive_summary(sample_df.where(F.lit(False))).first()
    assert s.total_orders == 0
    assert s.total_revenue == 0.0
    assert s.average_order_value == 0.0
    assert s.return_rate_pct == 0.0
    assert s.revenue_growth_pct is None


def test_single_date_has_no_growth(sample_df):
    one = sample_df.where(F.col("order_date") == dt.date(2025, 4, 3))
    assert executive_summary(one).first().revenue_growth_pct is None


def test_odd_span_midpoint(sample_df):
    # 2026-01-01 .. 2026-01-04 (3 days): midpoint Jan 2 12:00, so Jan 2 is first half
    rows = sample_df.where(F.col("order_id").isin("L01", "L02")).withColumn(
        "order_date", F.when(F.col("order_id") == "L01", F.lit(dt.date(2026, 1, 2)))
        .otherwise(F.lit(dt.date(2026, 1, 4))))
    extra = sample_df.where(F.col("order_id") == "L03").withColumn(
        "order_date", F.lit(dt.date(2026, 1, 1)))
    g = period_growth(rows.unionByName(extra)).first()
    assert g.first_half_revenue == 212.0   # Jan 1 (52) + Jan 2 (160)
    assert g.second_half_revenue == 114.0  # Jan 4


def test_approx_distinct_counts(sample_df):
    s = executive_summary(sample_df, approx=True).first()
    assert s.total_orders == 12 and s.total_customers == 5
