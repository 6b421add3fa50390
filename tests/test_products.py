from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from salespark.operators.products import (category_contribution, category_rollup,
                                          discount_impact, inventory_counts,
                                          inventory_recommendation, product_performance,
                                          product_quantiles, repricing_candidates, top_products,
                                          unprofitable_products, worst_products)
from salespark.operators.rollups import (monthly_rollup, region_rollup, return_rate_by_category,
                                         top_products_rollup)
from salespark.operators.ordered import exact_quantiles

from .conftest import rows_by


def test_product_performance_golden(sample_df):
    perf = product_performance(sample_df)
    rows = rows_by(perf, "product_id")
    assert len(rows) == 3
    cols = ("revenue", "profit", "units_sold", "orders", "avg_rating", "return_rate_pct",
            "margin_pct")
    assert tuple(rows["A7"][c] for c in cols) == (784.0, 304.0, 10, 5, 4.6, 0.0, 38.8)
    assert tuple(rows["B2"][c] for c in cols) == (798.0, 308.0, 7, 4, 4.0, 25.0, 38.6)
    assert tuple(rows["C9"][c] for c in cols) == (106.0, -70.0, 4, 3, 2.33, 66.7, -66.0)


def test_top_and_worst(sample_df):
    assert [r.product_id for r in top_products(sample_df, 2).collect()] == ["B2", "A7"]
    assert [r.product_id for r in worst_products(sample_df, 1).collect()] == ["C9"]
    assert [r.product_id for r in top_products(sample_df, 1, "margin_pct").collect()] == ["A7"]


def test_discount_bands(sample_df):
    rows = discount_impact(sample_df).collect()
    assert [(r.discount_band, r.revenue, r.profit, r.orders, r.margin_pct) for r in rows] == [
        ("0-10%", 1582.0, 612.0, 9, 38.7),
        ("20-30%", 30.0, -14.0, 1, -46.7),
        ("30-100%", 76.0, -56.0, 2, -73.7),
    ]
    non_null = [r for r in rows if r.margin_pct is not None]
    assert non_null[-1].margin_pct < non_null[0].margin_pct


def test_discount_band_edges(spark):
    df = spark.createDataFrame([(f"O{i}", d) for i, d in enumerate(
        ["0.00", "0.10", "0.11", "0.20", "1.00", "1.01", "-0.01"])],
        "order_id string, discount string").select(
        "order_id", F.col("discount").cast("decimal(4,2)").alias("discount"),
        F.lit(1).cast("decimal(18,4)").alias("revenue"), F.lit(0).cast("decimal(18,4)").alias("profit"))
    got = {r.discount_band: r.orders for r in discount_impact(df).collect()}
    # right-closed, lowest band includes 0, outside [0, 1] dropped
    assert got == {"0-10%": 2, "10-20%": 2, "30-100%": 1}
    labels = [r.discount_band for r in discount_impact(df, [0, 0.07, 0.29, 1.0]).collect()]
    assert labels == ["0-7%", "7-28%", "28-100%"]


def test_quantiles_and_inventory(sample_df):
    q = product_quantiles(product_performance(sample_df)).first()
    assert round(q.units_q33, 6) == 5.98 and round(q.units_q66, 6) == 7.96
    assert round(q.margin_q33, 6) == 3.036 and round(q.margin_q66, 6) == 38.664
    inv = rows_by(inventory_recommendation(sample_df), "product_id")
    assert {k: v["recommendation"] for k, v in inv.items()} == {
        "A7": "Restock", "B2": "Hold", "C9": "Discontinue"}
    counts = {r.recommendation: r.products
              for r in inventory_counts(inventory_recommendation(sample_df)).collect()}
    assert counts == {"Restock": 1, "Hold": 1, "Discontinue": 1}


def test_exact_quantiles_bucketed(spark):
    df = spark.range(0, 4001).select((F.col("id") * 37 % 4001).alias("v"), F.col("id").alias("k"))
    a = exact_quantiles(df, "v", [0.0, 0.33, 0.5, 0.75, 1.0]).first()
    b = exact_quantiles(df, "v", [0.0, 0.33, 0.5, 0.75, 1.0], buckets=5).first()
    assert tuple(a) == tuple(b) == (0.0, 1320.0, 2000.0, 3000.0, 4000.0)
    empty = exact_quantiles(df.where(F.lit(False)), "v", [0.5]).first()
    assert empty[0] is None


def test_quantiles_of_heavy_ties(spark):
    """Two thirds equal values: one row after counting, so no bucket is hot."""
    df = spark.range(0, 30_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 997).otherwise(500).alias("v"))
    probs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    want = np.quantile([r.v for r in df.collect()], probs)
    for buckets in (None, 7):
        assert list(exact_quantiles(df, "v", probs, buckets=buckets).first()) == pytest.approx(list(want))


def test_near_ties_use_unrounded_sums(spark):
    """Margins of 30.04 and 30.01 % read 30.0 both; the thinner one is named.  A loss
    below half a cent is a loss."""
    rows = [("P1", "A", "10000.0000", "3004.0000"), ("P2", "Z", "10000.0000", "3001.0000"),
            ("P3", "Z", "1.0000", "-0.0040")]
    df = spark.createDataFrame(rows, "product_id string, category string, r string, p string").select(
        "product_id", F.col("product_id").alias("product_name"), "category", F.lit("s").alias("sub_category"),
        F.col("r").cast("decimal(18,4)").alias("revenue"), F.col("p").cast("decimal(18,4)").alias("profit"),
        F.lit(1).alias("quantity"), F.col("product_id").alias("order_id"), F.lit(5).alias("rating"),
        F.lit("No").alias("returned"), F.lit("0.00").cast("decimal(4,2)").alias("discount"))
    from salespark.operators.insights import category_margin, profit_drivers
    assert [r.category for r in category_margin(df).collect()] == ["Z", "A"]
    drivers = {r.driver: r.subject for r in profit_drivers(df).collect()}
    assert drivers["thinnest_category"] == "Z"
    assert unprofitable_products(df).first().unprofitable_products == 1


def test_repricing_and_unprofitable(sample_df):
    assert repricing_candidates(sample_df).count() == 0
    assert unprofitable_products(sample_df).first().unprofitable_products == 1


def test_category_tables(sample_df):
    cat = {(r.category, r.sub_category): r for r in category_contribution(sample_df).collect()}
    assert cat[("Home", "General")].margin_pct == 26.3
    roll = category_rollup(sample_df).collect()
    levels = sorted((r.level, r.category, r.sub_category) for r in roll)
    assert levels == [(0, "Home", "General"), (0, "Outdoor", "General"),
                      (1, "Home", None), (1, "Outdoor", None)]
    parent = [r for r in roll if r.level == 1 and r.category == "Home"][0]
    assert (parent.revenue, parent.profit, parent.margin_pct) == (890.0, 234.0, 26.3)


def test_sql_rollups(sample_df):
    reg = rows_by(region_rollup(sample_df), "region")
    assert (reg["North"]["revenue"], reg["North"]["orders"]) == (1116.0, 7)
    top = top_products_rollup(sample_df, 2, "profit").collect()
    assert [r.product_name for r in top] == ["Trail Boots", "Desk Lamp"]
    months = monthly_rollup(sample_df).collect()
    assert [(m.month, m.revenue, m.orders) for m in months] == [
        ("2025-04", 406.0, 4), ("2025-05", 634.0, 4), ("2025-06", 648.0, 4)]
    rr = rows_by(return_rate_by_category(sample_df), "category")
    assert rr["Home"]["return_rate_pct"] == 25.0 and rr["Outdoor"]["return_rate_pct"] == 25.0
    try:
        top_products_rollup(sample_df, 2, "units")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass
