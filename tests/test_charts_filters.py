from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from salespark.operators import charts, filters
from salespark.operators.trends import revenue_by_dimension


def test_heatmap(sample_df):
    cells = charts.weekday_month_heatmap(sample_df).collect()
    weekdays = sorted({c.weekday_idx for c in cells})
    months = sorted({c.month for c in cells})
    assert len(cells) == len(weekdays) * len(months)  # full grid, zero-filled
    assert sum(c.orders for c in cells) == 12
    mondays = [c for c in cells if c.month == "2025-04" and c.weekday == "Monday"][0]
    assert mondays.orders == 2  # 04-14 and 04-21 are Mondays
    wide = charts.heatmap_wide(charts.weekday_month_heatmap(sample_df))
    assert wide.columns[:2] == ["weekday_idx", "weekday"] and len(wide.columns) == 2 + len(months)


def test_histogram(sample_df):
    bins = charts.order_value_histogram(sample_df).collect()
    assert sum(b.lines for b in bins) == 12
    assert bins[0].bin_idx == 0 and bins[0].bin_start == 24.0
    assert bins[-1].bin_idx == 59 and bins[-1].bin_end == 324.0  # the max is in the last bin
    one = charts.order_value_histogram(sample_df.where("order_id = 'L01'")).collect()
    assert [(b.bin_idx, b.lines) for b in one] == [(0, 1)]


def test_box_stats(spark):
    df = spark.createDataFrame([("A", v) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]] + [("B", 5)],
                               "category string, delivery_time int")
    s = {r.category: r for r in charts.delivery_box_stats(df).collect()}
    a = s["A"]
    assert (a.q1, a.median, a.q3) == (3.25, 5.5, 7.75)
    assert (a.lower_whisker, a.upper_whisker, a.outliers) == (1, 9, 1)
    assert s["B"].n == 1 and s["B"].outliers == 0


def test_scatter_sample_is_bounded_and_stable(sample_df):
    a = charts.scatter_sample(sample_df, 5).collect()
    b = charts.scatter_sample(sample_df.repartition(3), 5).collect()
    assert len(a) == 5 and sorted(a) == sorted(b)
    assert charts.scatter_sample(sample_df, 100).count() == 12


def test_state_map(sample_df):
    rows = charts.state_map_table(revenue_by_dimension(sample_df, "state")).collect()
    assert [(r.state, r.state_abbr) for r in rows] == [("Oregon", "OR")]


def test_filters(sample_df):
    assert filters.filter_date_range(sample_df, "2025-04-08", "2025-05-02").count() == 4
    assert filters.filter_multi_select(sample_df, {"region": ["North"], "category": []}).count() == 7
    assert filters.filter_multi_select(sample_df, {"region": []}).count() == 12
    assert filters.filter_customer_search(sample_df, "^a").count() == 4
    assert filters.filter_customer_search(sample_df, "A.", literal=True).count() == 0
    f = filters.Filters(start="2025-05-01", end=None, selections={"region": ["North", "East"]},
                        customer_search="c")
    assert filters.apply_filters(sample_df, f).count() == 2  # Cleo Ruiz x2 from May on
    m = filters.filter_match_count(sample_df, f).first()
    assert (m.matched_rows, m.total_rows, m.min_date, m.max_date) == (
        2, 12, dt.date(2025, 4, 3), dt.date(2025, 6, 25))
    opts = filters.filter_options(sample_df).collect()
    assert [o.value for o in opts if o.field == "region"] == ["Central", "East", "North", "West"]
    assert filters.sold(sample_df).count() == 12 and filters.loss_making(sample_df).count() == 3
    nulls = sample_df.withColumn("customer_name", F.lit(None).cast("string"))
    assert filters.filter_customer_search(nulls, "a").count() == 0


def test_filters_accept_date_objects(sample_df):
    import pandas as pd
    a = filters.filter_date_range(sample_df, dt.date(2025, 4, 8), dt.date(2025, 5, 2)).count()
    b = filters.filter_date_range(sample_df, pd.Timestamp("2025-04-08"),
                                  dt.datetime(2025, 5, 2)).count()
    assert a == b == 4
    with_month = sample_df.withColumn("order_month", F.date_format("order_date", "yyyy-MM"))
    assert filters.filter_date_range(with_month, pd.Timestamp("2025-04-08"),
                                     dt.datetime(2025, 5, 2)).count() == 4


def test_bounds_need_no_padding(sample_df):
    """Valid dates without leading zeros give the same rows with and without month partitions."""
    with_month = sample_df.withColumn("order_month", F.date_format("order_date", "yyyy-MM"))
    for frame in (sample_df, with_month):
        assert filters.filter_date_range(frame, "2025-4-8", "2025-5-2").count() == 4


def test_box_stats_of_many_distinct_values(spark):
    """A group of two million distinct values lies in many ranges; small groups and ties beside it."""
    from salespark.operators.ordered import ROWS_PER_BUCKET, release_cached
    n = 2_000_000
    assert n > 2 * ROWS_PER_BUCKET
    big = spark.range(n).select(F.lit("big").alias("category"), (F.col("id") * 7919 % n).alias("v"))
    small = spark.range(10).select(F.lit("small").alias("category"), (F.col("id") * F.col("id")).alias("v"))
    tied = spark.range(1000).select(F.lit("tied").alias("category"), F.lit(5).cast("long").alias("v"))
    got = {r.category: r for r in charts.delivery_box_stats(big.unionByName(small).unionByName(tied), "v").collect()}
    assert (got["big"].q1, got["big"].median, got["big"].q3) == ((n - 1) / 4, (n - 1) / 2, (n - 1) * 0.75)
    assert (got["big"].n, got["big"].min_value, got["big"].max_value, got["big"].outliers) == (n, 0, n - 1, 0)
    assert (got["small"].q1, got["small"].median, got["small"].q3) == (5.25, 20.5, 45.75)
    assert (got["tied"].q1, got["tied"].q3, got["tied"].n, got["tied"].outliers) == (5.0, 5.0, 1000, 0)
    release_cached()
