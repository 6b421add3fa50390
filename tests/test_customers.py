from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from salespark.functions.exprs import quintile_score
from salespark.operators.customers import (churn_counts, churn_risk, compute_rfm,
                                           customer_lifetime_value, customers_to_target,
                                           repeat_customer_rate, rfm_base, segment_counts,
                                           segment_summary, top_customers)
from salespark.operators.ordered import ordered_offsets, release_cached, value_ranges

from .conftest import rows_by

REF = dt.date(2025, 6, 26)


def test_repeat_customer_rate(sample_df):
    assert repeat_customer_rate(sample_df).first().repeat_rate_pct == 60.0
    empty = sample_df.where(F.lit(False))
    assert repeat_customer_rate(empty).first().repeat_rate_pct == 0.0


def test_rfm_golden(sample_df):
    rfm = rows_by(compute_rfm(sample_df, reference_date=REF), "customer_id")
    expect = {
        "K1": (9, 4, 600, 4, 5, 5, "Champions"),
        "K2": (1, 3, 224, 5, 3, 2, "Loyal customers"),
        "K3": (22, 3, 516, 2, 4, 4, "At risk"),
        "K4": (55, 1, 324, 1, 1, 3, "Needs attention"),
        "K5": (16, 1, 24, 3, 2, 1, "Needs attention"),
    }
    for cid, (rec, freq, mon, r, f, m, seg) in expect.items():
        row = rfm[cid]
        assert (row["recency_days"], row["frequency"], float(row["monetary"])) == (rec, freq, mon)
        assert (row["r_score"], row["f_score"], row["m_score"], row["segment"]) == (r, f, m, seg)
        assert row["rfm_score"] == r + f + m


def test_rfm_bucketed_equals_plain(sample_df):
    plain = compute_rfm(sample_df, reference_date=REF).orderBy("customer_id").collect()
    bucketed = compute_rfm(sample_df, reference_date=REF, buckets=3).orderBy("customer_id").collect()
    assert plain == bucketed


def test_segment_tables(sample_df):
    rfm = compute_rfm(sample_df, reference_date=REF)
    counts = {r.segment: r.customers for r in segment_counts(rfm).collect()}
    assert sum(counts.values()) == 5
    summary = rows_by(segment_summary(rfm), "segment")
    assert float(summary["At risk"]["total_monetary"]) == 516.0
    t = customers_to_target(rfm).first()
    assert (t.champions, t.at_risk) == (1, 1)


def test_default_reference_date_is_last_order(sample_df):
    base = rows_by(rfm_base(sample_df), "customer_id")
    assert base["K2"]["recency_days"] == 0  # K2 ordered on the last day


def test_churn_risk(sample_df):
    risk = rows_by(churn_risk(sample_df, reference_date=REF), "customer_id")
    # all but K4 (last on 05-02: 55 days) ordered within 30 days of 2025-06-26
    assert {k: r["churn_risk"] for k, r in risk.items()} == {
        "K1": "Low", "K2": "Low", "K3": "Low", "K4": "Medium", "K5": "Low"}
    assert risk["K4"]["recency_days"] == 55
    later = rows_by(churn_risk(sample_df, reference_date="2025-08-01"), "customer_id")
    assert later["K4"]["recency_days"] == 91 and later["K4"]["churn_risk"] == "High"
    assert later["K5"]["recency_days"] == 52 and later["K5"]["churn_risk"] == "Medium"
    far = rows_by(churn_risk(sample_df, reference_date="2025-12-01"), "customer_id")
    assert far["K1"]["churn_risk"] == "High"
    before = rows_by(churn_risk(sample_df, reference_date="2025-04-01"), "customer_id")
    assert before["K1"]["churn_risk"] is None  # negative recency is outside the bands
    assert {r.churn_risk: r.customers for r in churn_counts(churn_risk(sample_df, REF)).collect()} \
        == {"Low": 4, "Medium": 1}


def test_churn_band_edges(spark):
    df = spark.createDataFrame(
        [(f"X{d}", dt.date(2026, 1, 1) - dt.timedelta(days=d)) for d in (0, 30, 31, 90, 91, 10000, 10001)],
        "customer_id string, order_date date")
    risk = {r.recency_days: r.churn_risk for r in churn_risk(df, "2026-01-01").collect()}
    assert risk == {0: "Low", 30: "Low", 31: "Medium", 90: "Medium", 91: "High", 10000: "High",
                    10001: None}


def test_clv(sample_df):
    rows = customer_lifetime_value(sample_df).orderBy(F.col("lifetime_profit").desc()).collect()
    assert rows[0].customer_id == "K1"
    profits = [r.lifetime_profit for r in rows]
    assert profits == sorted(profits, reverse=True)
    by = {r.customer_id: r for r in rows}
    assert (by["K1"].lifetime_revenue, by["K1"].lifetime_profit, by["K1"].orders,
            by["K1"].avg_order_value) == (600.0, 246.0, 4, 150.0)
    assert by["K3"].avg_order_value == 172.0
    assert by["K2"].avg_order_value == 74.67
    assert [r.customer_id for r in top_customers(sample_df, 2).collect()] == ["K1", "K3"]


def test_quintile_score_is_the_fifth_of_the_place(spark):
    sizes = list(range(2, 260)) + [1000, 1501]
    pairs = spark.createDataFrame([(r, n) for n in sizes for r in range(1, n + 1)],
                                  "r long, n long")
    got = {(x.r, x.n): x.s for x in pairs.select("r", "n", quintile_score("r", "n").alias("s"))
           .collect()}
    for n in sizes:
        # place r of n lies in fifth k when (k-1)(n-1) < 5(r-1) <= k(n-1); the first in fifth 1
        expect = [next(k for k in range(1, 6) if 5 * (r - 1) <= k * (n - 1)) for r in range(1, n + 1)]
        assert [got[(r, n)] for r in range(1, n + 1)] == expect, n


def test_single_customer_scores(sample_df):
    one = compute_rfm(sample_df.where(F.col("customer_id") == "K1"), reference_date=REF).first()
    assert (one.r_score, one.f_score, one.m_score) == (5, 1, 1)


def test_ordered_offsets_bucketed_equals_plain(spark):
    df = spark.range(0, 5000).select(
        F.col("id").alias("k"), (F.col("id") * 7919 % 13).alias("metric"),
        (F.col("id") % 5).cast("decimal(10,2)").alias("amount"))
    keys = [("metric", False), ("k", True)]
    plain = ordered_offsets(df, keys, sums={"run": "amount"}, buckets=1).orderBy("rank").collect()
    split = ordered_offsets(df, keys, sums={"run": "amount"}, buckets=7).orderBy("rank").collect()
    assert plain == split
    assert [r["rank"] for r in split] == list(range(1, 5001))


def test_heavy_ties_split_into_balanced_ranges(spark):
    """Five million rows of one value: no range holds more than twice the mean, and
    positions and running sums are those of a plain count."""
    n, k = 5_000_000, 10
    df = spark.range(n).select(F.col("id").alias("customer_id"), F.lit(1).alias("frequency"),
                               (F.col("id") % 10).alias("amount"))
    keys = [("frequency", True), ("customer_id", True)]
    sizes = [r["count"] for r in value_ranges(df, keys, [], k).groupBy("__part").count().collect()]
    assert len(sizes) == k and sum(sizes) == n
    assert max(sizes) <= 2 * n / k
    out = ordered_offsets(df, keys, sums={"run": "amount"})
    i = F.col("customer_id")
    wrong = out.where((F.col("rank") != i + 1)
                      | (F.col("run") != F.floor(i / 10) * 45 + (i % 10) * (i % 10 + 1) / 2) | (F.col("n") != n))
    assert wrong.count() == 0
    release_cached()


def test_positions_within_groups(spark):
    """Groups of very different size in one pass; a group over many ranges and many in one."""
    df = spark.range(0, 6000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.lit("a")).otherwise(
            F.concat(F.lit("g"), (F.col("id") % 30).cast("string"))).alias("grp"),
        (F.col("id") * 7919 % 13).alias("metric"))
    got = ordered_offsets(df, [("metric", False), ("k", True)], sums={"run": "metric"}, buckets=9, by=["grp"]).collect()
    want, place, run = {}, {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.grp, -r.metric, r.k)):
        place[r.grp] = place.get(r.grp, 0) + 1
        run[r.grp] = run.get(r.grp, 0) + r.metric
        want[r.k] = (place[r.grp], run[r.grp])
    assert {r.k: (r["rank"], r.run) for r in got} == want
    release_cached()


def test_offsets_over_many_ranges(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("m"))
    got = ordered_offsets(df, [("k", True)], sums={"run": "m"}, buckets=20).orderBy("k").collect()
    assert [r["rank"] for r in got] == list(range(1, 2001))
    assert [r.run for r in got] == np.cumsum([i % 7 for i in range(2000)]).tolist()


def test_what_an_owner_keeps_is_dropped_with_it(spark):
    import os
    from salespark.operators.ordered import Kept, keeping, written
    other, own = Kept(), Kept()
    with keeping(other):
        kept = ordered_offsets(spark.range(100), [("id", True)])
    with keeping(own):
        written(spark.range(5), "gone")
    (_, path), = own.folders
    own.close()
    assert not os.path.exists(path.removeprefix("file:"))
    assert kept.count() == 100
    other.close()
