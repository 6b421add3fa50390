from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salespark.operators.charts import forecast_band_polygon
from salespark.operators.forecast import (calendar_features, daily_revenue, forecast_revenue,
                                          forecast_series, forecast_totals)

# Fixed noise column for the 60-day history (our own values, in [-50, 50]).
NOISE = [((i * 37) % 101) - 50 for i in range(60)]


@pytest.fixture(scope="module")
def daily_history(spark):
    start = dt.date(2026, 1, 1)
    rows = [(f"ORD{i:04d}", start + dt.timedelta(days=i),
             Decimal(str(max(100, 1000 + 10 * i + NOISE[i]))).quantize(Decimal("0.0001")))
            for i in range(60)]
    return spark.createDataFrame(rows, "order_id string, order_date date, revenue decimal(18,4)")


def test_forecast_shape_and_ordering(daily_history):
    fc = forecast_revenue(daily_history, horizon_days=14).forecast.collect()
    assert len(fc) == 14
    assert all(r.lower <= r.forecast <= r.upper for r in fc)
    assert all(min(r.lower, r.forecast, r.upper) >= 0 for r in fc)
    # a rising series keeps rising
    assert fc[-1].forecast > fc[0].forecast


def test_forecast_dates_continue_after_history(daily_history):
    res = forecast_revenue(daily_history, horizon_days=7)
    last = res.history.agg(F.max("date")).first()[0]
    dates = [r.date for r in res.forecast.collect()]
    assert dates[0] == last + dt.timedelta(days=1)
    assert dates == [last + dt.timedelta(days=i) for i in range(1, 8)]


def test_forecast_raises_on_too_little_history(spark, daily_history):
    tiny = daily_history.where(F.col("order_date") < dt.date(2026, 1, 6))
    with pytest.raises(ValueError):
        forecast_revenue(tiny, horizon_days=30)


def test_calendar_features_count_observed_days(daily_history):
    gap = daily_history.where(F.col("order_date") != dt.date(2026, 1, 3))
    feats = calendar_features(daily_revenue(gap)).orderBy("date").collect()
    assert [f.day_index for f in feats[:3]] == [0, 1, 2]
    assert feats[2].date == dt.date(2026, 1, 4)
    assert feats[0].day_of_week == 3  # 2026-01-01 is a Thursday
    assert feats[2].is_weekend == 1 and feats[0].is_holiday_season == 0


def test_many_series_at_once(daily_history):
    two = daily_history.withColumn("region", F.lit("A")).unionByName(
        daily_history.withColumn("region", F.lit("B"))
        .withColumn("revenue", F.col("revenue") * 2))
    short = daily_history.where(F.col("order_date") < dt.date(2026, 1, 10)).withColumn(
        "region", F.lit("C"))
    out = forecast_series(two.unionByName(short), ["region"], 5)
    counts = {r.region: r["count"] for r in out.groupBy("region").count().collect()}
    assert counts == {"A": 5, "B": 5, "C": 1}
    c = out.where("region = 'C'").first()  # too little history is said, not left out
    assert (c.status, c.date, c.forecast) == ("short history", None, None)
    assert {r.status for r in out.where("region <> 'C'").collect()} == {"forecast"}
    a = {r.date: r.forecast for r in out.where("region = 'A'").collect()}
    b = {r.date: r.forecast for r in out.where("region = 'B'").collect()}
    assert all(abs(b[d] - 2 * a[d]) < 0.05 for d in a)


def test_totals_and_polygon(daily_history):
    fc = forecast_revenue(daily_history, horizon_days=10).forecast
    tot = forecast_totals(fc).first()
    assert tot.total_lower <= tot.total_forecast <= tot.total_upper
    poly = forecast_band_polygon(fc).collect()
    assert [p.point_idx for p in poly] == list(range(20))
    assert poly[0].date == poly[-1].date and poly[9].date == poly[10].date


def test_gbt_forecast_many_series(daily_history):
    from salespark.operators.forecast import forecast_gbt
    two = daily_history.withColumn("region", F.lit("A")).unionByName(
        daily_history.withColumn("region", F.lit("B")).withColumn("revenue", F.col("revenue") * 3))
    out = forecast_gbt(two, horizon_days=5, keys=["region"], max_iter=10).collect()
    assert sorted({(r.region) for r in out}) == ["A", "B"] and len(out) == 10
    assert all(0 <= r.lower <= r.forecast <= r.upper for r in out)
    single = forecast_gbt(daily_history, horizon_days=3, max_iter=5).collect()
    assert len(single) == 3


def test_null_series_keys_are_left_out(daily_history):
    from salespark.operators.forecast import forecast_gbt
    mixed = daily_history.withColumn("region", F.lit("A")).unionByName(
        daily_history.withColumn("region", F.lit(None).cast("string")))
    for out in (forecast_series(mixed, ["region"], 3), forecast_gbt(mixed, 3, ["region"], max_iter=3)):
        rows = out.collect()
        assert len(rows) == 3 and all(r.region == "A" and r.forecast > 0 for r in rows)


def test_boosted_quantiles_follow_the_calendar():
    """Weekdays of different level and spread: medians near theirs, bands that hold 80 %."""
    import numpy as np
    from salespark.operators.boosting import boosted
    rng = np.random.default_rng(3)
    n = 1400
    day = np.arange(n)
    x = np.stack([day, day % 7, day // 30 % 12], axis=1).astype(float)
    level, spread = 100.0 + 40 * (day % 7 == 5), 5.0 + 10 * (day % 7 == 5)
    y = level + spread * rng.normal(size=n)
    ahead = np.stack([np.arange(n, n + 14), np.arange(n, n + 14) % 7, np.full(14, 3)], axis=1).astype(float)
    fits = {q: boosted(x, y, ahead, q, 200, 3, 0.05) for q in (0.1, 0.5, 0.9)}
    assert 0.78 <= np.mean((y >= fits[0.1][0]) & (y <= fits[0.9][0])) <= 0.84
    saturday = ahead[:, 1] == 5
    assert abs(fits[0.5][1][saturday].mean() - 140) < 6 and abs(fits[0.5][1][~saturday].mean() - 100) < 3
    wide = fits[0.9][1] - fits[0.1][1]
    assert wide[saturday].mean() > 1.5 * wide[~saturday].mean()


def test_pinball_loss_falls_with_every_round():
    import numpy as np
    from salespark.operators.boosting import boosted
    rng = np.random.default_rng(4)
    x = rng.integers(0, 7, (300, 2)).astype(float)
    y = 3 * x[:, 0] + rng.normal(size=300)
    losses = []
    for rounds in (0, 1, 5, 20, 80):
        fitted, _ = boosted(x, y, x[:1], 0.9, rounds, 3, 0.1)
        r = y - fitted
        losses.append(np.where(r > 0, 0.9 * r, -0.1 * r).mean())
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.4 * losses[0]


def test_best_split_is_the_best_of_all():
    import numpy as np
    from salespark.operators import boosting
    rng = np.random.default_rng(5)
    for _ in range(20):
        x, g = rng.integers(0, 6, (40, 3)), rng.normal(size=40)
        best = {}
        for c in range(3):
            for cut in range(5):
                low = x[:, c] <= cut
                if min(low.sum(), (~low).sum()) >= boosting.LEAF_DAYS:
                    best[c, cut] = g[low].sum() ** 2 / low.sum() + g[~low].sum() ** 2 / (~low).sum()
        found = boosting._best_split(x, g, [6, 6, 6])
        assert found is not None and abs(best[found] - max(best.values())) < 1e-9


def test_short_series_are_left_out_of_the_trees(daily_history):
    from salespark.operators.forecast import forecast_gbt
    short = daily_history.where(F.col("order_date") < dt.date(2026, 1, 10)).withColumn("region", F.lit("C"))
    both = daily_history.withColumn("region", F.lit("A")).unionByName(short)
    assert {r.region for r in forecast_gbt(both, 3, ["region"], max_iter=3).collect()} == {"A"}
    assert forecast_gbt(short, 3, max_iter=3).count() == 0
