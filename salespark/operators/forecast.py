"""Daily revenue forecasts with a 10 / 50 / 90 % band, for one or many series.

The default model is a closed form that is exact, cheap and runs for any number of series at
once: a least-squares linear trend on the observed-day index
(``regr_slope`` / ``regr_intercept``) plus the 10th / 50th / 90th
percentiles of the trend residuals of the same weekday (and same holiday
season when that cell has at least 5 days; weekday alone, then all days, as
fallbacks).  ``forecast_gbt`` fits gradient-boosted trees on the quantile loss.

Every step is a grouped aggregate or a join keyed by series, so many series
(one per region, category, product...) forecast in one job; no driver loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import dround
from .ordered import cache

MIN_HISTORY_DAYS = 30
MIN_CELL_DAYS = 5
# Months flagged as holiday season (November, December) and the
# band quantiles (lower, forecast, upper).
HOLIDAY_MONTHS = (11, 12)
BAND = (0.1, 0.5, 0.9)


@dataclass(frozen=True)
class ForecastResult:
    history: DataFrame   # date, revenue
    forecast: DataFrame  # date, forecast, lower, upper


def daily_revenue(fact: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Revenue per observed day (and series key); days without sales are absent."""
    keys = keys or []
    return (fact.where(F.col("order_date").isNotNull()
                       & F.col("revenue").isNotNull())
            .groupBy(*keys, F.col("order_date").alias("date"))
            .agg(F.round(F.sum("revenue"), 2).cast("double").alias("revenue")))


def _features(date: Column) -> dict[str, Column]:
    dow = F.weekday(date)
    month = F.month(date)
    return {
        "day_of_week": dow,
        "month": month,
        "is_weekend": (dow >= 5).cast("int"),
        "is_holiday_season": month.isin(*HOLIDAY_MONTHS).cast("int"),
    }


def calendar_features(daily: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Model features per observed day: position among observed days
    (``day_index``, 0-based, per series), weekday (Mon = 0), month, weekend
    and holiday-season flags.  The window is partitioned by series; one
    series has one row per calendar day at most."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy("date") if keys else Window.orderBy("date")
    out = daily.withColumn("day_index", (F.row_number().over(w) - 1).cast("int"))
    return out.withColumns(_features(F.col("date")))


def _residual_quantiles(resid: DataFrame, by: list[str], prefix: str) -> DataFrame:
    qs = F.percentile(F.col("resid"), F.array(*[F.lit(p) for p in BAND]))
    return resid.groupBy(*by).agg(qs.alias("__q"), F.count(F.lit(1)).alias(prefix + "n")) \
        .select(*by, prefix + "n", *[F.col("__q")[i].alias(f"{prefix}q{i}") for i in range(3)])


def _attach(df: DataFrame, per_series: DataFrame, keys: list[str], cols: list[str],
            how: str) -> DataFrame:
    """Attach per-series columns: a join on the series keys, or for a single
    series (no keys) one struct-valued scalar subquery over its one row (no join)."""
    if keys:
        return df.join(per_series.select(*keys, *cols), keys, how)
    row = per_series.select(F.struct(*cols).alias("s")).scalar()
    return df.withColumns({c: row.getField(c) for c in cols})


def _with_band(future: DataFrame, resid: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the residual quantiles ``__q0..__q2`` for each future day: those
    of its weekday x holiday-season cell when that cell has at least
    ``MIN_CELL_DAYS`` days, else of its weekday, else of all days."""
    cell = _residual_quantiles(resid, keys + ["day_of_week", "is_holiday_season"], "c_")
    wday = _residual_quantiles(resid, keys + ["day_of_week"], "w_")
    glob = _residual_quantiles(resid, keys, "g_")
    joined = (future.join(cell, keys + ["day_of_week", "is_holiday_season"], "left")
              .join(wday, keys + ["day_of_week"], "left"))
    joined = _attach(joined, glob, keys, ["g_n", "g_q0", "g_q1", "g_q2"], "left")
    use_cell = F.coalesce(F.col("c_n"), F.lit(0)) >= MIN_CELL_DAYS
    use_wday = F.coalesce(F.col("w_n"), F.lit(0)) >= MIN_CELL_DAYS
    return joined.withColumns({
        f"__q{i}": F.when(use_cell, F.col(f"c_q{i}")).when(use_wday, F.col(f"w_q{i}"))
        .otherwise(F.col(f"g_q{i}")) for i in range(3)})


def _fit_and_project(hist: DataFrame, keys: list[str], horizon_days: int,
                     min_history: int) -> DataFrame:
    trend = hist.groupBy(*keys).agg(
        F.regr_slope("revenue", "day_index").alias("slope"),
        F.regr_intercept("revenue", "day_index").alias("intercept"),
        F.count(F.lit(1)).alias("n_days"), F.max("date").alias("last_date"))
    trend = trend.where(F.col("n_days") >= min_history)
    fitted = F.col("intercept") + F.col("slope") * F.col("day_index")
    with_fit = _attach(hist, trend, keys, ["slope", "intercept", "n_days"], "inner") \
        .where(F.col("n_days").isNotNull())
    resid = with_fit.withColumn("resid", F.col("revenue") - fitted)

    step = F.explode(F.sequence(F.lit(1), F.lit(horizon_days))).alias("step")
    future = trend.select(*keys, "slope", "intercept", "n_days", "last_date", step)
    future = future.select(
        *keys, "slope", "intercept",
        F.date_add("last_date", F.col("step")).alias("date"),
        (F.col("n_days") - 1 + F.col("step")).cast("int").alias("day_index"))
    future = future.withColumns(_features(F.col("date")))
    joined = _with_band(future, resid, keys)
    base = F.col("intercept") + F.col("slope") * F.col("day_index")
    return joined.select(*keys, "date", "day_index", "day_of_week", "is_holiday_season",
                         *[F.greatest(F.lit(0.0), base + F.col(f"__q{i}")).alias(f"__v{i}")
                           for i in range(3)])


def _finish(raw: DataFrame, keys: list[str]) -> DataFrame:
    vals = [F.col(f"__v{i}") for i in range(3)]
    lo, hi = F.least(*vals), F.greatest(*vals)
    mid = F.greatest(F.least(vals[0], vals[1]), F.least(F.greatest(vals[0], vals[1]), vals[2]))
    return raw.select(*keys, "date", dround(mid, 2).alias("forecast"),
                      dround(lo, 2).alias("lower"), dround(hi, 2).alias("upper"))


def forecast_series(fact: DataFrame, keys: list[str], horizon_days: int = 30,
                    min_history: int = MIN_HISTORY_DAYS) -> DataFrame:
    """Forecast every series named by ``keys`` ``horizon_days`` past its last
    observed day.  Values are clipped at 0 and ordered lower <= forecast <= upper.

    Rows with a NULL key belong to no series and are left out.  With ``keys`` a
    column ``status`` is added; a series with fewer than ``min_history`` observed
    days has one row with status ``short history`` and no date or values.
    """
    if horizon_days < 1:
        raise ValueError("horizon_days must be positive")
    keys = list(keys)
    hist = calendar_features(daily_revenue(fact.dropna(subset=keys) if keys else fact, keys), keys)
    out = _finish(_fit_and_project(hist, keys, horizon_days, min_history), keys)
    if not keys:
        return out
    short = (hist.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
             .where(F.col("__n") < min_history).select(*keys))
    return out.withColumn("status", F.lit("forecast")).unionByName(
        short.withColumn("status", F.lit("short history")), allowMissingColumns=True)


def forecast_revenue(fact: DataFrame, horizon_days: int = 30) -> ForecastResult:
    """Single-series forecast of total daily revenue.

    Raises ``ValueError`` with fewer than 30 observed days (a bounded count:
    one row per day).
    """
    daily = daily_revenue(fact)
    if daily.count() < MIN_HISTORY_DAYS:
        raise ValueError(f"Need at least {MIN_HISTORY_DAYS} days of history to fit a forecast")
    # ``horizon_days`` rows, read by the chart, the band outline and the totals
    forecast = cache(forecast_series(fact, [], horizon_days))
    return ForecastResult(history=daily.orderBy("date"), forecast=forecast.orderBy("date"))


def forecast_totals(forecast: DataFrame) -> DataFrame:
    """One row: summed forecast, lower and upper over the horizon."""
    return forecast.agg(dround(F.sum("forecast"), 2).alias("total_forecast"),
                        dround(F.sum("lower"), 2).alias("total_lower"),
                        dround(F.sum("upper"), 2).alias("total_upper"))


FEATURES = ["day_index", "day_of_week", "month", "is_weekend", "is_holiday_season"]


def gbt_fit(fact: DataFrame, horizon_days: int = 30, keys: list[str] | None = None, rounds: int = 200,
            depth: int = 3, rate: float = 0.05) -> DataFrame:
    """Per series and day, history and ``horizon_days`` after it: the quantiles ``BAND``
    by boosted trees on the pinball loss (``operators.boosting``).

    Columns: keys, date, revenue (NULL in the future), ``__v0`` to ``__v2``.  Spark
    sums the fact to days, deals the series out and fits each where it lies; a
    series has a row a calendar day at most, so a task's memory is bounded by the
    calendar.  Rows with a NULL key belong to no series and are left out, and so
    are series with fewer than ``MIN_HISTORY_DAYS`` days.
    """
    from ..plans.session import ship_package

    ship_package(fact.sparkSession)
    keys = keys or []
    hist = calendar_features(daily_revenue(fact.dropna(subset=keys) if keys else fact, keys), keys)
    last = hist.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max("date").alias("__last"))
    last = last.where(F.col("__n") >= MIN_HISTORY_DAYS)
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon_days))).alias("step")
    future = last.select(*keys, "__n", "__last", steps).select(
        *keys, F.date_add("__last", F.col("step")).alias("date"),
        (F.col("__n") - 1 + F.col("step")).cast("int").alias("day_index"))
    future = future.withColumns(_features(F.col("date")))
    rows = hist.unionByName(future.withColumn("revenue", F.lit(None).cast("double")))
    schema = T.StructType([*(rows.schema[k] for k in keys), rows.schema["date"], rows.schema["revenue"],
                           *(T.StructField(f"__v{i}", T.DoubleType()) for i in range(len(BAND)))])

    def fit(series):
        from salespark.operators.boosting import boosted

        series = series.sort_values("date")
        known = series["revenue"].notna().to_numpy()
        x, y = series[FEATURES].to_numpy(float), series["revenue"].to_numpy(float)
        if known.sum() < MIN_HISTORY_DAYS:
            return series.head(0).reindex(columns=schema.names)
        for i, q in enumerate(BAND):
            fitted, told = boosted(x[known], y[known], x[~known], q, rounds, depth, rate)
            values = y.copy()
            values[known], values[~known] = fitted, told
            series[f"__v{i}"] = values
        return series[schema.names]

    if keys:
        return rows.groupBy(*keys).applyInPandas(fit, schema)
    return rows.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(fit, schema)


def forecast_gbt(fact: DataFrame, horizon_days: int = 30, keys: list[str] | None = None,
                 max_iter: int = 200, max_depth: int = 3, step_size: float = 0.05) -> DataFrame:
    """Forecast with gradient-boosted trees on the quantile loss, one model for each of
    the band's quantiles (see ``gbt_fit``); clipped at 0 and lower <= forecast <= upper."""
    fitted = gbt_fit(fact, horizon_days, keys, max_iter, max_depth, step_size).where(F.col("revenue").isNull())
    raw = fitted.withColumns({f"__v{i}": F.greatest(F.lit(0.0), F.col(f"__v{i}")) for i in range(len(BAND))})
    return _finish(raw, keys or [])


def gbt_quality(fitted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per series of ``gbt_fit``: history days, mean absolute error of the fitted median
    and of a constant (the history's median), and the share of days within the band."""
    keys = keys or []
    past = fitted.where(F.col("revenue").isNotNull())
    median = past.groupBy(*keys).agg(F.median("revenue").alias("__median"))
    both = _attach(past, median, keys, ["__median"], "inner")
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("history_days"), F.avg(F.abs(F.col("revenue") - F.col("__v1"))).alias("error"),
        F.avg(F.abs(F.col("revenue") - F.col("__median"))).alias("constant_error"),
        F.avg(F.col("revenue").between(F.col("__v0"), F.col("__v2")).cast("int")).alias("covered"))
