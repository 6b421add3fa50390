"""Tables behind the dashboard charts (the drawing itself is not built).

Each function returns the exact rows a chart plots: heatmap cells, histogram
bins, box-plot statistics, choropleth rows, a bounded scatter sample and the
forecast band outline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dround
from .ordered import cache, grouped_quantiles


# Full US state names and their two-letter postal codes
# (alphabetical by name), for the choropleth.
US_STATE_CODES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA",
    "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "Florida": "FL", "Georgia": "GA",
    "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA",
    "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD",
    "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS",
    "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH",
    "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC",
    "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA",
    "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN",
    "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA",
    "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}

# Weekday names Monday..Sunday (index 0..6, as ``weekday()``).
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

HISTOGRAM_BINS = 60


def state_map_table(by_state: DataFrame, state_col: str = "state",
                    codes: dict[str, str] | None = None) -> DataFrame:
    """Rows of a revenue-by-state table with a two-letter code; unmapped rows drop.

    The lookup is a literal map expression (no join, no shuffle).
    """
    codes = codes or US_STATE_CODES
    lookup = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return by_state.withColumn("state_abbr", F.element_at(lookup, F.col(state_col))) \
        .where(F.col("state_abbr").isNotNull())


def weekday_month_heatmap(fact: DataFrame) -> DataFrame:
    """Distinct orders per (weekday, month) in long form, zero-filled.

    The grid is every month present × every weekday present, as a pivot with
    fill value 0 would show it.  Weekdays present (at most 7) are gathered by
    a scalar subquery and exploded per month, so the grid has no join of
    unbounded inputs.
    """
    dated = fact.where(F.col("order_date").isNotNull()).select(
        F.weekday("order_date").alias("weekday_idx"),
        F.date_format("order_date", "yyyy-MM").alias("month"), "order_id")
    counts = cache(dated.groupBy("weekday_idx", "month").agg(
        F.count_distinct("order_id").alias("orders")))
    present_days = counts.agg(F.array_sort(F.collect_set("weekday_idx"))).scalar()
    grid = counts.select("month").distinct().select(
        "month", F.explode(present_days).alias("weekday_idx"))
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return (grid.join(counts, ["weekday_idx", "month"], "left")
            .select(F.col("weekday_idx").cast("int").alias("weekday_idx"),
                    F.element_at(names, F.col("weekday_idx") + 1).alias("weekday"),
                    "month", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"))
            .orderBy("weekday_idx", "month"))


def heatmap_wide(heatmap: DataFrame) -> DataFrame:
    """The heatmap as a weekday × month matrix (one column per month)."""
    return (heatmap.groupBy("weekday_idx", "weekday").pivot("month").agg(F.first("orders"))
            .orderBy("weekday_idx"))


def order_value_histogram(fact: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts of order-line revenue in ``bins`` equal-width bins over [min, max].

    The bin index is computed in exact integer units of 1e-4 (revenue has 4
    decimals): ``(v - min) * bins div (max - min)``, the maximum falling in
    the last bin.  Empty bins are absent.
    """
    v = (F.col("revenue") * 10000).cast("long")
    vals = fact.where(F.col("revenue").isNotNull()).select(v.alias("__v"))
    bounds = vals.agg(F.struct(F.min("__v").alias("lo"), F.max("__v").alias("hi"))).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    width = hi - lo
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("__v") - lo) * bins / width).cast("int")))
    g = vals.groupBy(idx.alias("bin_idx")).agg(F.count(F.lit(1)).alias("lines"))
    lo_d = lo.cast("double") / 10000
    width_d = width.cast("double") / 10000
    return g.select(
        F.col("bin_idx").cast("int").alias("bin_idx"),
        dround(lo_d + width_d * F.col("bin_idx") / bins, 2).alias("bin_start"),
        dround(lo_d + width_d * (F.col("bin_idx") + 1) / bins, 2).alias("bin_end"),
        F.col("lines").cast("long").alias("lines"),
    ).orderBy("bin_idx")


def delivery_box_stats(fact: DataFrame, value: str = "delivery_time",
                       group: str = "category") -> DataFrame:
    """Box-plot statistics per group: quartiles (linear interpolation), whiskers
    at the most extreme values within 1.5 IQR of the box, outlier count.

    The rows are first reduced to a histogram ``(group, value) -> count`` by
    a map-side partial aggregate, so only distinct pairs are shuffled: a group
    holding a third of all rows costs no more than any other.  Quartiles come
    from running counts within value ranges, so a group may have any number of
    distinct values; whiskers and outliers come from the histogram joined with
    the per-group fences.
    """
    base = fact.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    hist = cache(base.groupBy(group, value).agg(F.count(F.lit(1)).alias("__c")))
    quartiles = grouped_quantiles(hist, group, value, "__c", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = hist.groupBy(group).agg(F.sum("__c").alias("n"), F.min(value).alias("min_value"),
                                F.max(value).alias("max_value")).join(quartiles, group)
    fences = q.select(group, (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lo_f"),
                      (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("hi_f"))
    joined = hist.join(fences, group, "inner")
    x = F.col(value)
    w = joined.groupBy(group).agg(
        F.min(F.when(x >= F.col("lo_f"), x)).alias("lower_whisker"),
        F.max(F.when(x <= F.col("hi_f"), x)).alias("upper_whisker"),
        F.sum(F.when((x < F.col("lo_f")) | (x > F.col("hi_f")), F.col("__c"))
              .otherwise(F.lit(0))).alias("outliers"))
    return q.join(w, group, "inner").select(
        group, F.col("n").cast("long").alias("n"), "min_value", "q1", "median", "q3",
        "max_value", "lower_whisker", "upper_whisker",
        F.col("outliers").cast("long").alias("outliers")).orderBy(group)


def scatter_sample(fact: DataFrame, sample_size: int = 5000, seed: int = 42) -> DataFrame:
    """At most ``sample_size`` lines (discount, profit, category) for a scatter.

    Rows are ranked by the MD5 of the seed and their identifying columns as text
    and the first ``sample_size`` kept, so the sample is the same on every run,
    under any partitioning and in any engine (unlike ``rand``-based sampling).
    One top-k in one pass over the fact: every input split keeps at most
    ``sample_size`` rows.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (
        "order_id", "product_id", "order_date", "ship_date", "quantity", "discount", "revenue")]))
    hashed = fact.select("discount", "profit", "category", h.alias("__h"))
    return (hashed.orderBy("__h", "profit", "category").limit(sample_size)
            .select(F.col("discount").cast("double").alias("discount"),
                    F.col("profit").cast("double").alias("profit"), "category"))


def forecast_band_polygon(forecast: DataFrame) -> DataFrame:
    """Outline of the forecast band of one series (``forecast_revenue``):
    upper values forward in time, then lower values backward, numbered by
    ``point_idx`` (a union of two selections over the horizon's rows)."""
    stats = forecast.agg(F.struct(F.count(F.lit(1)).alias("h"),
                                  F.min("date").alias("d0"))).scalar()
    h = stats.getField("h")
    day = F.datediff(F.col("date"), stats.getField("d0"))
    upper = forecast.select(day.cast("long").alias("point_idx"), "date",
                            F.col("upper").alias("value"))
    lower = forecast.select((F.lit(2) * h - 1 - day).cast("long").alias("point_idx"), "date",
                            F.col("lower").alias("value"))
    return upper.unionByName(lower).orderBy("point_idx")

