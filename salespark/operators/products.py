"""Product analytics: performance, top/worst lists, category contribution,
discount bands, quantile-based inventory flags and repricing candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import band_index, band_label_expr, dround, is_returned, money, ratio_pct
from .ordered import cache, exact_quantiles_of

# Default discount band edges (fractions) and the inventory
# flag labels.
DEFAULT_DISCOUNT_EDGES = [0.0, 0.10, 0.20, 0.30, 1.0]
RESTOCK, HOLD, DISCONTINUE = "Restock", "Hold", "Discontinue"
PRODUCT_KEYS = ["product_id", "product_name", "category", "sub_category"]


def product_performance(fact: DataFrame, approx: bool = False, exact: bool = False) -> DataFrame:
    """Per product: revenue, profit, units, distinct orders, average rating
    (2 dp), return rate % and margin % (1 dp; margin NULL at zero revenue).
    ``approx=True`` counts orders with HyperLogLog (no distinct shuffle).
    ``exact=True`` adds the unrounded sums ``rev`` and ``prof``, for rules that
    compare or rank.

    Rows with a NULL in any of the four product keys are left out; the
    four keys are the grouping key.  Every aggregation buffer is fixed-width
    (sums, counts), so Spark hash-aggregates with code generation; carrying
    the names as ``min`` aggregates instead would force a sort-based
    aggregate over every fact row.  Rows are not sorted (a global sort of a
    per-product table is left to the caller; ``top_products`` ranks with a
    top-k).
    """
    orders = F.approx_count_distinct("order_id") if approx else F.count_distinct("order_id")
    keyed = fact.where(F.col("product_id").isNotNull() & F.col("product_name").isNotNull()
                       & F.col("category").isNotNull() & F.col("sub_category").isNotNull())
    perf = (keyed.groupBy(*PRODUCT_KEYS)
            .agg(F.sum("revenue").alias("rev"), F.sum("profit").alias("prof"),
                 F.sum("quantity").alias("units_sold"),
                 orders.alias("orders"),
                 F.avg("rating").alias("avg_rating"),
                 F.count_if(is_returned()).alias("__ret"), F.count(F.lit(1)).alias("__rows")))
    return perf.select(
        *PRODUCT_KEYS,
        money("rev").alias("revenue"), money("prof").alias("profit"),
        F.col("units_sold").cast("long").alias("units_sold"),
        F.col("orders").cast("long").alias("orders"),
        dround("avg_rating", 2).alias("avg_rating"),
        ratio_pct("__ret", "__rows").alias("return_rate_pct"),
        F.when(F.col("rev") != 0, ratio_pct("prof", "rev")).alias("margin_pct"),
        *(["rev", "prof"] if exact else []),
    )


def measured(sums: DataFrame) -> DataFrame:
    """Products' sums ``rev`` and ``prof`` with ``revenue`` and ``margin_pct`` as shown."""
    return sums.withColumns({"revenue": money("rev"),
                             "margin_pct": F.when(F.col("rev") != 0, ratio_pct("prof", "rev"))})


def top_products(fact: DataFrame, n: int = 10, by: str = "revenue") -> DataFrame:
    """The ``n`` products with the largest ``by`` (ties: higher revenue, then id)."""
    perf = product_performance(fact)
    return perf.orderBy(F.col(by).desc_nulls_last(), F.col("revenue").desc(),
                        F.col("product_id")).limit(n)


def worst_products(fact: DataFrame, n: int = 10, by: str = "profit") -> DataFrame:
    """The ``n`` products with the smallest ``by`` (ties: higher revenue, then id)."""
    perf = product_performance(fact)
    return perf.orderBy(F.col(by).asc_nulls_last(), F.col("revenue").desc(),
                        F.col("product_id")).limit(n)


def category_contribution(fact: DataFrame) -> DataFrame:
    """Revenue, profit and margin % per (category, sub-category)."""
    g = (fact.where(F.col("category").isNotNull() & F.col("sub_category").isNotNull())
         .groupBy("category", "sub_category")
         .agg(F.sum("revenue").alias("rev"), F.sum("profit").alias("prof")))
    return g.select("category", "sub_category", money("rev").alias("revenue"),
                    money("prof").alias("profit"), ratio_pct("prof", "rev").alias("margin_pct"))


def category_rollup(fact: DataFrame) -> DataFrame:
    """Treemap nodes: every (category, sub-category) leaf plus each category
    total, via ``ROLLUP`` (one aggregation, no self-union).  ``level`` is 0
    for a leaf and 1 for a category; margin % is revenue-weighted."""
    g = (fact.where(F.col("category").isNotNull() & F.col("sub_category").isNotNull())
         .rollup("category", "sub_category")
         .agg(F.sum("revenue").alias("rev"), F.sum("profit").alias("prof"),
              F.grouping_id().alias("level")))
    return g.where(F.col("level") < 3).select(
        "category", "sub_category", F.col("level").cast("int").alias("level"),
        money("rev").alias("revenue"), money("prof").alias("profit"),
        ratio_pct("prof", "rev").alias("margin_pct"))


def discount_impact(fact: DataFrame, edges: list[float] | None = None,
                    exact: bool = False) -> DataFrame:
    """Revenue, profit, distinct orders and margin % per discount band.

    Bands are right-closed ``(e[i], e[i+1]]`` with the lowest band closed on
    both ends; labels read ``"10-20%"``.  Discounts outside the edges (or
    NULL) and empty bands are left out.  ``band_idx`` gives band order.
    ``exact=True`` adds the unrounded margin ratio ``margin``.
    """
    edges = edges or DEFAULT_DISCOUNT_EDGES
    banded = fact.withColumn("band_idx", band_index("discount", edges)) \
        .where(F.col("band_idx").isNotNull())
    g = banded.groupBy("band_idx").agg(
        F.sum("revenue").alias("rev"), F.sum("profit").alias("prof"),
        F.count_distinct("order_id").alias("orders"))
    return g.select(
        F.col("band_idx").cast("int").alias("band_idx"),
        band_label_expr("band_idx", edges).alias("discount_band"),
        money("rev").alias("revenue"), money("prof").alias("profit"),
        F.col("orders").cast("long").alias("orders"),
        ratio_pct("prof", "rev").alias("margin_pct"),
        *([margin_ratio().alias("margin")] if exact else []),
    ).orderBy("band_idx")


def margin_ratio() -> Column:
    """Unrounded profit / revenue of the sums ``prof`` and ``rev`` (NULL at zero revenue)."""
    return F.when(F.col("rev") != 0, F.col("prof").cast("double") / F.col("rev").cast("double"))


def product_quantiles(perf: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row of the exact quantiles used by the inventory and repricing rules:
    units sold .33/.66, margin % .33/.66 (NULL margins skipped), and over
    products with revenue > 0: revenue .75 and margin % median."""
    units, margin = F.col("units_sold"), F.col("margin_pct")
    priced = F.col("revenue") > 0
    return exact_quantiles_of(perf, {
        "units_q33": (units, 0.33), "units_q66": (units, 0.66),
        "margin_q33": (margin, 0.33), "margin_q66": (margin, 0.66),
        "revenue_q75": (F.when(priced, F.col("revenue")), 0.75),
        "priced_margin_median": (F.when(priced, margin), 0.5)}, buckets=buckets)


def inventory_recommendation(fact: DataFrame, buckets: int | None = None) -> DataFrame:
    """Product performance plus a Restock / Hold / Discontinue flag.

    Thresholds are the .33 / .66 quantiles of units sold and of (rounded)
    margin %.  Units >= q66 and margin not <= q33 -> Restock; units <= q33
    and margin <= q33 -> Discontinue; otherwise Hold.  A NULL margin is not
    "low".  The thresholds are one-row scalar subqueries.
    """
    perf = cache(product_performance(fact))
    return flagged(perf, buckets)


def flagged(perf: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows with ``units_sold`` and ``margin_pct`` and their ``recommendation``."""
    units, margin = F.col("units_sold"), F.col("margin_pct")
    cuts = exact_quantiles_of(perf, {"u33": (units, 0.33), "u66": (units, 0.66), "m33": (margin, 0.33)}, buckets=buckets)
    row = cuts.select(F.struct("u33", "u66", "m33")).scalar()
    u33, u66, m33 = (row.getField(c) for c in ("u33", "u66", "m33"))
    high_velocity = F.coalesce(F.col("units_sold") >= u66, F.lit(False))
    low_velocity = F.coalesce(F.col("units_sold") <= u33, F.lit(False))
    low_margin = F.coalesce(F.col("margin_pct") <= m33, F.lit(False))
    flag = (F.when(high_velocity & ~low_margin, RESTOCK)
            .when(low_velocity & low_margin, DISCONTINUE).otherwise(HOLD))
    return perf.withColumn("recommendation", flag)


INVENTORY_VIEW_COLUMNS = ["product_name", "category", "units_sold", "margin_pct", "recommendation"]


def inventory_view(inventory: DataFrame) -> DataFrame:
    """The inventory table as shown to merchandisers (five columns)."""
    return inventory.select(*INVENTORY_VIEW_COLUMNS)


def inventory_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("recommendation").agg(F.count(F.lit(1)).alias("products")) \
        .orderBy("recommendation")


def repricing_candidates(fact: DataFrame, buckets: int | None = None) -> DataFrame:
    """Products with revenue > 0, unrounded revenue >= its .75 quantile and margin
    below the median margin (both over products with revenue > 0); thinnest margin
    first."""
    perf = product_performance(fact, exact=True)
    return repriced(cache(perf.where(F.col("rev") > 0)), buckets).drop("rev", "prof")


def repriced(priced: DataFrame, buckets: int | None = None) -> DataFrame:
    """The candidates among products with revenue > 0 (product_id, rev, margin_pct)."""
    cuts = exact_quantiles_of(priced, {"r75": (F.col("rev"), 0.75), "mid": (F.col("margin_pct"), 0.5)}, buckets=buckets)
    row = cuts.select(F.struct("r75", "mid")).scalar()
    return (priced.where((F.col("rev").cast("double") >= row.getField("r75"))
                         & (F.col("margin_pct") < row.getField("mid")))
            .orderBy(F.col("margin_pct").asc(), F.col("rev").desc(), "product_id"))


def unprofitable_products(fact: DataFrame) -> DataFrame:
    """One row: number of products with negative (unrounded) total profit."""
    return product_performance(fact, exact=True).agg(
        F.count_if(F.col("prof") < 0).alias("unprofitable_products"))
