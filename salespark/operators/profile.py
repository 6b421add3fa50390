"""One pass over the fact for all headline read-outs.

``sales_profile`` sums revenue, profit, units, lines and returns by several groupings
at once (grouping sets: Spark aggregates each map-side and shuffles partial sums
only), so summary, insights, drivers and recommendations read the fact once instead
of once each.  Distinct orders and customers don't add up over groups; they are
counted in a second pass over two columns, and only where asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import band_index, is_returned
from .ordered import written
from .products import DEFAULT_DISCOUNT_EDGES, PRODUCT_KEYS

MONTH, BAND = "order_month_start", "band_idx"
# The groupings: name -> columns.
GROUPINGS = {
    "products": PRODUCT_KEYS,
    "categories": ["category"],
    "region_months": ["region", MONTH],
    "bands": [BAND],
    "days": ["order_date"],
}
MEASURES = ["rev", "prof", "units_sold", "lines", "returned_lines"]


@dataclass
class Profile:
    """Sums of the fact by each of ``GROUPINGS``; ``rows`` holds them all, as a written
    table (a persisted frame of grouping sets is computed anew for each use in a union)."""

    fact: DataFrame
    rows: DataFrame
    edges: list[float]

    def by(self, grouping: str) -> DataFrame:
        """The grouping's columns and ``MEASURES``; a NULL key is a group of its own."""
        return self.rows.where(F.col("grouping") == grouping).select(*GROUPINGS[grouping], *MEASURES)

    def known(self, grouping: str) -> DataFrame:
        """``by`` without the groups of a NULL key."""
        return self.by(grouping).dropna(subset=GROUPINGS[grouping])


def sales_profile(fact: DataFrame, edges: list[float] | None = None,
                  groupings: tuple[str, ...] = tuple(GROUPINGS)) -> Profile:
    """Profile of ``fact`` by the named groupings, with discount bands of ``edges``."""
    edges = edges or DEFAULT_DISCOUNT_EDGES
    chosen = {name: GROUPINGS[name] for name in groupings}
    columns = list(dict.fromkeys(c for keys in chosen.values() for c in keys))
    derived = {MONTH: F.trunc("order_date", "month"), BAND: band_index("discount", edges)}
    base = fact.withColumns({c: e for c, e in derived.items() if c in columns} | {"__ret": is_returned().cast("int")})
    # grouping_id has a bit for each column that a grouping leaves out, the first column's highest
    ids = {sum(1 << i for i, c in enumerate(reversed(columns)) if c not in keys): name for name, keys in chosen.items()}
    names = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    rows = base.groupingSets([[F.col(c) for c in keys] for keys in chosen.values()], *columns).agg(
        F.sum("revenue").alias("rev"), F.sum("profit").alias("prof"),
        F.sum("quantity").cast("long").alias("units_sold"), F.count(F.lit(1)).alias("lines"),
        F.sum("__ret").alias("returned_lines"), F.grouping_id().cast("int").alias("__id"))
    return Profile(fact, written(rows.withColumn("grouping", names[F.col("__id")]).drop("__id"), "profile"), edges)
