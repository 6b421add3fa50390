"""Dashboard filters over the fact: date range, multi-select, name search.

Filters are plain ``where`` predicates, so Catalyst pushes them into the
parquet scans (and prunes partitions of a materialised fact).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import and_all, regex_contains

# The fields offered as multi-select filters, in display order.
MULTI_SELECT_FIELDS = ("region", "category", "sub_category", "city", "sales_channel")


@dataclass
class Filters:
    start: dt.date | str | None = None
    end: dt.date | str | None = None
    selections: dict[str, list] = field(default_factory=dict)
    customer_search: str | None = None
    literal_search: bool = False


def _as_date(v) -> Column:
    return F.to_date(F.lit(str(v)))


MONTH_PARTITION = "order_month"


def date_range_predicate(start=None, end=None, column: str = "order_date",
                         month_column: str | None = None) -> Column:
    """Inclusive on both ends; a missing end is open.

    With ``month_column`` (the ``yyyy-MM`` partition column of a
    materialised fact) the same range is also stated on the months, which
    lets the scan skip whole partitions.
    """
    conds = []
    if start is not None:
        conds.append(F.col(column) >= _as_date(start))
        if month_column:
            conds.append(F.col(month_column) >= F.date_format(_as_date(start), "yyyy-MM"))
    if end is not None:
        conds.append(F.col(column) <= _as_date(end))
        if month_column:
            conds.append(F.col(month_column) <= F.date_format(_as_date(end), "yyyy-MM"))
    return and_all(conds)


def _month_col(df: DataFrame) -> str | None:
    return MONTH_PARTITION if MONTH_PARTITION in df.columns else None


def multi_select_predicate(selections: dict[str, list]) -> Column:
    """AND across fields, IN within a field; an empty list means no filter."""
    conds = [F.col(c).isin(list(values)) for c, values in selections.items() if values]
    return and_all(conds)


def filter_mask(f: Filters, month_column: str | None = None) -> Column:
    conds = [date_range_predicate(f.start, f.end, month_column=month_column),
             multi_select_predicate(f.selections)]
    if f.customer_search:
        conds.append(regex_contains("customer_name", f.customer_search, True, f.literal_search))
    return and_all(conds)


def apply_filters(fact: DataFrame, f: Filters) -> DataFrame:
    return fact.where(filter_mask(f, _month_col(fact)))


def filter_date_range(fact: DataFrame, start=None, end=None) -> DataFrame:
    return fact.where(date_range_predicate(start, end, month_column=_month_col(fact)))


def filter_multi_select(fact: DataFrame, selections: dict[str, list]) -> DataFrame:
    return fact.where(multi_select_predicate(selections))


def filter_customer_search(fact: DataFrame, pattern: str, literal: bool = False) -> DataFrame:
    """Case-insensitive regex (or literal) match on the customer name."""
    return fact.where(regex_contains("customer_name", pattern, True, literal))


def filter_options(fact: DataFrame, fields=MULTI_SELECT_FIELDS) -> DataFrame:
    """Sorted distinct values of each multi-select field: (field, value).

    One scan; the distinct runs as a partial (map-side) aggregate, so the
    shuffle carries at most one row per (field, value) per partition.
    """
    stacked = fact.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
        for c in fields])).alias("o")).select("o.field", "o.value")
    return stacked.where(F.col("value").isNotNull()).distinct().orderBy("field", "value")


def filter_match_count(fact: DataFrame, f: Filters) -> DataFrame:
    """One row: matching rows, all rows, and the overall date bounds."""
    return fact.agg(
        F.count_if(filter_mask(f)).alias("matched_rows"),
        F.count(F.lit(1)).alias("total_rows"),
        F.min("order_date").alias("min_date"),
        F.max("order_date").alias("max_date"),
    )


def sold(fact: DataFrame) -> DataFrame:
    return fact.where(F.col("revenue") > 0)


def loss_making(fact: DataFrame) -> DataFrame:
    return fact.where(F.col("profit") < 0)
