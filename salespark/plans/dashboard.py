"""The dashboard's query path: load the fact once, filter, compute every tab.

The reference loads the joined dataset once, caches it across interactions
and recomputes each tab on the filtered frame.  Here the fact is either
persisted (small data) or written once as a month-partitioned parquet table
in the shared checkpoint folder (large data) so later queries start from a
pruned columnar scan instead of repeating the star join.  Each tab is a set
of lazy DataFrames; nothing is gathered on the driver.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import wraps

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators import charts, customers, filters, forecast, insights, kpi, products, trends
from ..operators.profile import sales_profile
from ..operators.ordered import Kept, keeping
from ..sources.tables import materialize_fact, sales_fact
from .session import ensure_checkpoint_dir

_MATERIALIZED: dict[tuple[str, str], DataFrame] = {}


def materialized_fact(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """The test-table fact written once per session under the checkpoint folder.

    The folder comes from the session (``spark.checkpoint.dir`` on a
    cluster); a fresh sub-folder is used for every write.  ``refresh``
    writes it again.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if refresh or key not in _MATERIALIZED:
        base = ensure_checkpoint_dir(spark).rstrip("/")
        path = f"{base}/fact-{uuid.uuid4().hex}"
        _MATERIALIZED[key] = materialize_fact(sales_fact(spark, sf_dir), path)
    return _MATERIALIZED[key]


def _kept(tab):
    """A tab whose persisted and written intermediates belong to its dashboard."""
    @wraps(tab)
    def run(self, *args, **kwargs):
        with keeping(self._kept):
            return tab(self, *args, **kwargs)
    return run


@dataclass
class Dashboard:
    """Tab outputs over one (filtered) fact.

    ``persist=True`` keeps the filtered fact in executor memory/disk for the
    many queries of one interaction (as the reference's frame cache does);
    call ``close`` to release it.  Use it when the selection fits the
    executors' memory and local disks; over a full-size fact pass
    ``persist=False`` and let each tab read the month-partitioned table
    (date filters prune it).
    """
    fact: DataFrame
    filters: filters.Filters = field(default_factory=filters.Filters)
    persist: bool = True
    discount_edges: list[float] | None = None

    def __post_init__(self):
        self._kept, self._profile = Kept(), None
        self.data = filters.apply_filters(self.fact, self.filters)
        if self.persist:
            self.data = self.data.persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        """Release the filtered fact and what this dashboard's operators kept."""
        if self.persist:
            self.data.unpersist()
        self._kept.close()
        self._profile = None

    def profile(self):
        """The sums of the filtered fact that several tabs read, computed once."""
        if self._profile is None:
            self._profile = sales_profile(self.data, self.discount_edges)
        return self._profile

    @_kept
    def overview(self) -> dict[str, DataFrame]:
        summary = kpi.executive_summary(self.data, profile=self.profile())
        return {"summary": summary,
                "trend": trends.revenue_profit_trend(self.data, "ME"),
                "insights": insights.summary_insights(self.data, summary, self.discount_edges, self.profile())}

    @_kept
    def sales(self) -> dict[str, DataFrame]:
        by_state = trends.revenue_by_dimension(self.data, "state")
        return {"by_region": trends.revenue_by_dimension(self.data, "region"),
                "by_state": by_state,
                "state_map": charts.state_map_table(by_state),
                "heatmap": charts.weekday_month_heatmap(self.data),
                "histogram": charts.order_value_histogram(self.data),
                "delivery": charts.delivery_box_stats(self.data)}

    @_kept
    def products(self) -> dict[str, DataFrame]:
        return {"top": products.top_products(self.data, 10),
                "worst": products.worst_products(self.data, 10),
                "treemap": products.category_rollup(self.data),
                "pareto_top20": trends.pareto_top(self.data, "product_name", "revenue", 20),
                "discounts": products.discount_impact(self.data, self.discount_edges),
                "scatter": charts.scatter_sample(self.data),
                "inventory": products.inventory_recommendation(self.data)}

    @_kept
    def customers(self) -> dict[str, DataFrame]:
        rfm = customers.compute_rfm(self.data)
        churn = customers.churn_risk(self.data)
        return {"rfm": rfm,
                "segments": customers.segment_counts(rfm),
                "segment_summary": customers.segment_summary(rfm),
                "targets": customers.customers_to_target(rfm),
                "churn_counts": customers.churn_counts(churn),
                "top_customers": customers.top_customers(self.data, 20),
                "repeat_rate": customers.repeat_customer_rate(self.data)}

    @_kept
    def forecasting(self, horizon_days: int = 30) -> dict[str, DataFrame]:
        res = forecast.forecast_revenue(self.data, horizon_days)
        return {"history": res.history, "forecast": res.forecast,
                "band": charts.forecast_band_polygon(res.forecast),
                "totals": forecast.forecast_totals(res.forecast)}

    @_kept
    def ai(self) -> dict[str, DataFrame]:
        profile = self.profile()
        summary = kpi.executive_summary(self.data, profile=profile)
        ins = insights.summary_insights(self.data, summary, self.discount_edges, profile)
        return {"insights": ins, "context": insights.context_block(ins),
                "recommendations": insights.recommendations(self.data, summary, profile),
                "profit_drivers": insights.profit_drivers(self.data, self.discount_edges, profile),
                "region_growth": insights.region_growth(self.data, profile=profile)}
