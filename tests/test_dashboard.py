from __future__ import annotations

from salespark.operators import filters
from salespark.operators.ordered import release_cached
from salespark.plans.dashboard import Dashboard, materialized_fact
from salespark.plans.inspect import scan_summaries
from salespark.sources.tables import sales_fact

from .conftest import SF_SMALL


def test_materialized_fact_matches_join(spark):
    fact = materialized_fact(spark, SF_SMALL)
    joined = sales_fact(spark, SF_SMALL)
    assert sorted(fact.drop("order_month").columns) == sorted(joined.columns)
    assert fact.count() == joined.count()
    assert fact.drop("order_month").exceptAll(joined.select(*fact.drop("order_month").columns)) \
        .count() == 0
    # a date filter prunes month partitions of the written fact
    one_month = filters.filter_date_range(fact, "1997-03-01", "1997-03-31")
    one_month.write.format("noop").mode("overwrite").save()
    assert any("order_month" in s.get("PartitionFilters", "") for s in scan_summaries(one_month))
    assert one_month.count() == joined.where(
        "order_date between date'1997-03-01' and date'1997-03-31'").count()


def test_every_tab_runs(spark):
    fact = materialized_fact(spark, SF_SMALL)
    board = Dashboard(fact, filters.Filters(start="1996-01-01", end="1999-12-31",
                                            selections={"region": ["AMERICA", "ASIA"]}),
                      discount_edges=[0.0, 0.05, 0.10])
    try:
        tabs = [board.overview(), board.sales(), board.products(), board.customers(),
                board.forecasting(30), board.ai()]
        for tab in tabs:
            for name, df in tab.items():
                rows = df.collect()
                assert rows is not None, name
        assert board.forecasting(30)["forecast"].count() == 30
        s = board.overview()["summary"].first()
        assert s.total_orders > 0
    finally:
        board.close()
        release_cached()


def test_queries_read_only_needed_columns(spark):
    from salespark.operators.kpi import executive_summary
    fact = materialized_fact(spark, SF_SMALL)
    df = executive_summary(fact)
    df.write.format("noop").mode("overwrite").save()
    schemas = [s["ReadSchema"] for s in scan_summaries(df)]
    assert schemas
    for rs in schemas:
        for unused in ("product_name", "customer_name", "ship_date", "unit_price", "state"):
            assert unused not in rs, rs
