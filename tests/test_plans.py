"""Physical-plan checks over every registered query."""

from __future__ import annotations

import pytest

from salespark.operators.ordered import release_cached
from salespark.plans import registry
from salespark.plans.inspect import broadcast_inputs, forbidden_nodes, scan_summaries
from salespark.sources.tables import sales_fact
from salespark.operators.filters import filter_date_range

from .conftest import SF_SMALL

# boosted trees are fitted by numpy, a series a group: as many rows as the calendar has days
GROUPED = {"forecast_gbt", "forecast_gbt_checks"}


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_no_unscalable_operators(spark, key):
    df = registry.QUERIES[key](spark, SF_SMALL)
    df.collect()  # an action on this frame itself, so its plan is the final one
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not plan.startswith("AdaptiveSparkPlan isFinalPlan=false")
    assert set(forbidden_nodes(df)) <= ({"FlatMapGroupsInPandas"} if key in GROUPED else set())
    release_cached()


def test_fact_join_streams_lineitem(spark):
    fact = sales_fact(spark, SF_SMALL)
    fact.collect()
    built = broadcast_inputs(fact)
    assert built, "small dimensions are broadcast"
    assert all("lineitem.parquet" not in files for files in built)


def test_filters_and_pruning_reach_the_scan(spark):
    fact = filter_date_range(sales_fact(spark, SF_SMALL), "1996-01-01", "1996-12-31") \
        .select("order_id", "revenue")
    fact.collect()
    scans = {s["Location"].split("/")[-1].rstrip("]"): s for s in scan_summaries(fact)}
    orders = scans["orders.parquet"]
    assert "GreaterThanOrEqual(o_orderdate" in orders["PushedFilters"]
    assert "o_orderpriority" not in orders["ReadSchema"]  # unused columns pruned
    assert "l_shipdate" not in scans["lineitem.parquet"]["ReadSchema"]


def test_cluster_conf_sizes_partitions():
    from salespark.plans.session import cluster_conf
    big = cluster_conf(100 * 1024 ** 4, executors=1000, cores_per_executor=8)
    assert int(big["spark.sql.shuffle.partitions"]) == 200_000
    small = cluster_conf(10 * 1024 ** 3, executors=10, cores_per_executor=4)
    assert int(small["spark.sql.shuffle.partitions"]) == 120  # three waves of 40 slots


def test_trusted_foreign_keys_prune_unused_joins(spark):
    from salespark.operators.products import product_performance
    fact = sales_fact(spark, SF_SMALL, trust_foreign_keys=True)
    df = product_performance(fact)
    df.collect()
    files = sorted(s["Location"].split("/")[-1].rstrip("]") for s in scan_summaries(df))
    assert files == ["lineitem.parquet", "part.parquet"]  # orders and customers never read
    plain = sorted(map(tuple, product_performance(sales_fact(spark, SF_SMALL)).collect()))
    assert sorted(map(tuple, df.collect())) == plain


def test_broadcasts_are_bounded_by_bytes(spark):
    """The same number of rows is sent when narrow and joined by sort-merge when wide."""
    from pyspark.sql import functions as F
    from salespark.sources.tables import BROADCAST_MAX_BYTES, broadcast_if_small, row_bytes
    narrow = spark.range(10).select(F.col("id").alias("k"))
    wide = narrow.select("k", *[F.lit("x").alias(f"c{i}") for i in range(40)])
    rows = BROADCAST_MAX_BYTES // row_bytes(narrow)
    hinted = [("ResolvedHint" in side._jdf.queryExecution().analyzed().toString())
              for side in (broadcast_if_small(narrow, rows), broadcast_if_small(narrow, rows + 1), broadcast_if_small(wide, rows))]
    assert hinted == [True, False, False]


def test_workers_get_the_whole_package(spark):
    """Workers find one package of its name only, so what is shipped leaves no module out."""
    import zipfile
    from pathlib import Path

    import salespark
    from pyspark import SparkFiles
    from salespark.plans.session import ship_package
    ship_package(spark)
    top = Path(salespark.__path__[0])
    with zipfile.ZipFile(SparkFiles.get("salespark-whole.zip")) as z:
        assert set(z.namelist()) == {str(f.relative_to(top.parent)) for f in top.rglob("*.py")}


def _joined_by_sort_merge(spark, monkeypatch):
    """No join side is small enough to be broadcast; the session's settings to restore."""
    from salespark.sources import tables
    monkeypatch.setattr(tables, "broadcast_if_small", lambda side, rows: side)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    return before


def test_tasks_of_the_fact_have_as_many_lines_at_every_size(spark, monkeypatch):
    """More lines make more tasks, whatever the session's number of shuffle partitions (4)."""
    from pyspark.sql import functions as F
    from salespark.sources import tables
    whole = sorted(map(str, sales_fact(spark, SF_SMALL).collect()))
    before = _joined_by_sort_merge(spark, monkeypatch)
    monkeypatch.setattr(tables, "LINES_PER_TASK", 250)
    try:
        rows = sales_fact(spark, SF_SMALL).withColumn("__task", F.spark_partition_id()).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len({r["__task"] for r in rows}) > 12  # about 6,000 lines
    assert sorted(str(r).split(", __task=")[0] + ")" for r in rows) == whole


def test_lines_that_lie_by_product_are_not_shuffled_by_product_again(spark, monkeypatch):
    from salespark.sources import flatfile, tables
    c, p, o = flatfile.normalize(flatfile.to_flat(sales_fact(spark, SF_SMALL)))
    whole = sorted(map(str, tables.fact_from_tables(o, c, p).collect()))
    before = _joined_by_sort_merge(spark, monkeypatch)
    try:
        fact = tables.fact_from_tables(o.repartition(7, "product_id"), c, p.repartition(7, "product_id"))
        rows = fact.collect()
        plan = fact._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sorted(map(str, rows)) == whole
    above = plan[:plan.index("REPARTITION_BY_NUM")]
    assert above.count("Exchange hashpartitioning(customer_id") == 1 and "Exchange hashpartitioning(product_id" not in \
        above.rsplit("\n", 1)[0]


def test_orders_and_customers_are_joined_in_as_many_tasks_as_orders_need(spark, monkeypatch):
    """The join below the lines grows with the orders, whatever the session's number (4)."""
    import re
    from salespark.sources import tables
    n_orders = tables.table_rows(spark, SF_SMALL, "orders")
    whole = sorted(map(str, sales_fact(spark, SF_SMALL).collect()))
    before = _joined_by_sort_merge(spark, monkeypatch)
    monkeypatch.setattr(tables, "LINES_PER_TASK", 50)
    try:
        fact = sales_fact(spark, SF_SMALL)
        assert sorted(map(str, fact.collect())) == whole
        plan = fact._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    for key in ("o_custkey", "customer_id"):
        dealt = {int(n) for n in re.findall(rf"Exchange hashpartitioning\({key}#\d+L?, (\d+)\)", plan)}
        assert dealt == {-(-n_orders // 50)}, (key, dealt)


def test_lines_of_a_fact_read_again_are_shuffled_once(spark, monkeypatch):
    """The normalised tables and their join read the lines three times, from one shuffle by order and one by product."""
    import re
    from collections import Counter
    from salespark.sources import flatfile, tables
    c, p, o = flatfile.normalize(flatfile.to_flat(sales_fact(spark, SF_SMALL)))
    plain = registry.out(tables.fact_from_tables(flatfile.typed_orders(o), c, p))
    before = _joined_by_sort_merge(spark, monkeypatch)
    try:
        df = registry.QUERIES["normalized_fact"](spark, SF_SMALL)
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert df.schema == plain.schema and sorted(map(str, rows)) == sorted(map(str, plain.collect()))
    shuffled = Counter(re.findall(r"[+:]- Exchange hashpartitioning\((\w+)#", plan))
    assert (shuffled["l_orderkey"], shuffled["l_partkey"]) == (1, 1)
    assert plan.count("LeftOuter") == 1  # only the customers' table takes customers' texts


def test_a_fact_read_again_has_the_same_rows_whatever_repeats_or_lacks(spark, tmp_path, monkeypatch):
    """Keys that repeat (with the same and with other texts), lack their match or are NULL."""
    from pyspark.sql import functions as F
    from salespark.sources.tables import TABLES, read_table
    for name in TABLES[:7]:
        t = read_table(spark, SF_SMALL, name)
        key = t.columns[0]
        if name in ("customer", "part", "orders"):
            text = {"customer": "c_mktsegment", "part": "p_brand", "orders": "o_orderpriority"}[name]
            t = t.where(f"{key} % 11 != 4").unionByName(t.where(f"{key} % 5 = 0")) \
                .unionByName(t.where(f"{key} % 7 = 0").withColumn(text, F.lit("other"))) \
                .unionByName(t.where(f"{key} % 3 = 0").withColumn(text, F.lit(None).cast("string"))) \
                .unionByName(t.where(f"{key} % 9 = 1").withColumn(key, F.lit(None).cast(t.schema[key].dataType)))
        if name == "lineitem":
            t = t.withColumn("l_partkey", F.expr("if(l_linenumber = 2, NULL, l_partkey)"))
        if name == "orders":
            t = t.withColumn("o_custkey", F.expr("if(o_orderkey % 13 = 2, NULL, o_custkey)"))
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
    plain = sales_fact(spark, str(tmp_path))
    whole = sorted(map(str, plain.collect()))
    assert len(whole) > 6000
    again = sales_fact(spark, str(tmp_path), read_again=True)
    assert again.schema == plain.schema and sorted(map(str, again.collect())) == whole
    before = _joined_by_sort_merge(spark, monkeypatch)
    try:
        again = sales_fact(spark, str(tmp_path), read_again=True)
        assert sorted(map(str, again.collect())) == whole
        few = ["order_id", "customer_id", "product_id", "profit"]  # without customers' texts
        assert sorted(map(str, again.select(*few).collect())) == sorted(map(str, plain.select(*few).collect()))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
