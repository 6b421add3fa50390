from __future__ import annotations

import datetime as dt
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salespark.sources import flatfile, loads, schema
from salespark.sources.integrity import constraint_report
from salespark.sources.tables import fact_from_tables


def _flat_rows():
    base = dict(Customer_ID="C1", Customer_Name="Alice", Age=30, Gender="Female", City="Austin",
                State="Texas", Region="South", Country="United States", Category="Electronics",
                Sub_Category="Smartphones", Quantity=1, Discount=Decimal("0.00"),
                Sales_Channel="Online", Payment_Method="Card", Returned="No", Delivery_Time=2,
                Rating=5)
    r1 = dict(base, Order_ID="ORD1", Order_Date=dt.date(2026, 1, 1), Ship_Date=dt.date(2026, 1, 3),
              Product_ID="P1", Product_Name="Nova Phone", Unit_Price=Decimal("100.00"),
              Cost=Decimal("60.00"), Revenue=Decimal("100"), Profit=Decimal("40"))
    r2 = dict(base, Order_ID="ORD2", Order_Date=dt.date(2026, 1, 2), Ship_Date=dt.date(2026, 1, 4),
              Product_ID="P2", Product_Name="Ridge Shirt", Unit_Price=Decimal("90.00"),
              Cost=Decimal("55.00"), Revenue=Decimal("90"), Profit=Decimal("35"),
              Customer_Name="Alice B")  # a later line with a changed name: first wins
    return [tuple(r[c] for c in schema.FLAT.fieldNames()) for r in (r1, r2)]


@pytest.fixture(scope="module")
def flat(spark):
    return spark.createDataFrame(_flat_rows(), schema.FLAT)


def test_normalize(flat):
    customers, products, orders = flatfile.normalize(flat)
    assert customers.count() == 1
    assert customers.columns == ["customer_id", "customer_name", "age", "gender", "city", "state",
                                 "region", "country"]
    assert customers.first().customer_name == "Alice"
    assert products.count() == 2 and products.columns == schema.PRODUCT_COLUMNS
    assert orders.count() == 2 and orders.columns == schema.ORDER_COLUMNS
    first = orders.orderBy("order_id").first()
    assert first.order_date == "2026-01-01" and isinstance(first.order_date, str)


def test_csv_round_trip_and_tables(spark, flat):
    base = tempfile.mkdtemp(prefix="salespark-test-")
    flatfile.write_flat_csv(flat, f"{base}/flat")
    back = flatfile.read_flat_csv(spark, f"{base}/flat")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, flat.collect()))
    c, p, o = flatfile.normalize(back)
    flatfile.write_tables(c, p, o, f"{base}/db", load_id="a")
    flatfile.write_tables(c, p, o, f"{base}/db", load_id="a")  # the same load again changes nothing
    c2, p2, o2 = flatfile.read_tables(spark, f"{base}/db")
    assert (c2.count(), p2.count(), o2.count()) == (1, 2, 2)
    fact = fact_from_tables(o2, c2, p2)
    assert fact.columns == schema.FACT_COLUMNS and fact.count() == 2
    assert fact.where(F.col("order_date") == dt.date(2026, 1, 1)).count() == 1


def test_order_measures(spark):
    lines = spark.createDataFrame(
        [(3, Decimal("19.99"), Decimal("0.15"), Decimal("12.50"), dt.date(2026, 1, 1),
          dt.date(2026, 1, 5))],
        "quantity int, unit_price decimal(12,2), discount decimal(4,2), cost decimal(12,2), "
        "order_date date, ship_date date")
    m = flatfile.order_measures(lines).first()
    assert m.revenue_calc == Decimal("50.97")  # 3 * 19.99 * 0.85 = 50.9745
    assert m.profit_calc == Decimal("13.47")
    assert m.delivery_days == 4


def test_constraint_report(spark, sample_df):
    flat = flatfile.to_flat(sample_df)
    c, p, o = flatfile.normalize(flat)
    o = flatfile.to_snake_case(flat).select(*schema.ORDER_COLUMNS)
    orphan = o.limit(1).withColumn("order_id", F.lit("ORD999")).withColumn("product_id", F.lit("PX"))
    dup = o.where("order_id = 'L01'")
    rep = {(r.table_name, r.rule, r.column_name): r.violations
           for r in constraint_report(c, p, o.unionByName(orphan).unionByName(dup)).collect()}
    assert rep[("orders", "foreign_key", "product_id")] == 1
    assert rep[("orders", "foreign_key", "customer_id")] == 0
    assert rep[("orders", "primary_key", "order_id")] == 1
    assert rep[("customers", "primary_key", "customer_id")] == 0
    assert all(v == 0 for (t, rule, _), v in rep.items() if rule == "not_null")


def test_load_csv_to_tables(spark, flat):
    base = tempfile.mkdtemp(prefix="salespark-test-")
    flatfile.write_flat_csv(flat, f"{base}/flat")
    flatfile.load_csv_to_tables(spark, f"{base}/flat", f"{base}/db")
    c, p, o = flatfile.read_tables(spark, f"{base}/db")
    assert (c.count(), p.count(), o.count()) == (1, 2, 2)


@pytest.mark.parametrize("parts", [2, 7])
def test_loads_keep_every_order_line(spark, parts):
    """Lines of one order spread over several loads are all stored, replays included."""
    from salespark.sources.tables import sales_fact
    base = tempfile.mkdtemp(prefix="salespark-test-")
    fact = sales_fact(spark, "/root/testdata/sf0.001")
    flat = flatfile.to_flat(fact).withColumn("__part", F.pmod(F.xxhash64("*"), F.lit(parts))).cache()
    assert flat.count() == 6000
    for k in [*range(parts), 0]:  # the first part once more
        part = flat.where(F.col("__part") == k).drop("__part")
        flatfile.write_tables(*flatfile.normalize(part), f"{base}/db", load_id=f"part{k}")
    c, p, o = flatfile.read_tables(spark, f"{base}/db")
    assert o.count() == 6000
    assert c.count() == c.select("customer_id").distinct().count()
    assert p.count() == p.select("product_id").distinct().count()
    flat.unpersist()


def test_declared_unique_orders_raise(spark, flat):
    base = tempfile.mkdtemp(prefix="salespark-test-")
    c, p, o = flatfile.normalize(flat)
    flatfile.write_tables(c, p, o, f"{base}/db", load_id="a", unique_orders=True)
    flatfile.write_tables(c, p, o, f"{base}/db", load_id="a", unique_orders=True)
    with pytest.raises(ValueError, match="not unique"):
        flatfile.write_tables(c, p, o, f"{base}/db", load_id="b", unique_orders=True)
    with pytest.raises(ValueError, match="not unique"):
        flatfile.write_tables(c, p, o.unionByName(o), f"{base}/db", load_id="a", unique_orders=True)


def _line(flat, customer, order, name="Alice"):
    """The first flat line as another order of another customer."""
    return flat.orderBy("Order_ID").limit(1).withColumns({
        "Customer_ID": F.lit(customer), "Order_ID": F.lit(order), "Customer_Name": F.lit(name)})


def _stored(spark, base):
    c, p, o = flatfile.read_tables(spark, base)
    fact = fact_from_tables(o, c, p)
    return c, o, fact


def test_reader_between_the_writes_sees_the_state_before(spark, flat, monkeypatch):
    base = tempfile.mkdtemp(prefix="salespark-test-") + "/db"
    assert [t.count() for t in flatfile.read_tables(spark, base)] == [0, 0, 0]
    flatfile.write_tables(*flatfile.normalize(_line(flat, "K", "O1")), base, load_id="a")
    seen = []
    write = loads.write

    def watched(frame, name, *rest):
        write(frame, name, *rest)
        seen.append((name, *(t.count() for t in flatfile.read_tables(spark, base))))

    monkeypatch.setattr(loads, "write", watched)
    flatfile.write_tables(*flatfile.normalize(_line(flat, "L", "O2")), base, load_id="b")
    assert seen == [(t, 1, 1, 1) for t in ("customers", "products", "orders")]
    assert [t.count() for t in flatfile.read_tables(spark, base)] == [2, 1, 2]


def test_failed_attempt_is_never_seen(spark, flat, monkeypatch):
    base = tempfile.mkdtemp(prefix="salespark-test-") + "/db"
    flatfile.write_tables(*flatfile.normalize(flat), base, load_id="a")
    write = loads.write

    def fails(frame, name, *rest):
        if name == "orders":
            raise RuntimeError("executor lost")
        write(frame, name, *rest)

    monkeypatch.setattr(loads, "write", fails)
    with pytest.raises(RuntimeError):
        flatfile.write_tables(*flatfile.normalize(_line(flat, "Z", "O9")), base, load_id="b")
    with pytest.raises(RuntimeError):
        flatfile.write_tables(*flatfile.normalize(_line(flat, "Z", "O9")), base, load_id="a")
    c, o, fact = _stored(spark, base)
    assert (c.count(), o.count(), fact.count()) == (1, 2, 2)


def test_two_loads_at_once(spark, flat):
    """Both hold customer K; one row counts, and no order line is doubled or lost."""
    from concurrent.futures import ThreadPoolExecutor
    base = tempfile.mkdtemp(prefix="salespark-test-") + "/db"
    jobs = [(_line(flat, "K", f"O{i}", f"name {i}"), f"load{i}") for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda j: flatfile.write_tables(*flatfile.normalize(j[0]), base, load_id=j[1]), jobs))
    c, o, fact = _stored(spark, base)
    assert (c.count(), o.count(), fact.count()) == (1, 4, 4)
    first = loads.commits(spark, base)[0].load_id
    assert c.first().customer_name == "name " + first[-1]


def test_two_attempts_of_one_load_at_once(spark, flat):
    from concurrent.futures import ThreadPoolExecutor
    base = tempfile.mkdtemp(prefix="salespark-test-") + "/db"
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda x: flatfile.write_tables(*flatfile.normalize(_line(flat, "K", x)), base, load_id="same"),
                      ["O1", "O2"]))
    c, o, fact = _stored(spark, base)
    assert (c.count(), o.count(), fact.count()) == (1, 1, 1)


def test_corrected_replay_orphans_nothing(spark, flat):
    """Load a holds K and L, load b an order of K; a comes again without K."""
    base = tempfile.mkdtemp(prefix="salespark-test-") + "/db"
    a = _line(flat, "K", "O1", "from a").unionByName(_line(flat, "L", "O2"))
    flatfile.write_tables(*flatfile.normalize(a), base, load_id="a")
    flatfile.write_tables(*flatfile.normalize(_line(flat, "K", "O3", "from b")), base, load_id="b")
    c, o, _ = _stored(spark, base)
    assert {r.customer_id: r.customer_name for r in c.collect()} == {"K": "from a", "L": "Alice"}
    flatfile.write_tables(*flatfile.normalize(_line(flat, "L", "O2")), base, load_id="a")
    c, o, fact = _stored(spark, base)
    assert {r.order_id for r in fact.collect()} == {"O2", "O3"} and o.count() == 2
    assert {r.customer_id: r.customer_name for r in c.collect()} == {"K": "from b", "L": "Alice"}
    report = constraint_report(c, flatfile.read_tables(spark, base)[1], o)
    assert report.where("rule <> 'not_null'").agg(F.sum("violations")).first()[0] == 0
    assert loads.remove_superseded(spark, base) == 1
    assert _stored(spark, base)[2].count() == 2


def test_null_in_a_declared_column_raises(spark, flat):
    base = tempfile.mkdtemp(prefix="salespark-test-")
    flatfile.write_flat_csv(flat.withColumn("City", F.lit(None).cast("string")), f"{base}/flat")
    with pytest.raises(Exception, match="NULL in customers.city"):
        flatfile.load_csv_to_tables(spark, f"{base}/flat", f"{base}/db")
    assert flatfile.read_tables(spark, f"{base}/db")[2].count() == 0
    c, p, o = flatfile.normalize(flat)
    with pytest.raises(Exception, match="NULL in orders.order_id"):
        flatfile.write_tables(c, p, o.withColumn("order_id", F.lit(None).cast("string")), f"{base}/db")
    flatfile.write_tables(c.withColumn("age", F.lit(None).cast("int")), p, o, f"{base}/db")


def test_point_filters_skip_row_groups(spark):
    """Sorted by customer and with bloom filters, few row groups are read for one customer."""
    from salespark.sources.tables import sales_fact
    base = tempfile.mkdtemp(prefix="salespark-test-") + "/db"
    flat = flatfile.to_flat(sales_fact(spark, "/root/testdata/sf0.01")).withColumn("Order_Date", F.to_date(F.lit("2026-01-05")))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", str(64 * 1024))
    conf.set("parquet.block.size.row.check.min", "100")
    conf.set("parquet.page.size.row.check.min", "100")
    try:
        flatfile.write_tables(*flatfile.normalize(flat), base, load_id="a")
    finally:
        for key in ("parquet.block.size", "parquet.block.size.row.check.min", "parquet.page.size.row.check.min"):
            conf.unset(key)
    orders = flatfile.read_tables(spark, base)[2]
    total = orders.count()
    for column, most in (("customer_id", 0.1), ("product_id", 0.9)):
        value = orders.select(column).first()[0]
        df = orders.where(F.col(column) == value).select("order_id", column)
        df.write.format("noop").mode("overwrite").save()
        want = df.count()
        scan = _scanned(orders.where(F.col(column) == value).select("order_id", column))
        assert want <= scan <= most * total, (column, want, scan, total)


def _scanned(df) -> int:
    """Rows that the scan of a plan gave, by its metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size() or plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_csv_quotes_separators_and_line_breaks(spark, flat):
    base = tempfile.mkdtemp(prefix="salespark-test-")
    odd = flat.withColumns({"Product_Name": F.lit('a "b", c; \\ d'), "Customer_Name": F.lit("  lead, trail  "),
                            "City": F.lit(""), "State": F.lit(None).cast("string"), "Region": F.lit("É 日本")})
    flatfile.write_flat_csv(odd, f"{base}/odd")
    kept = odd.withColumn("City", F.lit(None).cast("string"))  # an empty field is NULL
    assert sorted(map(tuple, flatfile.read_flat_csv(spark, f"{base}/odd").collect())) == sorted(map(tuple, kept.collect()))
    broken = odd.withColumn("Gender", F.lit("one\ntwo"))
    flatfile.write_flat_csv(broken, f"{base}/broken")
    back = flatfile.read_flat_csv(spark, f"{base}/broken", multiline=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, kept.withColumn("Gender", F.lit("one\ntwo")).collect()))
    with pytest.raises(Exception, match="MALFORMED"):
        flatfile.read_flat_csv(spark, f"{base}/broken").collect()


def test_pandas_reads_what_is_written_and_the_reverse(spark, flat):
    import glob
    import pandas as pd
    base = tempfile.mkdtemp(prefix="salespark-test-")
    odd = flat.withColumn("Product_Name", F.lit('a "b", c')).coalesce(1)
    flatfile.write_flat_csv(odd, f"{base}/odd")
    frame = pd.read_csv(glob.glob(f"{base}/odd/*.csv")[0])
    assert frame["Product_Name"].tolist() == ['a "b", c'] * 2 and list(frame.columns) == schema.FLAT.fieldNames()
    frame.to_csv(f"{base}/again.csv", index=False)
    assert sorted(map(tuple, flatfile.read_flat_csv(spark, f"{base}/again.csv").collect())) == sorted(map(tuple, odd.collect()))


@pytest.mark.parametrize("line", ["ORD9,not a date" + ",x" * 24, "ORD9,2026-01-01,2026-01-02,C1"])
def test_malformed_line_raises(spark, flat, line):
    import glob
    base = tempfile.mkdtemp(prefix="salespark-test-")
    flatfile.write_flat_csv(flat.coalesce(1), f"{base}/flat")
    with open(glob.glob(f"{base}/flat/*.csv")[0], "a") as f:
        f.write(line + "\n")
    for crc in glob.glob(f"{base}/flat/.*.crc"):
        import os
        os.remove(crc)
    with pytest.raises(Exception, match="MALFORMED"):
        flatfile.read_flat_csv(spark, f"{base}/flat").collect()


def test_constraint_report_reads_each_table_once(spark, sample_df):
    from salespark.plans.inspect import scan_summaries
    base = tempfile.mkdtemp(prefix="salespark-test-") + "/db"
    flat = flatfile.to_flat(sample_df)
    flatfile.write_tables(*flatfile.normalize(flat), base, load_id="a")
    tables = [spark.read.parquet(f"{base}/{t}") for t in ("customers", "products", "orders")]
    report = constraint_report(*tables)
    report.collect()
    read = sorted(s["Location"].split("/db/")[1].split("]")[0] for s in scan_summaries(report))
    assert read == ["customers", "orders", "products"]


def test_constraint_report_counts_every_kind(spark, sample_df):
    """NULL keys and references, repeated keys, orphans of a hot key."""
    c, p, o = flatfile.normalize(flatfile.to_flat(sample_df))
    one = o.limit(1)
    o = (o.unionByName(one.withColumn("customer_id", F.lit("nobody")).crossJoin(spark.range(500)).drop("id"))
         .unionByName(one.withColumns({"order_id": F.lit(None).cast("string"), "product_id": F.lit(None).cast("string"),
                                       "rating": F.lit(None).cast("int")})))
    c = c.unionByName(c.limit(1)).unionByName(c.limit(1))
    rep = {(r.table_name, r.rule, r.column_name): r.violations for r in constraint_report(c, p, o).collect()}
    assert rep["customers", "primary_key", "customer_id"] == 2
    assert rep["orders", "primary_key", "order_id"] == 501
    assert rep["orders", "foreign_key", "customer_id"] == 500
    assert rep["orders", "foreign_key", "product_id"] == 0
    assert rep["orders", "not_null", "order_id"] == rep["orders", "not_null", "rating"] == 1
    assert len(rep) == 28 + 3 + 2
