"""Kept sums by load: only new loads are read, and all read-outs equal a full recount."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from salespark.operators import insights, kpi
from salespark.operators.profile import GROUPINGS, sales_profile
from salespark.plans import refresh
from salespark.sources import flatfile, loads
from salespark.sources.tables import fact_from_tables, sales_fact

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def parts(spark):
    flat = flatfile.to_flat(sales_fact(spark, SF_SMALL)).withColumn("__part", F.pmod(F.xxhash64("Order_ID"), F.lit(4)))
    flat = flat.cache()
    yield [flat.where(F.col("__part") == k).drop("__part") for k in range(4)]
    flat.unpersist()


def store(base, part, name):
    flatfile.write_tables(*flatfile.normalize(part), base, load_id=name)


def check(spark, base):
    c, p, o = flatfile.read_tables(spark, base)
    fact = fact_from_tables(o, c, p)
    told, want = refresh.stored_profile(spark, base), sales_profile(fact)
    for name in GROUPINGS:
        assert sorted(map(tuple, told.by(name).collect()), key=repr) == sorted(map(tuple, want.by(name).collect()), key=repr)
    assert kpi.executive_summary(told.fact, profile=told).collect() == kpi.executive_summary(fact).collect()
    assert insights.summary_insights(told.fact, profile=told).collect() == insights.summary_insights(fact).collect()
    assert insights.region_growth(fact, profile=told).collect() == insights.region_growth(fact).collect()


def test_only_new_loads_are_read(spark, parts, monkeypatch):
    base = tempfile.mkdtemp(prefix="salespark-test-") + "/db"
    assert refresh.refresh(spark, base) == [] and refresh.stored_profile(spark, base) is None
    for k in range(3):
        store(base, parts[k], f"l{k}")
    assert refresh.refresh(spark, base) == ["l0", "l1", "l2"]
    check(spark, base)
    assert refresh.refresh(spark, base) == []
    store(base, parts[3], "l3")
    seen = []
    read = loads.read

    def watched(spark_, base_, name, committed=None, without=None):
        seen.append((name, [c.load_id for c in committed or []]))
        return read(spark_, base_, name, committed, without)

    monkeypatch.setattr(loads, "read", watched)
    assert refresh.refresh(spark, base) == ["l3"]
    assert seen == [("orders", ["l3"])]
    monkeypatch.undo()
    check(spark, base)


def test_replayed_load_replaces_its_sums(spark, parts):
    base = tempfile.mkdtemp(prefix="salespark-test-") + "/db"
    store(base, parts[0], "a")
    store(base, parts[1], "b")
    refresh.refresh(spark, base)
    store(base, parts[0].where("Quantity > 10"), "a")
    assert refresh.refresh(spark, base) == ["a"]
    check(spark, base)
