"""Every registered query against its DuckDB oracle on the smallest test tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from salespark.plans import registry

from .conftest import SF_SMALL
from . import oracle_compare
from .oracle_compare import compare, duck

# exact column types and bit-exact values
oracle_compare.EXACT_TYPES = True
oracle_compare.STRICT = True

pytestmark = pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="test tables missing")


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, con, key):
    res = compare(spark, con, SF_SMALL, key, registry.QUERIES[key], registry.ORACLE.get(key))
    assert res["status"] in ("ok", "rows-only"), res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].total_orders > 0


@pytest.mark.parametrize("key", ["rfm_scores", "segment_counts", "pareto", "product_quantiles",
                                 "inventory_recommendation", "repricing_candidates"])
def test_bucketed_path_matches_oracle(spark, con, key, monkeypatch):
    from salespark.operators import ordered
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 37)  # forces many buckets on real data
    res = compare(spark, con, SF_SMALL, key, registry.QUERIES[key], registry.ORACLE.get(key))
    assert res["status"] == "ok", res
    ordered.release_cached()
