"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` on the tables in ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]``.  With ``BENCH_FACT=
materialized`` (the default) the joined fact is first written once as a
month-partitioned parquet table (timed as ``fact_build``) and every query
reads it, as the dashboard does; ``BENCH_FACT=tables`` makes every query
join the raw tables itself, ``BENCH_FACT=trusted`` too but with foreign keys
trusted (joins a query does not need are pruned).  Each query gets one warm-up run, then
``$BENCH_REPS`` (default 5) timed runs; the query time is the median.  Each
run executes the full plan into Spark's ``noop`` sink (nothing is gathered
on the driver) and drops any cache the run created, so no run reads another
run's results.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from salespark.operators.ordered import release_cached  # noqa: E402
from salespark.plans import registry  # noqa: E402
from salespark.plans.dashboard import materialized_fact  # noqa: E402
from salespark.plans.session import build_session  # noqa: E402

HEADLINE = [
    "executive_summary", "trend_monthly", "revenue_by_region", "product_performance",
    "discount_impact", "inventory_recommendation", "rfm_scores", "customer_ltv", "pareto",
    "weekday_month_heatmap", "delivery_box_stats", "sql_monthly_rollup", "forecast_30d",
    "forecast_by_region", "summary_insights", "question_intents",
]

# Timed once more with every query joining the raw tables itself, outside the total.
ALSO_FROM_TABLES = ["executive_summary", "summary_insights", "customer_ltv", "rfm_scores"]


def run_once(spark, key: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    df = registry.QUERIES[key](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    elapsed = time.perf_counter() - t0
    release_cached()
    return elapsed


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "5"))
    keys = [k for k in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if k]
    mode = os.environ.get("BENCH_FACT", "materialized")
    spark = build_session(f"local[{cpus}]", app_name="salespark-bench",
                          shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS",
                                                                max(8, cpus))),
                          extra_conf={"spark.driver.memory": "16g"})
    results = {}
    registry.FACT_SOURCE["mode"] = mode
    if mode == "materialized":
        # timed like a query: one warm-up build, then the median of ``reps``
        builds = []
        for i in range(reps + 1):
            t0 = time.perf_counter()
            materialized_fact(spark, sf_dir, refresh=True)
            builds.append(time.perf_counter() - t0)
        results["fact_build"] = round(statistics.median(builds[1:]), 3)

    def timed(key: str) -> float:
        run_once(spark, key, sf_dir)  # warm-up: JIT, file listing, class loading
        return round(statistics.median(run_once(spark, key, sf_dir) for _ in range(reps)), 3)

    results |= {key: timed(key) for key in keys}
    # the other mode beside it, for comparison: some queries, each joining the raw tables itself
    registry.FACT_SOURCE["mode"] = "tables"
    raw = {key: timed(key) for key in (ALSO_FROM_TABLES if mode == "materialized" else []) if key in keys}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "reps": reps,
        "fact": mode,
        "from_tables": raw,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
