"""Registered queries over the driver's test tables, with DuckDB oracle SQL.

``QUERIES[key](spark, sf_dir)`` returns the Spark DataFrame; ``ORACLE[key]``
is the same computation as DuckDB SQL over the raw tables (``lineitem``,
``orders`` ... registered as views).  Keys without an oracle entry get a
row-count check only.  Every query reads the whole given tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (charts, customers, filters, forecast, insights, kpi, products,
                         rollups, trends)
from ..operators.ordered import cache
from ..sources import flatfile, integrity
from ..sources.tables import fact_from_tables, output_frame, read_table, sales_fact
from ..functions.exprs import band_label

# Parameters used by the registered queries on the test tables.  Their
# discounts lie in [0, 0.10], so the discount bands are 2 points wide.
TEST_DISCOUNT_EDGES = [0.0, 0.02, 0.04, 0.06, 0.08, 0.10]
TEST_DATE_RANGE = ("1996-01-01", "1998-12-31")
TEST_SELECTIONS = {"region": ["AMERICA", "EUROPE"], "category": ["ECONOMY", "PROMO", "SMALL"],
                   "city": ["BUILDING", "MACHINERY"], "sub_category": [], "sales_channel": []}
TEST_CUSTOMER_PATTERN = "customer#0000001[0-4]"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


# --------------------------------------------------------------------------
# Oracle building blocks (DuckDB dialect)

FACT_CTE = """fact AS (
  SELECT l.l_orderkey AS order_id,
         CAST(o.o_orderdate AS DATE) AS order_date,
         CAST(l.l_shipdate AS DATE) AS ship_date,
         CAST(l.l_quantity AS INTEGER) AS quantity,
         CAST(l.l_discount AS DECIMAL(4,2)) AS discount,
         CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))
              AS DECIMAL(18,4)) AS revenue,
         CAST(CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))
                   AS DECIMAL(18,4))
              - CAST(l.l_quantity AS INTEGER) * CAST(p.p_retailprice AS DECIMAL(12,2))
              AS DECIMAL(18,4)) AS profit,
         o.o_orderpriority AS sales_channel,
         o.o_orderstatus AS payment_method,
         CASE WHEN l.l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS returned,
         CAST(datediff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS INTEGER)
              AS delivery_time,
         1 + CAST(l.l_quantity AS INTEGER) % 5 AS rating,
         c.c_custkey AS customer_id,
         c.c_name AS customer_name,
         CAST(NULL AS INTEGER) AS age,
         CAST(NULL AS VARCHAR) AS gender,
         c.c_mktsegment AS city,
         n.n_name AS state,
         r.r_name AS region,
         CAST(NULL AS VARCHAR) AS country,
         p.p_partkey AS product_id,
         p.p_type AS category,
         p.p_brand AS sub_category,
         p.p_name AS product_name,
         CASE WHEN CAST(l.l_quantity AS BIGINT) > 0 THEN CAST(CAST(
              (CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) * 2 + CAST(l.l_quantity AS BIGINT))
              // (2 * CAST(l.l_quantity AS BIGINT)) AS DECIMAL(14,0)) * 0.01 AS DECIMAL(12,2)) END AS unit_price,
         CAST(p.p_retailprice AS DECIMAL(12,2)) AS cost
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

FACT_OUT_COLUMNS = """order_id, order_date, ship_date, quantity, CAST(discount AS DOUBLE) AS discount,
  CAST(revenue AS DOUBLE) AS revenue, CAST(profit AS DOUBLE) AS profit, sales_channel,
  payment_method, returned, delivery_time, rating, customer_id, customer_name, age, gender, city,
  state, region, country, product_id, category, sub_category, product_name,
  CAST(unit_price AS DOUBLE) AS unit_price, CAST(cost AS DOUBLE) AS cost"""


def with_fact(*ctes: str) -> str:
    return "WITH " + ",\n".join((FACT_CTE,) + ctes) + "\n"


def pct_sql(num: str, den: str, digits: int = 1) -> str:
    return f"round(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0) * 100, {digits})"


def band_case_sql(col: str, edges: list[float]) -> str:
    parts = []
    for i in range(len(edges) - 1):
        lo, hi = repr(float(edges[i])), repr(float(edges[i + 1]))
        lower = f"{col} >= {lo}" if i == 0 else f"{col} > {lo}"
        parts.append(f"WHEN {lower} AND {col} <= {hi} THEN {i}")
    return "CASE " + " ".join(parts) + " END"


def band_label_sql(idx: str, edges: list[float]) -> str:
    parts = [f"WHEN {i} THEN '{band_label(edges[i], edges[i + 1])}'" for i in range(len(edges) - 1)]
    return f"CASE {idx} " + " ".join(parts) + " END"


def quintile_sql(rank: str, n: str) -> str:
    return (f"CAST(CASE WHEN {n} <= 1 THEN 1 ELSE greatest(1, (5 * ({rank} - 1) + {n} - 2) "
            f"// ({n} - 1)) END AS INTEGER)")


# "tables": every query joins the raw tables itself (the default, and what the
# oracle check runs).  "trusted": the same with foreign keys trusted, so unused
# dimension joins are pruned.  "materialized": queries read the fact written
# once per session (``dashboard.materialized_fact``), as a deployment would.
FACT_SOURCE = {"mode": "tables"}


def fact(spark: SparkSession, sf_dir: str, read_again: bool = False) -> DataFrame:
    if FACT_SOURCE["mode"] == "materialized":
        from .dashboard import materialized_fact
        return materialized_fact(spark, sf_dir)
    return sales_fact(spark, sf_dir, FACT_SOURCE["mode"] == "trusted", read_again)


def out(df: DataFrame) -> DataFrame:
    return output_frame(df)


# --------------------------------------------------------------------------
# Sources, ETL, integrity

@register("sales_fact", with_fact() + f"SELECT {FACT_OUT_COLUMNS} FROM fact")
def q_sales_fact(spark, sf_dir):
    return out(fact(spark, sf_dir))


@register("extract_customers", with_fact("""r AS (
  SELECT customer_id, customer_name, age, gender, city, state, region, country,
         row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id, customer_name,
                            age, gender, city, state, region, country) AS rn
  FROM fact WHERE customer_id IS NOT NULL)""") +
    "SELECT customer_id, customer_name, age, gender, city, state, region, country FROM r WHERE rn = 1")
def q_extract_customers(spark, sf_dir):
    return out(flatfile.extract_customers(flatfile.to_flat(fact(spark, sf_dir))))


@register("extract_products", with_fact("""r AS (
  SELECT product_id, category, sub_category, product_name, unit_price, cost,
         row_number() OVER (PARTITION BY product_id ORDER BY order_date, order_id, category,
                            sub_category, product_name, unit_price, cost) AS rn
  FROM fact WHERE product_id IS NOT NULL)""") +
    """SELECT product_id, category, sub_category, product_name, CAST(unit_price AS DOUBLE) AS unit_price,
  CAST(cost AS DOUBLE) AS cost FROM r WHERE rn = 1""")
def q_extract_products(spark, sf_dir):
    return out(flatfile.extract_products(flatfile.to_flat(fact(spark, sf_dir))))


@register("extract_orders", with_fact() + """SELECT order_id, strftime(order_date, '%Y-%m-%d') AS order_date,
  strftime(ship_date, '%Y-%m-%d') AS ship_date, customer_id, product_id, quantity,
  CAST(discount AS DOUBLE) AS discount, CAST(revenue AS DOUBLE) AS revenue,
  CAST(profit AS DOUBLE) AS profit, sales_channel, payment_method, returned, delivery_time, rating
FROM fact""")
def q_extract_orders(spark, sf_dir):
    return out(flatfile.extract_orders(flatfile.to_flat(fact(spark, sf_dir))))


@register("order_measures", with_fact() + """SELECT order_id, product_id,
  CAST(round(quantity * unit_price * (1 - discount), 2) AS DOUBLE) AS revenue_calc,
  CAST(round(round(quantity * unit_price * (1 - discount), 2) - quantity * cost, 2) AS DOUBLE) AS profit_calc,
  CAST(datediff('day', order_date, ship_date) AS INTEGER) AS delivery_days
FROM fact""")
def q_order_measures(spark, sf_dir):
    m = flatfile.order_measures(fact(spark, sf_dir))
    return out(m.select("order_id", "product_id", "revenue_calc", "profit_calc", "delivery_days"))


@register("normalized_fact", with_fact("""c AS (
  SELECT * FROM (SELECT customer_id, customer_name, age, gender, city, state, region, country,
         row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id, customer_name,
                            age, gender, city, state, region, country) AS rn
  FROM fact WHERE customer_id IS NOT NULL) WHERE rn = 1)""", """p AS (
  SELECT * FROM (SELECT product_id, category, sub_category, product_name, unit_price, cost,
         row_number() OVER (PARTITION BY product_id ORDER BY order_date, order_id, category,
                            sub_category, product_name, unit_price, cost) AS rn
  FROM fact WHERE product_id IS NOT NULL) WHERE rn = 1)""") + """SELECT f.order_id, f.order_date, f.ship_date,
  f.quantity, CAST(f.discount AS DOUBLE) AS discount, CAST(f.revenue AS DOUBLE) AS revenue,
  CAST(f.profit AS DOUBLE) AS profit, f.sales_channel, f.payment_method, f.returned, f.delivery_time, f.rating,
  c.customer_id, c.customer_name, c.age, c.gender, c.city, c.state, c.region, c.country, p.product_id,
  p.category, p.sub_category, p.product_name, CAST(p.unit_price AS DOUBLE) AS unit_price,
  CAST(p.cost AS DOUBLE) AS cost
FROM fact f JOIN c ON f.customer_id = c.customer_id JOIN p ON f.product_id = p.product_id""")
def q_normalized_fact(spark, sf_dir):
    c, p, o = flatfile.normalize(flatfile.to_flat(fact(spark, sf_dir, read_again=True)))
    return out(fact_from_tables(flatfile.typed_orders(o), c, p))


def _constraint_sql() -> str:
    cust_cols = ["customer_id", "customer_name", "age", "gender", "city", "state", "region",
                 "country"]
    prod_cols = ["product_id", "category", "sub_category", "product_name", "unit_price", "cost"]
    ord_cols = ["order_id", "order_date", "ship_date", "customer_id", "product_id", "quantity",
                "discount", "revenue", "profit", "sales_channel", "payment_method", "returned",
                "delivery_time", "rating"]
    ctes = [
        """cr AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id,
             customer_name, age, gender, city, state, region, country) AS rn FROM fact
             WHERE customer_id IS NOT NULL)""",
        "customers AS (SELECT * FROM cr WHERE rn = 1)",
        """pr AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY order_date, order_id,
             category, sub_category, product_name, unit_price, cost) AS rn FROM fact
             WHERE product_id IS NOT NULL)""",
        "products AS (SELECT * FROM pr WHERE rn = 1)",
    ]
    parts = []
    for table, cols, key in (("customers", cust_cols, "customer_id"),
                             ("products", prod_cols, "product_id"),
                             ("orders", ord_cols, "order_id")):
        src = "fact" if table == "orders" else table
        for c in cols:
            parts.append(f"SELECT '{table}' AS table_name, 'not_null' AS rule, '{c}' AS column_name, "
                         f"CAST(count_if({c} IS NULL) AS BIGINT) AS violations FROM {src}")
        parts.append(f"SELECT '{table}', 'primary_key', '{key}', "
                     f"CAST(count(*) - count(DISTINCT {key}) AS BIGINT) FROM {src}")
    parts.append("SELECT 'orders', 'foreign_key', 'customer_id', CAST(count(*) AS BIGINT) FROM fact f "
                 "WHERE f.customer_id IS NOT NULL AND NOT EXISTS "
                 "(SELECT 1 FROM customers c WHERE c.customer_id = f.customer_id)")
    parts.append("SELECT 'orders', 'foreign_key', 'product_id', CAST(count(*) AS BIGINT) FROM fact f "
                 "WHERE f.product_id IS NOT NULL AND NOT EXISTS "
                 "(SELECT 1 FROM products p WHERE p.product_id = f.product_id)")
    return with_fact(*ctes) + "\nUNION ALL\n".join(parts)


@register("constraint_report", _constraint_sql())
def q_constraint_report(spark, sf_dir):
    flat = flatfile.to_flat(fact(spark, sf_dir))
    c, p, o = flatfile.normalize(flat)
    # ``orders`` keeps typed dates for the check
    o = flatfile.to_snake_case(flat).select(*[x for x in o.columns])
    return integrity.constraint_report(c, p, o)


# The keys that ``sales_fact`` joins on, in the raw tables.
RAW_FOREIGN_KEYS = [("lineitem", "l_orderkey", "orders", "o_orderkey"),
                    ("lineitem", "l_partkey", "part", "p_partkey"),
                    ("orders", "o_custkey", "customer", "c_custkey"),
                    ("customer", "c_nationkey", "nation", "n_nationkey"),
                    ("nation", "n_regionkey", "region", "r_regionkey")]


@register("raw_foreign_keys", "\nUNION ALL\n".join(
    f"SELECT '{child}' AS table_name, '{fk}' AS column_name, '{parent}' AS parent, "
    f"(SELECT count(*) FROM {child} WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {key} FROM {parent} "
    f"WHERE {key} IS NOT NULL)) AS orphans, count({key}) - count(DISTINCT {key}) AS repeated_keys FROM {parent}"
    for child, fk, parent, key in RAW_FOREIGN_KEYS))
def q_raw_foreign_keys(spark, sf_dir):
    names = {n for child, _, parent, _ in RAW_FOREIGN_KEYS for n in (child, parent)}
    return integrity.foreign_key_report({n: read_table(spark, sf_dir, n) for n in names}, RAW_FOREIGN_KEYS)


# --------------------------------------------------------------------------
# Filters

@register("filter_date_range", with_fact() + f"SELECT {FACT_OUT_COLUMNS} FROM fact "
          f"WHERE order_date >= DATE '{TEST_DATE_RANGE[0]}' AND order_date <= DATE '{TEST_DATE_RANGE[1]}'")
def q_filter_date_range(spark, sf_dir):
    return out(filters.filter_date_range(fact(spark, sf_dir), *TEST_DATE_RANGE))


def _in_sql(col: str, values: list[str]) -> str:
    return f"{col} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


@register("filter_multi_select", with_fact() + f"SELECT {FACT_OUT_COLUMNS} FROM fact WHERE " +
          " AND ".join(_in_sql(c, v) for c, v in TEST_SELECTIONS.items() if v))
def q_filter_multi_select(spark, sf_dir):
    return out(filters.filter_multi_select(fact(spark, sf_dir), TEST_SELECTIONS))


@register("filter_customer_search", with_fact() + f"SELECT {FACT_OUT_COLUMNS} FROM fact "
          f"WHERE coalesce(regexp_matches(customer_name, '{TEST_CUSTOMER_PATTERN}', 'i'), false)")
def q_filter_customer_search(spark, sf_dir):
    return out(filters.filter_customer_search(fact(spark, sf_dir), TEST_CUSTOMER_PATTERN))


@register("filter_options", with_fact() + "SELECT DISTINCT field, value FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM fact"
    for c in filters.MULTI_SELECT_FIELDS) + ") WHERE value IS NOT NULL")
def q_filter_options(spark, sf_dir):
    return filters.filter_options(fact(spark, sf_dir))


@register("filter_match_count", with_fact() + f"""SELECT
  CAST(count_if(order_date >= DATE '{TEST_DATE_RANGE[0]}' AND order_date <= DATE '{TEST_DATE_RANGE[1]}'
           AND {' AND '.join(_in_sql(c, v) for c, v in TEST_SELECTIONS.items() if v)}
           AND coalesce(regexp_matches(customer_name, 'customer#000000', 'i'), false)) AS BIGINT)
  AS matched_rows,
  count(*) AS total_rows, min(order_date) AS min_date, max(order_date) AS max_date
FROM fact""")
def q_filter_match_count(spark, sf_dir):
    f = filters.Filters(start=TEST_DATE_RANGE[0], end=TEST_DATE_RANGE[1],
                        selections=TEST_SELECTIONS, customer_search="customer#000000")
    return filters.filter_match_count(fact(spark, sf_dir), f)


# --------------------------------------------------------------------------
# KPIs

DAILY_HALVES_CTES = (
    "daily AS (SELECT order_date, sum(revenue) AS revenue FROM fact WHERE order_date IS NOT NULL "
    "GROUP BY order_date)",
    "b AS (SELECT min(order_date) AS lo, max(order_date) AS hi FROM daily)",
    """h AS (SELECT
        coalesce(sum(CASE WHEN 2 * datediff('day', b.lo, d.order_date) < datediff('day', b.lo, b.hi)
                          THEN d.revenue END), 0) AS first_half,
        coalesce(sum(CASE WHEN 2 * datediff('day', b.lo, d.order_date) >= datediff('day', b.lo, b.hi)
                          THEN d.revenue END), 0) AS second_half,
        min(d.order_date) AS start_date, max(d.order_date) AS end_date
      FROM daily d, b)""",
    """g AS (SELECT start_date, end_date, first_half, second_half,
        CASE WHEN start_date IS NULL OR start_date = end_date OR first_half = 0 THEN NULL
             ELSE round(CAST(second_half - first_half AS DOUBLE) / CAST(first_half AS DOUBLE) * 100, 1)
        END AS revenue_growth_pct FROM h)""",
)


@register("period_growth", with_fact(*DAILY_HALVES_CTES) + """SELECT start_date, end_date,
  CAST(round(first_half, 2) AS DOUBLE) AS first_half_revenue,
  CAST(round(second_half, 2) AS DOUBLE) AS second_half_revenue, revenue_growth_pct FROM g""")
def q_period_growth(spark, sf_dir):
    return kpi.period_growth(fact(spark, sf_dir))


EXEC_SUMMARY_SQL = with_fact(*DAILY_HALVES_CTES, """t AS (SELECT coalesce(sum(revenue), 0) AS rev,
    coalesce(sum(profit), 0) AS prof, count(DISTINCT order_id) AS orders,
    count(DISTINCT customer_id) AS customers, count_if(returned = 'Yes') AS ret, count(*) AS n FROM fact)""",
    """s AS (SELECT CAST(round(rev, 2) AS DOUBLE) AS total_revenue,
  CAST(round(prof, 2) AS DOUBLE) AS total_profit, orders AS total_orders, customers AS total_customers,
  CASE WHEN orders > 0 THEN round(CAST(rev AS DOUBLE) / orders, 2) ELSE 0.0 END AS average_order_value,
  CASE WHEN rev <> 0 THEN round(CAST(prof AS DOUBLE) / CAST(rev AS DOUBLE) * 100, 1) ELSE 0.0 END
       AS profit_margin_pct,
  CASE WHEN n > 0 THEN round(ret / n * 100, 1) ELSE 0.0 END AS return_rate_pct,
  g.revenue_growth_pct FROM t, g)""")


@register("executive_summary", EXEC_SUMMARY_SQL + "SELECT * FROM s")
def q_executive_summary(spark, sf_dir):
    return kpi.executive_summary(fact(spark, sf_dir))


# --------------------------------------------------------------------------
# Trends

def _trend_sql(freq: str) -> str:
    bucket = {"D": "order_date",
              "W": "CAST(order_date + CAST(7 - isodow(order_date) AS INTEGER) AS DATE)",
              "ME": "last_day(order_date)"}[freq]
    if freq == "ME":
        spine = ("spine AS (SELECT last_day(CAST(m AS DATE)) AS order_date FROM (SELECT unnest("
                 "generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH))"
                 " AS m FROM bounds))")
    else:
        step = "INTERVAL 1 DAY" if freq == "D" else "INTERVAL 7 DAY"
        spine = (f"spine AS (SELECT CAST(unnest(generate_series(lo, hi, {step})) AS DATE) AS order_date "
                 "FROM bounds)")
    return with_fact(
        f"agg AS (SELECT {bucket} AS bk, sum(revenue) AS revenue, sum(profit) AS profit, "
        "count(DISTINCT order_id) AS orders FROM fact WHERE order_date IS NOT NULL GROUP BY 1)",
        "bounds AS (SELECT min(bk) AS lo, max(bk) AS hi FROM agg)", spine) + f"""SELECT s.order_date,
  CAST(round(coalesce(a.revenue, 0), 2) AS DOUBLE) AS revenue,
  CAST(round(coalesce(a.profit, 0), 2) AS DOUBLE) AS profit,
  CAST(coalesce(a.orders, 0) AS BIGINT) AS orders,
  CASE WHEN coalesce(a.revenue, 0) <> 0 THEN {pct_sql('coalesce(a.profit, 0)', 'coalesce(a.revenue, 0)')}
  END AS margin_pct
FROM spine s LEFT JOIN agg a ON s.order_date = a.bk"""


for _key, _freq in (("trend_daily", "D"), ("trend_weekly", "W"), ("trend_monthly", "ME")):
    def _mk(freq):
        return lambda spark, sf_dir: trends.revenue_profit_trend(fact(spark, sf_dir), freq)
    register(_key, _trend_sql(_freq))(_mk(_freq))


def _by_dim_ctes(dim: str, g: str = "g", t: str = "t") -> tuple[str, str]:
    return (f"{g} AS (SELECT {dim}, sum(revenue) AS revenue, sum(profit) AS profit, "
            f"count(DISTINCT order_id) AS orders FROM fact WHERE {dim} IS NOT NULL GROUP BY {dim})",
            f"{t} AS (SELECT sum(revenue) AS total FROM {g})")


def _by_dim_select(dim: str) -> str:
    return f"""SELECT {dim},
  CAST(round(revenue, 2) AS DOUBLE) AS revenue, CAST(round(profit, 2) AS DOUBLE) AS profit, orders,
  CASE WHEN total <> 0 THEN {pct_sql('revenue', 'total')} ELSE 0.0 END AS revenue_share_pct
FROM g, t"""


def _by_dim_sql(dim: str) -> str:
    return with_fact(*_by_dim_ctes(dim)) + _by_dim_select(dim)


for _key, _dim in (("revenue_by_region", "region"), ("revenue_by_state", "state"),
                   ("revenue_by_category", "category")):
    def _mk(dim):
        return lambda spark, sf_dir: trends.revenue_by_dimension(fact(spark, sf_dir), dim)
    register(_key, _by_dim_sql(_dim))(_mk(_dim))


PARETO_CTES = (
    "g AS (SELECT product_name, coalesce(sum(revenue), 0) AS revenue FROM fact "
    "WHERE product_name IS NOT NULL GROUP BY product_name)",
    "t AS (SELECT sum(revenue) AS total FROM g)",
    """r AS (SELECT product_name, revenue,
        row_number() OVER (ORDER BY revenue DESC, product_name) AS position,
        sum(revenue) OVER (ORDER BY revenue DESC, product_name ROWS BETWEEN UNBOUNDED PRECEDING
                           AND CURRENT ROW) AS cumulative FROM g)""",
)
PARETO_SELECT = f"""SELECT CAST(position AS BIGINT) AS position, product_name,
  CAST(round(revenue, 2) AS DOUBLE) AS revenue, CAST(round(cumulative, 2) AS DOUBLE) AS cumulative,
  CASE WHEN total <> 0 THEN {pct_sql('cumulative', 'total')} ELSE 0.0 END AS cumulative_pct
FROM r, t"""


@register("pareto", with_fact(*PARETO_CTES) + PARETO_SELECT)
def q_pareto(spark, sf_dir):
    return trends.pareto_analysis(fact(spark, sf_dir), "product_name", "revenue")


@register("pareto_top20", with_fact(*PARETO_CTES) + PARETO_SELECT + " WHERE position <= 20")
def q_pareto_top20(spark, sf_dir):
    return trends.pareto_top(fact(spark, sf_dir), "product_name", "revenue", 20)


# --------------------------------------------------------------------------
# Products

PERF_CTE = f"""perf AS (SELECT product_id, product_name, category, sub_category,
  CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue, CAST(round(sum(profit), 2) AS DOUBLE) AS profit,
  CAST(sum(quantity) AS BIGINT) AS units_sold, count(DISTINCT order_id) AS orders,
  round(avg(rating), 2) AS avg_rating,
  {pct_sql("count_if(returned = 'Yes')", 'count(*)')} AS return_rate_pct,
  CASE WHEN sum(revenue) <> 0 THEN {pct_sql('sum(profit)', 'sum(revenue)')} END AS margin_pct
FROM fact WHERE product_id IS NOT NULL AND product_name IS NOT NULL AND category IS NOT NULL
  AND sub_category IS NOT NULL GROUP BY product_id, product_name, category, sub_category)"""


@register("product_performance", with_fact(PERF_CTE) + "SELECT * FROM perf")
def q_product_performance(spark, sf_dir):
    return products.product_performance(fact(spark, sf_dir))


@register("top_products", with_fact(PERF_CTE) +
          "SELECT * FROM perf ORDER BY revenue DESC NULLS LAST, revenue DESC, product_id LIMIT 10")
def q_top_products(spark, sf_dir):
    return products.top_products(fact(spark, sf_dir), 10, "revenue")


@register("worst_products", with_fact(PERF_CTE) +
          "SELECT * FROM perf ORDER BY profit ASC NULLS LAST, revenue DESC, product_id LIMIT 10")
def q_worst_products(spark, sf_dir):
    return products.worst_products(fact(spark, sf_dir), 10, "profit")


@register("category_contribution", with_fact() + f"""SELECT category, sub_category,
  CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue, CAST(round(sum(profit), 2) AS DOUBLE) AS profit,
  {pct_sql('sum(profit)', 'sum(revenue)')} AS margin_pct
FROM fact WHERE category IS NOT NULL AND sub_category IS NOT NULL GROUP BY category, sub_category""")
def q_category_contribution(spark, sf_dir):
    return products.category_contribution(fact(spark, sf_dir))


@register("category_rollup", with_fact(f"""g AS (SELECT category, sub_category,
  CAST(GROUPING(category, sub_category) AS INTEGER) AS level,
  sum(revenue) AS rev, sum(profit) AS prof
FROM fact WHERE category IS NOT NULL AND sub_category IS NOT NULL
GROUP BY ROLLUP (category, sub_category))""") + f"""SELECT category, sub_category, level,
  CAST(round(rev, 2) AS DOUBLE) AS revenue, CAST(round(prof, 2) AS DOUBLE) AS profit,
  {pct_sql('prof', 'rev')} AS margin_pct FROM g WHERE level < 3""")
def q_category_rollup(spark, sf_dir):
    return products.category_rollup(fact(spark, sf_dir))


def _bands_cte(edges: list[float]) -> str:
    return f"""bands AS (SELECT b AS band_idx, {band_label_sql('b', edges)} AS discount_band,
  CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue, CAST(round(sum(profit), 2) AS DOUBLE) AS profit,
  count(DISTINCT order_id) AS orders, {pct_sql('sum(profit)', 'sum(revenue)')} AS margin_pct,
  CAST(sum(profit) AS DOUBLE) / nullif(CAST(sum(revenue) AS DOUBLE), 0) AS margin
FROM (SELECT *, {band_case_sql('discount', edges)} AS b FROM fact) WHERE b IS NOT NULL GROUP BY b)"""


@register("discount_impact", with_fact(_bands_cte(TEST_DISCOUNT_EDGES)) +
          "SELECT CAST(band_idx AS INTEGER) AS band_idx, discount_band, revenue, profit, orders, "
          "margin_pct FROM bands")
def q_discount_impact(spark, sf_dir):
    return products.discount_impact(fact(spark, sf_dir), TEST_DISCOUNT_EDGES)


QUANTILE_CTES = (
    PERF_CTE,
    """qs AS (SELECT
  quantile_cont(CAST(units_sold AS DOUBLE), 0.33) AS units_q33,
  quantile_cont(CAST(units_sold AS DOUBLE), 0.66) AS units_q66,
  quantile_cont(margin_pct, 0.33) AS margin_q33,
  quantile_cont(margin_pct, 0.66) AS margin_q66 FROM perf)""",
    """pq AS (SELECT quantile_cont(revenue, 0.75) AS revenue_q75,
  quantile_cont(margin_pct, 0.5) AS priced_margin_median FROM perf WHERE revenue > 0)""",
)

# Unrounded sums per product, for the rules that compare or rank.
RAW_CTE = """raw AS (SELECT product_id, product_name, category, sub_category, sum(revenue) AS rev,
  sum(profit) AS prof FROM fact WHERE product_id IS NOT NULL AND product_name IS NOT NULL
  AND category IS NOT NULL AND sub_category IS NOT NULL
  GROUP BY product_id, product_name, category, sub_category)"""


@register("product_quantiles", with_fact(*QUANTILE_CTES) + "SELECT * FROM qs, pq")
def q_product_quantiles(spark, sf_dir):
    return products.product_quantiles(products.product_performance(fact(spark, sf_dir)))


INVENTORY_CTE = """inv AS (SELECT perf.*, CASE
  WHEN coalesce(units_sold >= units_q66, false) AND NOT coalesce(margin_pct <= margin_q33, false)
       THEN 'Restock'
  WHEN coalesce(units_sold <= units_q33, false) AND coalesce(margin_pct <= margin_q33, false)
       THEN 'Discontinue'
  ELSE 'Hold' END AS recommendation FROM perf, qs)"""


@register("inventory_recommendation", with_fact(*QUANTILE_CTES, INVENTORY_CTE) + "SELECT * FROM inv")
def q_inventory_recommendation(spark, sf_dir):
    return products.inventory_recommendation(fact(spark, sf_dir))


@register("inventory_view", with_fact(*QUANTILE_CTES, INVENTORY_CTE) +
          "SELECT product_name, category, units_sold, margin_pct, recommendation FROM inv")
def q_inventory_view(spark, sf_dir):
    return products.inventory_view(products.inventory_recommendation(fact(spark, sf_dir)))


@register("inventory_counts", with_fact(*QUANTILE_CTES, INVENTORY_CTE) +
          "SELECT recommendation, count(*) AS products FROM inv GROUP BY recommendation")
def q_inventory_counts(spark, sf_dir):
    return products.inventory_counts(products.inventory_recommendation(fact(spark, sf_dir)))


REPRICING_CTE = RAW_CTE + """,
rq AS (SELECT quantile_cont(CAST(rev AS DOUBLE), 0.75) AS q75 FROM raw WHERE rev > 0),
rep AS (SELECT perf.* FROM perf JOIN raw USING (product_id, product_name, category, sub_category), pq, rq
  WHERE raw.rev > 0 AND CAST(raw.rev AS DOUBLE) >= rq.q75 AND perf.margin_pct < pq.priced_margin_median)"""


@register("repricing_candidates", with_fact(*QUANTILE_CTES, REPRICING_CTE) + "SELECT * FROM rep")
def q_repricing_candidates(spark, sf_dir):
    return products.repricing_candidates(fact(spark, sf_dir))


@register("unprofitable_products", with_fact(RAW_CTE) +
          "SELECT CAST(count_if(prof < 0) AS BIGINT) AS unprofitable_products FROM raw")
def q_unprofitable_products(spark, sf_dir):
    return products.unprofitable_products(fact(spark, sf_dir))


# --------------------------------------------------------------------------
# Customers

RFM_BASE_CTES = (
    "dated AS (SELECT * FROM fact WHERE customer_id IS NOT NULL AND order_date IS NOT NULL)",
    "ref AS (SELECT max(order_date) AS ref_date FROM dated)",
    """base AS (SELECT customer_id, min(customer_name) AS customer_name,
  max(order_date) AS last_order_date, count(DISTINCT order_id) AS frequency, sum(revenue) AS monetary
FROM dated GROUP BY customer_id)""",
    """rb AS (SELECT base.*, CAST(datediff('day', last_order_date, ref_date) AS INTEGER) AS recency_days
FROM base, ref)""",
)

RFM_CTES = RFM_BASE_CTES + (
    f"""ranked AS (SELECT rb.*, count(*) OVER () AS n,
  row_number() OVER (ORDER BY recency_days, customer_id) AS r_rank,
  row_number() OVER (ORDER BY frequency, customer_id) AS f_rank,
  row_number() OVER (ORDER BY monetary, customer_id) AS m_rank FROM rb)""",
    f"""scored AS (SELECT customer_id, customer_name, last_order_date, frequency, monetary, recency_days,
  CAST(6 - {quintile_sql('r_rank', 'n')} AS INTEGER) AS r_score,
  {quintile_sql('f_rank', 'n')} AS f_score, {quintile_sql('m_rank', 'n')} AS m_score FROM ranked)""",
    """rfm AS (SELECT *, r_score + f_score + m_score AS rfm_score, CASE
  WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
  WHEN r_score >= 3 AND f_score >= 3 THEN 'Loyal customers'
  WHEN r_score >= 4 AND f_score <= 2 THEN 'New customers'
  WHEN r_score <= 2 AND f_score >= 4 THEN 'At risk'
  WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Lost'
  ELSE 'Needs attention' END AS segment FROM scored)""",
)


@register("rfm_base", with_fact(*RFM_BASE_CTES) + """SELECT customer_id, customer_name, last_order_date,
  frequency, CAST(monetary AS DOUBLE) AS monetary, recency_days FROM rb""")
def q_rfm_base(spark, sf_dir):
    return out(customers.rfm_base(fact(spark, sf_dir)))


@register("rfm_scores", with_fact(*RFM_CTES) + """SELECT customer_id, customer_name, last_order_date,
  frequency, CAST(monetary AS DOUBLE) AS monetary, recency_days, r_score, f_score, m_score, rfm_score,
  segment FROM rfm""")
def q_rfm_scores(spark, sf_dir):
    return out(customers.compute_rfm(fact(spark, sf_dir)))


@register("segment_summary", with_fact(*RFM_CTES) + """SELECT segment,
  count(DISTINCT customer_id) AS customers, CAST(sum(monetary) AS DOUBLE) AS total_monetary
FROM rfm GROUP BY segment""")
def q_segment_summary(spark, sf_dir):
    return out(customers.segment_summary(customers.compute_rfm(fact(spark, sf_dir))))


@register("segment_counts", with_fact(*RFM_CTES) +
          "SELECT segment, count(*) AS customers FROM rfm GROUP BY segment")
def q_segment_counts(spark, sf_dir):
    return customers.segment_counts(customers.compute_rfm(fact(spark, sf_dir)))


@register("customers_to_target", with_fact(*RFM_CTES) +
          "SELECT CAST(count_if(segment = 'Champions') AS BIGINT) AS champions, "
          "CAST(count_if(segment = 'At risk') AS BIGINT) AS at_risk FROM rfm")
def q_customers_to_target(spark, sf_dir):
    return customers.customers_to_target(customers.compute_rfm(fact(spark, sf_dir)))


CHURN_CTE = """churn AS (SELECT customer_id, last_order_date, recency_days, CASE
  WHEN recency_days > -1 AND recency_days <= 30 THEN 'Low'
  WHEN recency_days > 30 AND recency_days <= 90 THEN 'Medium'
  WHEN recency_days > 90 AND recency_days <= 10000 THEN 'High' END AS churn_risk FROM rb)"""


@register("churn_risk", with_fact(*RFM_BASE_CTES, CHURN_CTE) + "SELECT * FROM churn")
def q_churn_risk(spark, sf_dir):
    return customers.churn_risk(fact(spark, sf_dir))


@register("churn_counts", with_fact(*RFM_BASE_CTES, CHURN_CTE) +
          "SELECT churn_risk, count(*) AS customers FROM churn WHERE churn_risk IS NOT NULL "
          "GROUP BY churn_risk")
def q_churn_counts(spark, sf_dir):
    return customers.churn_counts(customers.churn_risk(fact(spark, sf_dir)))


CLV_CTE = """clv AS (SELECT customer_id, min(customer_name) AS customer_name,
  CAST(round(sum(revenue), 2) AS DOUBLE) AS lifetime_revenue,
  CAST(round(sum(profit), 2) AS DOUBLE) AS lifetime_profit, count(DISTINCT order_id) AS orders,
  round(CAST(sum(revenue) AS DOUBLE) / count(DISTINCT order_id), 2) AS avg_order_value
FROM fact WHERE customer_id IS NOT NULL GROUP BY customer_id)"""


@register("customer_ltv", with_fact(CLV_CTE) + "SELECT * FROM clv")
def q_customer_ltv(spark, sf_dir):
    return customers.customer_lifetime_value(fact(spark, sf_dir))


@register("top_customers", with_fact(CLV_CTE) +
          "SELECT * FROM clv ORDER BY lifetime_profit DESC, customer_id LIMIT 20")
def q_top_customers(spark, sf_dir):
    return customers.top_customers(fact(spark, sf_dir), 20)


@register("repeat_rate", with_fact(
    "pc AS (SELECT customer_id, count(DISTINCT order_id) AS orders FROM fact "
    "WHERE customer_id IS NOT NULL GROUP BY customer_id)") +
    f"SELECT CASE WHEN count(*) > 0 THEN {pct_sql('count_if(orders > 1)', 'count(*)')} ELSE 0.0 END "
    "AS repeat_rate_pct FROM pc")
def q_repeat_rate(spark, sf_dir):
    return customers.repeat_customer_rate(fact(spark, sf_dir))


# --------------------------------------------------------------------------
# SQL rollups

@register("sql_region_rollup", with_fact() + """SELECT region,
  CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue, CAST(round(sum(profit), 2) AS DOUBLE) AS profit,
  count(*) AS orders FROM fact GROUP BY region""")
def q_sql_region_rollup(spark, sf_dir):
    return rollups.region_rollup(fact(spark, sf_dir))


@register("sql_top_products", with_fact() + """SELECT product_name, category, revenue, profit, units_sold
FROM (SELECT product_id, product_name, category, CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue,
  CAST(round(sum(profit), 2) AS DOUBLE) AS profit, CAST(sum(quantity) AS BIGINT) AS units_sold
  FROM fact GROUP BY product_id, product_name, category)
ORDER BY revenue DESC, product_id LIMIT 10""")
def q_sql_top_products(spark, sf_dir):
    return rollups.top_products_rollup(fact(spark, sf_dir), 10, "revenue")


@register("sql_monthly_rollup", with_fact() + """SELECT strftime(order_date, '%Y-%m') AS month,
  CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue, CAST(round(sum(profit), 2) AS DOUBLE) AS profit,
  count(*) AS orders FROM fact GROUP BY 1""")
def q_sql_monthly_rollup(spark, sf_dir):
    return rollups.monthly_rollup(fact(spark, sf_dir))


@register("sql_return_rate", with_fact() + """SELECT category,
  round(CAST(100.0 AS DOUBLE) * sum(CASE WHEN returned = 'Yes' THEN 1 ELSE 0 END) / count(*), 1)
  AS return_rate_pct, count(*) AS orders FROM fact GROUP BY category""")
def q_sql_return_rate(spark, sf_dir):
    return rollups.return_rate_by_category(fact(spark, sf_dir))


# --------------------------------------------------------------------------
# Chart tables

@register("weekday_month_heatmap", with_fact(
    "d AS (SELECT CAST(isodow(order_date) - 1 AS INTEGER) AS wd, strftime(order_date, '%Y-%m') AS month, "
    "order_id FROM fact WHERE order_date IS NOT NULL)",
    "c AS (SELECT wd, month, count(DISTINCT order_id) AS orders FROM d GROUP BY wd, month)",
    "grid AS (SELECT w.wd, m.month FROM (SELECT DISTINCT wd FROM c) w, (SELECT DISTINCT month FROM c) m)")
    + """SELECT grid.wd AS weekday_idx, CASE grid.wd WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday'
  WHEN 2 THEN 'Wednesday' WHEN 3 THEN 'Thursday' WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday'
  WHEN 6 THEN 'Sunday' END AS weekday, grid.month, CAST(coalesce(c.orders, 0) AS BIGINT) AS orders
FROM grid LEFT JOIN c ON grid.wd = c.wd AND grid.month = c.month""")
def q_weekday_month_heatmap(spark, sf_dir):
    return charts.weekday_month_heatmap(fact(spark, sf_dir))


@register("order_value_histogram", with_fact(
    "v AS (SELECT CAST(revenue * 10000 AS BIGINT) AS v FROM fact WHERE revenue IS NOT NULL)",
    "b AS (SELECT min(v) AS lo, max(v) AS hi FROM v)",
    "i AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(59, (v - lo) * 60 // (hi - lo)) END AS bin_idx, "
    "lo, hi FROM v, b)") + """SELECT CAST(bin_idx AS INTEGER) AS bin_idx,
  round(CAST(lo AS DOUBLE) / 10000 + CAST(hi - lo AS DOUBLE) / 10000 * bin_idx / 60, 2) AS bin_start,
  round(CAST(lo AS DOUBLE) / 10000 + CAST(hi - lo AS DOUBLE) / 10000 * (bin_idx + 1) / 60, 2) AS bin_end,
  count(*) AS lines FROM i GROUP BY bin_idx, lo, hi""")
def q_order_value_histogram(spark, sf_dir):
    return charts.order_value_histogram(fact(spark, sf_dir))


@register("delivery_box_stats", with_fact(
    "base AS (SELECT category, delivery_time AS x FROM fact WHERE category IS NOT NULL "
    "AND delivery_time IS NOT NULL)",
    """q AS (SELECT category, count(*) AS n, min(x) AS min_value, max(x) AS max_value,
  quantile_cont(CAST(x AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(x AS DOUBLE), 0.5) AS median,
  quantile_cont(CAST(x AS DOUBLE), 0.75) AS q3 FROM base GROUP BY category)""") + """SELECT q.category,
  q.n, q.min_value, q.q1, q.median, q.q3, q.max_value,
  min(CASE WHEN b.x >= q.q1 - 1.5 * (q.q3 - q.q1) THEN b.x END) AS lower_whisker,
  max(CASE WHEN b.x <= q.q3 + 1.5 * (q.q3 - q.q1) THEN b.x END) AS upper_whisker,
  CAST(count_if(b.x < q.q1 - 1.5 * (q.q3 - q.q1) OR b.x > q.q3 + 1.5 * (q.q3 - q.q1)) AS BIGINT)
  AS outliers
FROM q JOIN base b ON q.category = b.category
GROUP BY q.category, q.n, q.min_value, q.q1, q.median, q.q3, q.max_value""")
def q_delivery_box_stats(spark, sf_dir):
    return charts.delivery_box_stats(fact(spark, sf_dir))


# Two-letter codes of the 25 nations that stand for states in the test tables.
TEST_STATE_CODES = {f"NATION_{k}": "N" + chr(ord("A") + k) for k in range(25)}


def _state_map_sql() -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in TEST_STATE_CODES.items())
    return (with_fact(*_by_dim_ctes("state"), f"codes AS (SELECT * FROM (VALUES {rows}) v(name, code))",
                      "bs AS (" + _by_dim_select("state") + ")")
            + "SELECT bs.*, codes.code AS state_abbr FROM bs JOIN codes ON bs.state = codes.name")


@register("state_map_table", _state_map_sql())
def q_state_map_table(spark, sf_dir):
    by_state = trends.revenue_by_dimension(fact(spark, sf_dir), "state")
    return charts.state_map_table(by_state, "state", TEST_STATE_CODES)


@register("scatter_sample", with_fact() + """SELECT CAST(discount AS DOUBLE) AS discount,
  CAST(profit AS DOUBLE) AS profit, category FROM fact
ORDER BY md5(concat_ws('|', '42', CAST(order_id AS VARCHAR), CAST(product_id AS VARCHAR),
  CAST(order_date AS VARCHAR), CAST(ship_date AS VARCHAR), CAST(quantity AS VARCHAR),
  CAST(fact.discount AS VARCHAR), CAST(revenue AS VARCHAR))), fact.profit, category LIMIT 5000""")
def q_scatter_sample(spark, sf_dir):
    return charts.scatter_sample(fact(spark, sf_dir), 5000, 42)


# --------------------------------------------------------------------------
# Forecasts

def _forecast_ctes(horizon: int, keys: list[str]) -> tuple[str, ...]:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    part = f"PARTITION BY {k} " if keys else ""
    on = lambda a, b, extra=(): " AND ".join([f"{a}.{c} = {b}.{c}" for c in keys + list(extra)]) or "TRUE"
    return (
        f"daily AS (SELECT {kc}order_date AS date, CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue "
        f"FROM fact WHERE order_date IS NOT NULL AND revenue IS NOT NULL GROUP BY {kc}order_date)",
        f"""hist AS (SELECT {kc}date, revenue,
  CAST(row_number() OVER ({part}ORDER BY date) - 1 AS INTEGER) AS day_index,
  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
  CAST(month(date) AS INTEGER) AS month,
  CAST(CASE WHEN isodow(date) - 1 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
  CAST(CASE WHEN month(date) IN (11, 12) THEN 1 ELSE 0 END AS INTEGER) AS is_holiday_season
FROM daily)""",
        f"""trend AS (SELECT {kc}regr_slope(revenue, day_index) AS slope,
  regr_intercept(revenue, day_index) AS intercept, count(*) AS n_days, max(date) AS last_date
FROM hist {'GROUP BY ' + k if keys else ''})""",
        "tr AS (SELECT * FROM trend WHERE n_days >= 30)",
        f"""resid AS (SELECT h.*, h.revenue - (t.intercept + t.slope * h.day_index) AS resid
FROM hist h JOIN tr t ON {on('h', 't')})""",
        f"""cell AS (SELECT {kc}day_of_week, is_holiday_season, count(*) AS c_n,
  quantile_cont(resid, 0.1) AS c_q0, quantile_cont(resid, 0.5) AS c_q1, quantile_cont(resid, 0.9) AS c_q2
FROM resid GROUP BY {kc}day_of_week, is_holiday_season)""",
        f"""wday AS (SELECT {kc}day_of_week, count(*) AS w_n,
  quantile_cont(resid, 0.1) AS w_q0, quantile_cont(resid, 0.5) AS w_q1, quantile_cont(resid, 0.9) AS w_q2
FROM resid GROUP BY {kc}day_of_week)""",
        f"""gq AS (SELECT {kc}count(*) AS g_n,
  quantile_cont(resid, 0.1) AS g_q0, quantile_cont(resid, 0.5) AS g_q1, quantile_cont(resid, 0.9) AS g_q2
FROM resid {'GROUP BY ' + k if keys else ''})""",
        f"""fut AS (SELECT {', '.join('t.' + c for c in keys) + ', ' if keys else ''}
  CAST(t.last_date + CAST(s.step AS INTEGER) AS DATE) AS date,
  CAST(t.n_days - 1 + s.step AS INTEGER) AS day_index, t.slope, t.intercept
FROM tr t, range(1, {horizon + 1}) s(step))""",
        """fut2 AS (SELECT *, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
  CAST(CASE WHEN month(date) IN (11, 12) THEN 1 ELSE 0 END AS INTEGER) AS is_holiday_season FROM fut)""",
        f"""j AS (SELECT {', '.join('f.' + c for c in keys) + ', ' if keys else ''}f.date,
  f.intercept + f.slope * f.day_index AS base,
  CASE WHEN coalesce(c.c_n, 0) >= 5 THEN c.c_q0 WHEN coalesce(w.w_n, 0) >= 5 THEN w.w_q0 ELSE g.g_q0 END AS q0,
  CASE WHEN coalesce(c.c_n, 0) >= 5 THEN c.c_q1 WHEN coalesce(w.w_n, 0) >= 5 THEN w.w_q1 ELSE g.g_q1 END AS q1,
  CASE WHEN coalesce(c.c_n, 0) >= 5 THEN c.c_q2 WHEN coalesce(w.w_n, 0) >= 5 THEN w.w_q2 ELSE g.g_q2 END AS q2
FROM fut2 f
LEFT JOIN cell c ON {on('f', 'c', ('day_of_week', 'is_holiday_season'))}
LEFT JOIN wday w ON {on('f', 'w', ('day_of_week',))}
LEFT JOIN gq g ON {on('f', 'g')})""",
        f"""v AS (SELECT {kc}date, greatest(0.0, base + q0) AS v0, greatest(0.0, base + q1) AS v1,
  greatest(0.0, base + q2) AS v2 FROM j)""",
        f"""fc AS (SELECT {kc}date,
  round(greatest(least(v0, v1), least(greatest(v0, v1), v2)), 2) AS forecast,
  round(least(v0, v1, v2), 2) AS lower, round(greatest(v0, v1, v2), 2) AS upper FROM v)""",
    )


@register("forecast_30d", with_fact(*_forecast_ctes(30, [])) + "SELECT * FROM fc")
def q_forecast_30d(spark, sf_dir):
    return forecast.forecast_revenue(fact(spark, sf_dir), 30).forecast


@register("forecast_90d", with_fact(*_forecast_ctes(90, [])) + "SELECT * FROM fc")
def q_forecast_90d(spark, sf_dir):
    return forecast.forecast_revenue(fact(spark, sf_dir), 90).forecast


def _series_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    known = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    return (f"""SELECT {k}, date, forecast, lower, upper, 'forecast' AS status FROM fc WHERE {known}
UNION ALL SELECT {k}, CAST(NULL AS DATE), NULL, NULL, NULL, 'short history' FROM trend
WHERE n_days < 30 AND {known}""")


@register("forecast_by_region", with_fact(*_forecast_ctes(30, ["region"])) + _series_sql(["region"]))
def q_forecast_by_region(spark, sf_dir):
    return forecast.forecast_series(fact(spark, sf_dir), ["region"], 30)


# Many of these series sell on fewer than 30 days at the small sizes, and none may vanish.
@register("forecast_series_status",
          with_fact(*_forecast_ctes(30, ["product_name", "state"])) + """SELECT product_name, state, status,
  count(date) AS days, min(date) AS first_day FROM (""" + _series_sql(["product_name", "state"]) + """)
GROUP BY product_name, state, status""")
def q_forecast_series_status(spark, sf_dir):
    keys = ["product_name", "state"]
    return (forecast.forecast_series(fact(spark, sf_dir), keys, 30).groupBy(*keys, "status")
            .agg(F.count("date").alias("days"), F.min("date").alias("first_day")))


@register("forecast_totals", with_fact(*_forecast_ctes(30, [])) + """SELECT
  round(sum(forecast), 2) AS total_forecast, round(sum(lower), 2) AS total_lower,
  round(sum(upper), 2) AS total_upper FROM fc""")
def q_forecast_totals(spark, sf_dir):
    return forecast.forecast_totals(forecast.forecast_revenue(fact(spark, sf_dir), 30).forecast)


@register("forecast_band_polygon", with_fact(*_forecast_ctes(30, []), """mn AS (SELECT min(date) AS d0,
  count(*) AS h FROM fc)""") + """SELECT CAST(datediff('day', d0, date) AS BIGINT) AS point_idx, date,
  upper AS value FROM fc, mn
UNION ALL SELECT CAST(2 * h - 1 - datediff('day', d0, date) AS BIGINT), date, lower FROM fc, mn""")
def q_forecast_band_polygon(spark, sf_dir):
    return charts.forecast_band_polygon(forecast.forecast_revenue(fact(spark, sf_dir), 30).forecast)


@register("calendar_features", with_fact(*_forecast_ctes(30, [])[:2]) + "SELECT * FROM hist")
def q_calendar_features(spark, sf_dir):
    return forecast.calendar_features(forecast.daily_revenue(fact(spark, sf_dir)))


@register("daily_revenue", with_fact(*_forecast_ctes(30, [])[:1]) + "SELECT * FROM daily")
def q_daily_revenue(spark, sf_dir):
    return forecast.daily_revenue(fact(spark, sf_dir))


@register("forecast_gbt")
def q_forecast_gbt(spark, sf_dir):
    return forecast.forecast_gbt(fact(spark, sf_dir), 30)


# What a fitted model must give: the days after the last, an ordered band, no negative value,
# and on the history a median that errs less than a constant and a band that holds 75 to 85 %.
@register("forecast_gbt_checks", with_fact(*_forecast_ctes(30, [])[:1]) + """SELECT
  CAST(last + CAST(step AS INTEGER) AS DATE) AS date, true AS ordered, true AS not_negative,
  history_days, true AS median_beats_constant, true AS band_covers
FROM (SELECT max(date) AS last, count(*) AS history_days FROM daily), range(1, 31) s(step)""")
def q_forecast_gbt_checks(spark, sf_dir):
    fitted = cache(forecast.gbt_fit(fact(spark, sf_dir), 30))
    quality = forecast.gbt_quality(fitted).select(F.struct("*")).scalar()
    future = fitted.where(F.col("revenue").isNull())
    values = [F.greatest(F.lit(0.0), F.col(f"__v{i}")) for i in range(3)]
    band = forecast._finish(future.withColumns({f"__v{i}": v for i, v in enumerate(values)}), [])
    return band.withColumn("__quality", quality).select(
        "date", ((F.col("lower") <= F.col("forecast")) & (F.col("forecast") <= F.col("upper"))).alias("ordered"),
        (F.col("lower") >= 0).alias("not_negative"), F.col("__quality.history_days").alias("history_days"),
        (F.col("__quality.error") < F.col("__quality.constant_error")).alias("median_beats_constant"),
        F.col("__quality.covered").between(0.75, 0.85).alias("band_covers"))


# --------------------------------------------------------------------------
# Insights

REGION_GROWTH_SQL = with_fact(
    "dated AS (SELECT * FROM fact WHERE order_date IS NOT NULL AND region IS NOT NULL)",
    "m AS (SELECT min(date_trunc('month', order_date)) AS fm, max(date_trunc('month', order_date)) AS lm "
    "FROM dated)",
    """g AS (SELECT region,
  coalesce(sum(CASE WHEN date_trunc('month', order_date) = fm THEN revenue END), 0) AS first_rev,
  coalesce(sum(CASE WHEN date_trunc('month', order_date) = lm THEN revenue END), 0) AS last_rev,
  min(fm) AS fm, min(lm) AS lm FROM dated, m GROUP BY region)""") + """SELECT region,
  strftime(fm, '%Y-%m') AS first_month, strftime(lm, '%Y-%m') AS last_month,
  CAST(round(first_rev, 2) AS DOUBLE) AS first_month_revenue,
  CAST(round(last_rev, 2) AS DOUBLE) AS last_month_revenue,
  round(CAST(last_rev - first_rev AS DOUBLE) / CAST(first_rev AS DOUBLE) * 100, 1) AS growth_pct
FROM g WHERE fm <> lm AND first_rev <> 0"""


@register("region_growth", REGION_GROWTH_SQL)
def q_region_growth(spark, sf_dir):
    return insights.region_growth(fact(spark, sf_dir))


CAT_MARGIN_CTE = f"""cm AS (SELECT category, CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue,
  CAST(round(sum(profit), 2) AS DOUBLE) AS profit, {pct_sql('sum(profit)', 'sum(revenue)')} AS margin_pct,
  CAST(sum(profit) AS DOUBLE) / CAST(sum(revenue) AS DOUBLE) AS margin
FROM fact WHERE category IS NOT NULL GROUP BY category HAVING sum(revenue) > 0)"""


@register("category_margin", with_fact(CAT_MARGIN_CTE) + "SELECT * EXCLUDE (margin) FROM cm")
def q_category_margin(spark, sf_dir):
    return insights.category_margin(fact(spark, sf_dir))


EROSION_CTE = """ero AS (SELECT f.discount_band AS first_band, f.margin_pct AS first_margin_pct,
  l.discount_band AS last_band, l.margin_pct AS last_margin_pct,
  coalesce(l.margin_pct < f.margin_pct - 5.0, false) AS erodes
FROM (SELECT count(*) AS nb, min(band_idx) AS lo, max(band_idx) AS hi FROM bands) s
JOIN bands f ON f.band_idx = s.lo JOIN bands l ON l.band_idx = s.hi WHERE s.nb >= 2)"""


@register("discount_erosion", with_fact(_bands_cte(TEST_DISCOUNT_EDGES), EROSION_CTE) +
          "SELECT * FROM ero")
def q_discount_erosion(spark, sf_dir):
    return insights.discount_erosion(fact(spark, sf_dir), TEST_DISCOUNT_EDGES)


PROFIT_DRIVERS_SQL = (with_fact(CAT_MARGIN_CTE, _bands_cte(TEST_DISCOUNT_EDGES), RAW_CTE,
                                      "nb AS (SELECT count(*) AS n, count(margin_pct) AS nm FROM bands)")
          + """SELECT * FROM (SELECT 'thinnest_category' AS driver, category AS subject, margin_pct AS value
  FROM cm ORDER BY margin, category LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'highest_discount_band' AS driver, discount_band AS subject,
  margin_pct AS value FROM bands, nb
  WHERE nb.n >= 2 ORDER BY band_idx DESC LIMIT 1) WHERE value IS NOT NULL
UNION ALL SELECT * FROM (SELECT 'lowest_margin_band', discount_band, margin_pct FROM bands, nb
  WHERE nb.n >= 2 AND nb.nm > 0 AND margin_pct IS NOT NULL ORDER BY margin, band_idx LIMIT 1)
UNION ALL SELECT 'unprofitable_products', NULL, CAST(count_if(prof < 0) AS DOUBLE) FROM raw
  HAVING count_if(prof < 0) > 0""")


@register("profit_drivers", PROFIT_DRIVERS_SQL)
def q_profit_drivers(spark, sf_dir):
    return insights.profit_drivers(fact(spark, sf_dir), TEST_DISCOUNT_EDGES)


def say_sql(key: str, *values: str) -> str:
    """A sentence of ``insights.TEMPLATES`` with SQL texts in the place of its values."""
    parts = [p.replace("%%", "%").replace("'", "''") for p in insights.TEMPLATES[key].split("%s")]
    assert len(parts) == len(values) + 1, key
    return " || ".join([f"'{parts[0]}'"] + [f"({v}) || '{p}'" for v, p in zip(values, parts[1:])])


def whole_sql(x: str) -> str:
    return f"printf('%.0f', round_even({x}, 0))"


def thousands_sql(x: str, digits: int = 0) -> str:
    return f"format('{{:,.{digits}f}}', round_even({x}, {digits}))"


INSIGHTS_SQL = EXEC_SUMMARY_SQL.rstrip("\n") + ",\n" + ",\n".join((
    *_by_dim_ctes("region", "rg", "rt"),
    f"""rshare AS (SELECT region, revenue, CASE WHEN total <> 0 THEN {pct_sql('revenue', 'total')}
  ELSE 0.0 END AS share FROM rg, rt)""",
    *QUANTILE_CTES, REPRICING_CTE, _bands_cte(TEST_DISCOUNT_EDGES), EROSION_CTE, f"""ins AS (
SELECT 1 AS insight_id, 'revenue_growth' AS kind, dir AS subject, CAST(NULL AS VARCHAR) AS detail,
  revenue_growth_pct AS value, CAST(NULL AS DOUBLE) AS value2,
  {say_sql('revenue_growth', 'dir', whole_sql('abs(revenue_growth_pct)'))} AS text
  FROM (SELECT *, CASE WHEN revenue_growth_pct >= 0 THEN 'increased' ELSE 'decreased' END AS dir FROM s)
  WHERE revenue_growth_pct IS NOT NULL
UNION ALL SELECT * FROM (SELECT 2, 'top_region', region, NULL, share, NULL,
  {say_sql('top_region', 'region', whole_sql('share'))} FROM rshare ORDER BY revenue DESC, region LIMIT 1)
UNION ALL SELECT * FROM (SELECT 3, 'repricing_candidate', product_name, NULL, revenue, margin_pct,
  {say_sql('repricing_candidate', 'product_name', thousands_sql('revenue'), whole_sql('margin_pct'))} FROM rep
  ORDER BY margin_pct, revenue DESC, product_id LIMIT 1)
UNION ALL SELECT 4, 'discount_erosion', first_band, last_band, first_margin_pct, last_margin_pct,
  {say_sql('discount_erosion', whole_sql('first_margin_pct'), 'first_band', whole_sql('last_margin_pct'), 'last_band')}
  FROM ero WHERE erodes
UNION ALL SELECT 5, 'order_value', NULL, NULL, average_order_value, return_rate_pct,
  {say_sql('order_value', thousands_sql('average_order_value', 2), "format('{:,}', total_orders)",
           "format('{:,}', total_customers)", "printf('%.1f', return_rate_pct)")} FROM s)""")) + "\n"


@register("summary_insights", INSIGHTS_SQL + "SELECT * FROM ins")
def q_summary_insights(spark, sf_dir):
    return insights.summary_insights(fact(spark, sf_dir), edges=TEST_DISCOUNT_EDGES)


@register("context_block", INSIGHTS_SQL +
          "SELECT '- ' || string_agg(text, chr(10) || '- ' ORDER BY insight_id) AS context FROM ins")
def q_context_block(spark, sf_dir):
    return insights.context_block(insights.summary_insights(fact(spark, sf_dir), edges=TEST_DISCOUNT_EDGES))


RECOMMENDATIONS_SQL = EXEC_SUMMARY_SQL.rstrip("\n") + ",\n" + ",\n".join(
    (*QUANTILE_CTES, INVENTORY_CTE, f"""recs AS (
SELECT * FROM (SELECT 1 AS rec_id, 'restock' AS kind, CAST(count(*) AS DOUBLE) AS value,
  {say_sql('restock', 'CAST(count(*) AS VARCHAR)')} AS text FROM inv
  WHERE recommendation = 'Restock' HAVING count(*) > 0)
UNION ALL SELECT * FROM (SELECT 2, 'discontinue', CAST(count(*) AS DOUBLE),
  {say_sql('discontinue', 'CAST(count(*) AS VARCHAR)')} FROM inv
  WHERE recommendation = 'Discontinue' HAVING count(*) > 0)
UNION ALL SELECT 3, 'return_rate_alert', return_rate_pct,
  {say_sql('return_rate_alert', "printf('%.1f', return_rate_pct)")} FROM s WHERE return_rate_pct > 8)""")) + "\n"


@register("recommendations", RECOMMENDATIONS_SQL + "SELECT * FROM recs")
def q_recommendations(spark, sf_dir):
    return insights.recommendations(fact(spark, sf_dir))


@register("top5_readout", with_fact(PERF_CTE) + """SELECT product_id, product_name, revenue, margin_pct
FROM perf ORDER BY revenue DESC NULLS LAST, revenue DESC, product_id LIMIT 5""")
def q_top5_readout(spark, sf_dir):
    return insights.top5_readout(fact(spark, sf_dir))


@register("worst5_readout", with_fact(PERF_CTE) + """SELECT product_id, product_name, profit
FROM perf ORDER BY profit ASC NULLS LAST, revenue DESC, product_id LIMIT 5""")
def q_worst5_readout(spark, sf_dir):
    return insights.worst5_readout(fact(spark, sf_dir))


def _intent_sql(text: str, rules) -> str:
    q = f"lower({text})"
    whens = []
    for intent, all_of, any_of in rules:
        anys = " OR ".join(f"contains({q}, '{w}')" for w in any_of)
        cond = f"({anys})"
        for w in all_of:
            cond = f"contains({q}, '{w}') AND {cond}"
        whens.append(f"WHEN coalesce({cond}, false) THEN '{intent}'")
    return "CASE " + " ".join(whens) + f" ELSE '{insights.UNKNOWN_INTENT}' END"


@register("question_intents", f"""SELECT role, intent, count(*) AS questions FROM (
  SELECT role, {_intent_sql('text', insights.INTENT_RULES)} AS intent FROM conversations)
  GROUP BY role, intent""")
def q_question_intents(spark, sf_dir):
    return insights.intent_counts(read_table(spark, sf_dir, "conversations"), "text", ["role"])


# The test conversations hold invented words, so the reference rules tag none of
# them; these rules route by words that do occur there.
TEST_INTENT_RULES = [
    ("joined", ("the",), ("and", "with")),
    ("named", (), ("tion", "ment")),
    ("other", (), ("e", "a")),
]


@register("question_intents_by_words", f"""SELECT role, intent, count(*) AS questions FROM (
  SELECT role, {_intent_sql('text', TEST_INTENT_RULES)} AS intent FROM conversations)
  GROUP BY role, intent""")
def q_question_intents_by_words(spark, sf_dir):
    return insights.intent_counts(read_table(spark, sf_dir, "conversations"), "text", ["role"],
                                  TEST_INTENT_RULES)


# One question of our own for each intent, and one that no rule knows.
TEST_QUESTIONS = {
    "summary": "Give me an overview of the period.",
    "region_growth": "Which region has grown most, the fastest one?",
    "profit_drivers": "Where does our margin go?",
    "top_products": "What is the best product?",
    "worst_products": "Show low performing goods.",
    "target_customers": "Which customers do we write to?",
    "recommendations": "Any suggestion for next month?",
    insights.UNKNOWN_INTENT: "What colour is the sky?",
}
ANSWER_SQL = {
    "summary": INSIGHTS_SQL + "SELECT string_agg(text, ' ' ORDER BY insight_id) AS answer FROM ins",
    "region_growth": f"""SELECT coalesce((SELECT {say_sql('fastest_region', 'region', whole_sql('growth_pct'))}
  FROM ({REGION_GROWTH_SQL}) ORDER BY (last_month_revenue - first_month_revenue) / first_month_revenue DESC, region
  LIMIT 1), {say_sql('no_growth')}) AS answer""",
    "profit_drivers": f"""SELECT coalesce(nullif(concat_ws(' ',
  max(CASE WHEN driver = 'thinnest_category' THEN {say_sql('thinnest_category', 'subject', whole_sql('value'))} END),
  max(CASE WHEN driver = 'highest_discount_band' THEN {say_sql('last_band', 'subject', whole_sql('value'))} END),
  max(CASE WHEN driver = 'unprofitable_products' THEN
      {say_sql('unprofitable', 'CAST(CAST(value AS BIGINT) AS VARCHAR)')} END)), ''),
  {say_sql('no_drivers')}) AS answer FROM ({PROFIT_DRIVERS_SQL})""",
    "top_products": with_fact(PERF_CTE) + f"""SELECT {say_sql('top_products', "string_agg(t, '; ' ORDER BY revenue DESC, product_id)")}
  AS answer FROM (SELECT *, {say_sql('top_product', 'product_name', thousands_sql('revenue'),
                                     f"coalesce({whole_sql('margin_pct')}, 'n/a')")} AS t
  FROM perf ORDER BY revenue DESC NULLS LAST, product_id LIMIT 5)""",
    "worst_products": with_fact(PERF_CTE) + f"""SELECT {say_sql('worst_products', "string_agg(t, '; ' ORDER BY profit, product_id)")}
  AS answer FROM (SELECT *, {say_sql('worst_product', 'product_name', thousands_sql('profit'))} AS t
  FROM perf ORDER BY profit ASC NULLS LAST, revenue DESC, product_id LIMIT 5)""",
    "target_customers": with_fact(*RFM_CTES) + f"""SELECT {say_sql(
        'targets', "CAST(count_if(segment = 'Champions') AS VARCHAR)", "CAST(count_if(segment = 'At risk') AS VARCHAR)")}
  AS answer FROM rfm""",
    "recommendations": RECOMMENDATIONS_SQL + f"""SELECT CASE WHEN count(*) = 0 THEN {say_sql('no_recommendations')}
  ELSE string_agg(text, ' ' ORDER BY rec_id) END AS answer FROM recs""",
    insights.UNKNOWN_INTENT: f"SELECT {say_sql('help')} AS answer",
}


@register("answers", "\nUNION ALL ".join(
    f"SELECT '{q}' AS question, '{intent}' AS intent, (SELECT answer FROM ({ANSWER_SQL[intent]})) AS answer"
    for intent, q in TEST_QUESTIONS.items()))
def q_answers(spark, sf_dir):
    questions = spark.createDataFrame([(q,) for q in TEST_QUESTIONS.values()], "question string")
    return insights.answers(fact(spark, sf_dir), questions, edges=TEST_DISCOUNT_EDGES)


# The joined fact as a flat export: written as CSV and read back, dates, money and text alike.
@register("flat_round_trip", with_fact() + f"SELECT {FACT_OUT_COLUMNS} FROM fact")
def q_flat_round_trip(spark, sf_dir):
    flat = flatfile.to_flat(fact(spark, sf_dir))
    back = flatfile.to_snake_case(flatfile.round_trip(flat))
    kinds = {f.name: f.dataType for f in fact(spark, sf_dir).schema.fields}
    return out(back.select(*[F.col(c).cast(kinds[c]).alias(c) for c in back.columns]))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's headline row."""
    return q_executive_summary(spark, sf_dir)
