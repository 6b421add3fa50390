"""salespark: retail sales analytics on Spark DataFrames.

Sources build the joined sales fact (``sources.tables.sales_fact`` over the
star schema tables, ``sources.flatfile`` for the flat export); operators
turn it into KPIs, trends, customer and product analytics, chart tables,
forecasts and insight rows; ``plans.dashboard.Dashboard`` runs them per
filter selection.  Every function returns a lazy DataFrame.
"""

__version__ = "0.1.0"
