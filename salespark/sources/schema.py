"""Explicit schemas for the star schema and the flat order export.

No schema is ever inferred.  Money is DECIMAL so that sums are exact and do
not depend on row order; dates are DATE.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)
PRICE = T.DecimalType(12, 2)
RATE = T.DecimalType(4, 2)

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("customer_name", T.StringType(), False),
    T.StructField("age", T.IntegerType(), True),
    T.StructField("gender", T.StringType(), True),
    T.StructField("city", T.StringType(), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("country", T.StringType(), True),
])

PRODUCTS = T.StructType([
    T.StructField("product_id", T.StringType(), False),
    T.StructField("category", T.StringType(), True),
    T.StructField("sub_category", T.StringType(), True),
    T.StructField("product_name", T.StringType(), True),
    T.StructField("unit_price", PRICE, True),
    T.StructField("cost", PRICE, True),
])

ORDERS = T.StructType([
    T.StructField("order_id", T.StringType(), False),
    T.StructField("order_date", T.DateType(), True),
    T.StructField("ship_date", T.DateType(), True),
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("product_id", T.StringType(), True),
    T.StructField("quantity", T.IntegerType(), True),
    T.StructField("discount", RATE, True),
    T.StructField("revenue", MONEY, True),
    T.StructField("profit", MONEY, True),
    T.StructField("sales_channel", T.StringType(), True),
    T.StructField("payment_method", T.StringType(), True),
    T.StructField("returned", T.StringType(), True),
    T.StructField("delivery_time", T.IntegerType(), True),
    T.StructField("rating", T.IntegerType(), True),
])

# The column layout of the flat order export (header names in
# file order) and the snake_case name each one is stored under.
FLAT_TO_SNAKE = {
    "Order_ID": "order_id",
    "Order_Date": "order_date",
    "Ship_Date": "ship_date",
    "Customer_ID": "customer_id",
    "Customer_Name": "customer_name",
    "Age": "age",
    "Gender": "gender",
    "City": "city",
    "State": "state",
    "Region": "region",
    "Country": "country",
    "Product_ID": "product_id",
    "Category": "category",
    "Sub_Category": "sub_category",
    "Product_Name": "product_name",
    "Quantity": "quantity",
    "Unit_Price": "unit_price",
    "Discount": "discount",
    "Cost": "cost",
    "Revenue": "revenue",
    "Profit": "profit",
    "Sales_Channel": "sales_channel",
    "Payment_Method": "payment_method",
    "Returned": "returned",
    "Delivery_Time": "delivery_time",
    "Rating": "rating",
}
SNAKE_TO_FLAT = {v: k for k, v in FLAT_TO_SNAKE.items()}


def _field(name: str) -> T.StructField:
    for schema in (CUSTOMERS, PRODUCTS, ORDERS):
        if name in schema.fieldNames():
            f = schema[name]
            return T.StructField(name, f.dataType, True)
    raise KeyError(name)


# The flat export: one row per order line, 26 columns, Title_Case headers.
FLAT = T.StructType([
    T.StructField(flat, _field(snake).dataType, True) for flat, snake in FLAT_TO_SNAKE.items()
])

# The joined fact: the 26 attributes under snake_case names, in the column
# order of the joined dataset (order measures, customer, product).
FACT_COLUMNS = [
    "order_id", "order_date", "ship_date", "quantity", "discount", "revenue", "profit",
    "sales_channel", "payment_method", "returned", "delivery_time", "rating",
    "customer_id", "customer_name", "age", "gender", "city", "state", "region", "country",
    "product_id", "category", "sub_category", "product_name", "unit_price", "cost",
]
FACT = T.StructType([_field(c) for c in FACT_COLUMNS])

CUSTOMER_COLUMNS = CUSTOMERS.fieldNames()
PRODUCT_COLUMNS = PRODUCTS.fieldNames()
ORDER_COLUMNS = ORDERS.fieldNames()
