"""Adapters from the driver's TPC-H-like test tables to the domain relations.

Mapping (fixed by FIXTURES.md):
  customers   <- customer: c_custkey plays both customer_id and customer_unique_id
  orders      <- orders: o_orderkey, o_custkey, o_orderstatus (F/O/P), o_orderdate
  order_items <- lineitem: l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 l_shipdate, l_extendedprice as price
  ab_users_data <- orders: create_order for every order, plus cancel_order when
                 status = P; group = o_custkey % 2
  ab_orders   <- lineitem: '{' + sorted l_partkey joined by ', ' + '}' per order (a set for 64 lines)
  ab_order_products <- lineitem: the same as rows (order, product)
  ab_products <- part: p_partkey, p_retailprice
All adapters are projections of one scan (the A/B order sets add one
aggregation), so Catalyst still prunes columns down to the parquet reader.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlytics.sources.readers import read_table

# Parameters that make the reference's questions meaningful on the test data:
# statuses are only F/O/P, the last order is on 2001-08-01.
PARAMS = {
    "excluded_statuses": ("P",),
    "undelivered_statuses": ("O", "P"),
    "as_of": _dt.date(2001, 8, 2),
    "period_days": 3 * 365,
}


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("customer_id"),
                    F.col("c_custkey").alias("customer_unique_id"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"),
                    F.col("o_custkey").alias("customer_id"),
                    F.col("o_orderstatus").alias("order_status"),
                    F.col("o_orderdate").alias("order_purchase_timestamp"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("order_id"),
                     F.col("l_linenumber").alias("order_item_id"),
                     F.col("l_partkey").alias("product_id"),
                     F.col("l_suppkey").alias("seller_id"),
                     F.col("l_shipdate").alias("shipping_limit_date"),
                     F.col("l_extendedprice").alias("price"))


def ab_users_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ab_users_from_orders(read_table(spark, sf_dir, "orders"))


def ab_users_from_orders(o: DataFrame) -> DataFrame:
    """The A/B action log from an orders frame."""
    actions = F.when(F.col("o_orderstatus") == "P",
                     F.array(F.lit("create_order"), F.lit("cancel_order"))
                     ).otherwise(F.array(F.lit("create_order")))
    return o.select(F.col("o_custkey").alias("user_id"),
                    F.col("o_orderkey").alias("order_id"),
                    F.explode(actions).alias("action"),
                    F.col("o_orderdate").alias("time"),
                    F.to_date("o_orderdate").alias("date"),
                    (F.col("o_custkey") % 2).cast("int").alias("group"))


def ab_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_sets(read_table(spark, sf_dir, "lineitem"))


def product_sets(li: DataFrame, lines_a_set: int = 64) -> DataFrame:
    """One set in braces for every ``lines_a_set`` line numbers of an order: an order of any length is never gathered
    whole, and its sets explode to its lines."""
    ids = F.array_join(F.sort_array(F.collect_list("l_partkey")), ", ")
    return (li.groupBy(F.col("l_orderkey").alias("order_id"), F.floor((F.col("l_linenumber") - 1) / lines_a_set).alias("_part"))
              .agg(F.concat(F.lit("{"), ids, F.lit("}")).alias("product_ids")).drop("_part"))


def ab_order_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sets as rows (order_id, product_id): nothing is gathered by order."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"))


def ab_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("product_id"),
                    F.col("p_retailprice").alias("price"))
