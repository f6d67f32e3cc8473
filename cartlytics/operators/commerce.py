"""Order analytics questions (JN1, FLT1-FLT4, AGG2-AGG8, WIN1, R1-R4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlytics.functions.columns import (
    REFERENCE_EXCLUDED_STATUSES, REFERENCE_UNDELIVERED_STATUSES, half_even, month_start,
    not_in_null_safe, weekday_name, weeks_in_month)
from cartlytics.plans.skew import skew_join


def customer_orders(customers: DataFrame, orders: DataFrame, rows_a_task: int | None = None) -> DataFrame:
    """JN1: orders with the person id (customer_unique_id) attached.

    Inner equi-join on customer_id.  The customers side is one row per
    customer_id; Spark broadcasts it when its statistics are below the
    broadcast threshold and otherwise sort-merge joins, with AQE splitting a
    skewed customer_id partition of the orders side.  With ``rows_a_task`` the ids that hold many orders are
    looked for first and cut into fragments of so many rows (``plans.skew``).
    """
    return _joined(orders, customers.select("customer_id", "customer_unique_id"), "customer_id", rows_a_task)


def order_lines(orders: DataFrame, order_items: DataFrame, rows_a_task: int | None = None) -> DataFrame:
    """JN1: items with their order's status and time; ``rows_a_task`` as in ``customer_orders``."""
    o = orders.select("order_id", "order_status", "order_purchase_timestamp")
    return _joined(o, order_items.select("order_id", "order_item_id", "product_id", "price"), "order_id", rows_a_task)


def _joined(left: DataFrame, right: DataFrame, key: str, rows_a_task: int | None) -> DataFrame:
    if rows_a_task is None:
        return left.join(right, key, "inner")
    return skew_join(left, right, [key], rows_a_task=rows_a_task)


def paid(df: DataFrame, excluded_statuses: Sequence[str] = REFERENCE_EXCLUDED_STATUSES,
         status_col: str = "order_status") -> DataFrame:
    """FLT1: drop orders that are not a purchase; NULL status is kept."""
    return df.where(not_in_null_safe(status_col, excluded_statuses))


def orders_per_person(cust_orders: DataFrame,
                      excluded_statuses: Sequence[str] = REFERENCE_EXCLUDED_STATUSES) -> DataFrame:
    """Purchases per person (AGG2); NULL person ids are not a group (D3)."""
    return (paid(cust_orders, excluded_statuses)
            .where(F.col("customer_unique_id").isNotNull())
            .groupBy("customer_unique_id")
            .agg(F.count("order_id").alias("purchase_number")))


def one_time_buyers(cust_orders: DataFrame,
                    excluded_statuses: Sequence[str] = REFERENCE_EXCLUDED_STATUSES) -> DataFrame:
    """Number of people with exactly one purchase (one row).

    Partial aggregation per person happens map-side, so a person with a huge
    number of orders costs one row per map task in the shuffle.
    """
    per = orders_per_person(cust_orders, excluded_statuses)
    return per.agg(F.count(F.when(F.col("purchase_number") == 1, F.lit(1)))
                   .alias("one_time_buyers"))


def undelivered_by_reason(cust_orders: DataFrame,
                          reasons: Sequence[str] = REFERENCE_UNDELIVERED_STATUSES,
                          decimals: int = 2, fill_missing_months: bool = False) -> DataFrame:
    """R2: average number of orders per month for each non-delivery status.

    By default months in which a status does not occur are not counted (D8,
    the reference's result); ``fill_missing_months`` averages over every
    calendar month from the first to the last order month instead (zeros).
    """
    per_month = (cust_orders.where(F.col("order_status").isin(*reasons))
                 .groupBy(month_start("order_purchase_timestamp").alias("year_month"),
                          "order_status")
                 .agg(F.count("order_id").alias("n_orders")))
    if not fill_missing_months:
        mean = F.avg("n_orders")
    else:
        span = cust_orders.agg(
            (F.months_between(month_start(F.max("order_purchase_timestamp")),
                              month_start(F.min("order_purchase_timestamp"))) + 1).alias("m"))
        mean = F.sum("n_orders") / span.select("m").scalar()
    return per_month.groupBy("order_status").agg(half_even(mean, decimals).alias("avg_canceled"))


def top_weekday_per_product(orders: DataFrame, order_items: DataFrame,
                            excluded_statuses: Sequence[str] = REFERENCE_EXCLUDED_STATUSES
                            ) -> DataFrame:
    """Weekday on which each product is bought most often.

    Item rows per (product, weekday) are counted; the best weekday wins, ties go
    to the alphabetically first weekday name (D9).  The top-1 is a second
    hash aggregate (min of a struct) over at most 7 rows per product: no sort.
    """
    o = paid(orders, excluded_statuses).select(
        "order_id", weekday_name("order_purchase_timestamp").alias("weekday"))
    counts = (order_items.select("order_id", "product_id").join(o, "order_id")
              .groupBy("product_id", "weekday").agg(F.count(F.lit(1)).alias("quantity")))
    best = counts.groupBy("product_id").agg(
        F.min(F.struct((-F.col("quantity")).alias("nq"), F.col("weekday"))).alias("b"))
    return best.select("product_id", F.col("b.weekday").alias("weekday"),
                       (-F.col("b.nq")).alias("quantity"))


def purchases_per_week(cust_orders: DataFrame,
                       excluded_statuses: Sequence[str] = REFERENCE_EXCLUDED_STATUSES
                       ) -> DataFrame:
    """Purchases per week for every (month, person): orders / (days / 7)."""
    per = (paid(cust_orders, excluded_statuses)
           .where(F.col("customer_unique_id").isNotNull())
           .groupBy(month_start("order_purchase_timestamp").alias("year_month"),
                    "customer_unique_id")
           .agg(F.count("order_id").alias("quantity")))
    return (per.withColumn("weeks", weeks_in_month("year_month"))
               .withColumn("avg_purchases_per_week", F.col("quantity") / F.col("weeks")))
