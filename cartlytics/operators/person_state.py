"""Retention and RFM from a mergeable state per person.

All that both need of a person are minima, maxima, counts and sums, so history is kept as partial aggregates: one row for each
(person, day) with the orders of that day.  States of disjoint sets of orders merge by adding rows (``merge``), whatever the split and
the order of arrival; late orders are rows of an earlier day like any others.

On disk a state is a folder of batches.  ``append_batch`` writes the partial aggregates of new orders as one batch (a batch that is written
again replaces itself, so that a retry counts nothing twice); ``read_state`` adds up all batches; ``compact`` replaces them with one.
A month's update reads the month's orders, not the history.

An order's items come in the batch of the order.  Money is summed as DECIMAL, so that any split gives the same sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlytics.functions.columns import REFERENCE_EXCLUDED_STATUSES, half_even, month_start, not_in_null_safe
from cartlytics.operators.rfm import order_values

_P = "customer_unique_id"
_ADDED = ("n_all", "n_paid", "n_valued", "money")


def person_days(cust_orders: DataFrame, order_items: DataFrame, excluded_statuses: Sequence[str] = REFERENCE_EXCLUDED_STATUSES) -> DataFrame:
    """customer_unique_id, day, n_all, n_paid (orders), n_valued (paid orders with items), money (their value) of these orders."""
    day = F.to_date("order_purchase_timestamp").alias("day")
    is_paid = not_in_null_safe("order_status", excluded_statuses)
    some = cust_orders.where(F.col(_P).isNotNull())
    counted = some.groupBy(_P, day).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(is_paid).alias("n_paid"))
    valued = order_values(some, order_items, excluded_statuses).groupBy(_P, day).agg(
        F.count(F.lit(1)).alias("n_valued"), F.sum(F.col("price").cast("decimal(38,10)")).cast("decimal(38,10)").alias("money"))
    zero = F.lit(0).cast("long")
    valued = valued.select(_P, "day", zero.alias("n_all"), zero.alias("n_paid"), "n_valued", "money")
    counted = counted.select(_P, "day", "n_all", "n_paid", zero.alias("n_valued"), F.lit(0).cast("decimal(38,10)").alias("money"))
    return merge(counted.unionByName(valued))


def merge(states: DataFrame) -> DataFrame:
    """One row for each (person, day) of one or several states after a union."""
    return states.groupBy(_P, "day").agg(*[F.sum(c).cast("decimal(38,10)" if c == "money" else "long").alias(c) for c in _ADDED])


def append_batch(state: DataFrame, path: str, batch: str) -> None:
    """Write a state as the batch of this name, in place of an earlier one of the same name."""
    if not batch or "/" in batch or "=" in batch:
        raise ValueError("a batch name must be plain")
    state.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return merge(spark.read.parquet(f"{path.rstrip('/')}/batch=*"))


def compact(spark: SparkSession, path: str, into: str) -> DataFrame:
    """The whole state as one batch in another folder; returns what was written."""
    append_batch(read_state(spark, path), into, "all")
    return read_state(spark, into)


def retention_from_state(state: DataFrame, decimals: int = 2) -> DataFrame:
    """R5 (proper): (cohort, year_month, month_offset, customers_quantity, percentage)."""
    months = state.where("n_paid > 0").select(_P, month_start("day").alias("year_month")).distinct()
    months = months.withColumn("cohort", F.min("year_month").over(Window.partitionBy(_P)))
    counts = months.groupBy("cohort", "year_month").agg(F.count(F.lit(1)).alias("customers_quantity"))
    base = F.max(F.when(F.col("year_month") == F.col("cohort"), F.col("customers_quantity"))).over(Window.partitionBy("cohort"))
    return (counts.withColumn("month_offset", F.months_between("year_month", "cohort").cast("int"))
            .withColumn("percentage", half_even(F.try_divide(F.col("customers_quantity") * 100.0, base), decimals)))


def rfm_base_from_state(state: DataFrame, as_of, period_days: int = 7 * 365, money_decimals: int = 6) -> DataFrame:
    """Recency, frequency and monetary per person at any date, from the state alone."""
    today = F.lit(as_of).cast("date")
    return state.where("n_valued > 0").groupBy(_P).agg(
        F.datediff(today, F.max("day")).alias("recency"),
        F.coalesce(F.sum(F.when(F.col("day") >= F.date_sub(today, period_days), F.col("n_valued"))), F.lit(0)).alias("frequency"),
        F.round(F.sum("money").cast("double"), money_decimals).alias("monetary"))
