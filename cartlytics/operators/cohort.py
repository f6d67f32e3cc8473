"""Cohort retention (R5) and best cohort.

Two modes (SURVEY 1.5):
* ``proper``: cohort = month of a person's first paid order; activity = paid
  orders only; a person counts once per month; the base is the cohort size
  (offset 0), so offset 0 is always 100%.
* ``compat``: the reference's raw numbers: cohort from paid orders, but
  activity rows are *all* orders of the person (also unpaid, also before the
  cohort month); order rows are counted; the base is the largest count kept.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlytics.functions.columns import REFERENCE_EXCLUDED_STATUSES, date_lit, half_even, month_start
from cartlytics.operators.commerce import paid

_P = "customer_unique_id"


def _month_offset(month: str, cohort: str):
    return F.months_between(F.col(month), F.col(cohort)).cast("int")


def _limit_periods(df: DataFrame, n_periods) -> DataFrame:
    """WIN2: keep the first N observed months of each cohort (N may differ per
    cohort: a mapping cohort-date -> N; cohorts that it does not name keep all their
    months).  Rows per cohort are bounded by the
    number of calendar months, so the window is small."""
    if n_periods is None or isinstance(n_periods, Mapping) and not n_periods:
        return df
    rn = F.row_number().over(Window.partitionBy("cohort").orderBy("year_month"))
    if isinstance(n_periods, Mapping):
        expr = None
        for k, v in n_periods.items():
            k = _dt.date.fromisoformat(k + "-01") if isinstance(k, str) and len(k) == 7 else k
            cond = F.col("cohort") == date_lit(k)
            expr = F.when(cond, F.lit(int(v))) if expr is None else expr.when(cond, F.lit(int(v)))
        limit = expr.otherwise(F.col("_rn"))  # a cohort that the mapping does not name stays whole
    else:
        limit = F.lit(int(n_periods))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= limit).drop("_rn")


def _cohort_range(df: DataFrame, cohort_from, cohort_to) -> DataFrame:
    if cohort_from is not None:
        df = df.where(F.col("cohort") >= date_lit(cohort_from))
    if cohort_to is not None:
        df = df.where(F.col("cohort") <= date_lit(cohort_to))
    return df


def cohort_retention(cust_orders: DataFrame,
                     excluded_statuses: Sequence[str] = REFERENCE_EXCLUDED_STATUSES,
                     mode: str = "proper", n_periods=None,
                     cohort_from=None, cohort_to=None, decimals: int = 2) -> DataFrame:
    """Rows (cohort, year_month, month_offset, customers_quantity, percentage)."""
    co = cust_orders.where(F.col(_P).isNotNull())
    if mode == "proper":
        # distinct (person, month) first: a person contributes at most one row
        # per month, so the per-person window below is bounded by #months.
        pm = (paid(co, excluded_statuses)
              .select(_P, month_start("order_purchase_timestamp").alias("year_month")).distinct())
        pm = pm.withColumn("cohort", F.min("year_month").over(Window.partitionBy(_P)))
        counts = (pm.groupBy("cohort", "year_month")
                  .agg(F.count(F.lit(1)).alias("customers_quantity")))
        counts = _limit_periods(_cohort_range(counts, cohort_from, cohort_to), n_periods)
        base = F.max(F.when(F.col("year_month") == F.col("cohort"), F.col("customers_quantity"))) \
            .over(Window.partitionBy("cohort"))
    elif mode == "compat":
        cohorts = (paid(co, excluded_statuses).groupBy(_P)
                   .agg(month_start(F.min("order_purchase_timestamp")).alias("cohort")))
        activity = (co.groupBy(_P, month_start("order_purchase_timestamp").alias("year_month"))
                    .agg(F.count(_P).alias("_n")))
        counts = (activity.join(cohorts, _P)
                  .groupBy("cohort", "year_month")
                  .agg(F.sum("_n").alias("customers_quantity")))
        counts = _limit_periods(_cohort_range(counts, cohort_from, cohort_to), n_periods)
        base = F.max("customers_quantity").over(Window.partitionBy("cohort"))
    else:
        raise ValueError("mode must be 'proper' or 'compat'")
    return (counts.withColumn("month_offset", _month_offset("year_month", "cohort"))
            .withColumn("percentage",
                        half_even(F.try_divide(F.col("customers_quantity") * 100.0, base), decimals)))


def best_cohort(retention: DataFrame, month_number: int = 3, position: str = "offset") -> DataFrame:
    """cohort(s) with the highest percentage in their ``month_number``-th
    month; ties keep every tied cohort.

    ``position="offset"``: the month at offset month_number - 1 from the cohort
    month (proper retention).  ``position="row"``: the month_number-th observed
    month of the cohort in calendar order, as read off the compat tables.  The
    windows run on aggregated (cohort, month) rows, of which there are as many as pairs of calendar
    months at most; retention is evaluated once.
    """
    if position == "offset":
        at = retention.where(F.col("month_offset") == month_number - 1)
    elif position == "row":
        rn = F.row_number().over(Window.partitionBy("cohort").orderBy("year_month"))
        at = retention.withColumn("_rn", rn).where(F.col("_rn") == month_number)
    else:
        raise ValueError("position must be 'offset' or 'row'")
    at = at.where("percentage IS NOT NULL").select("cohort", "percentage", "customers_quantity")
    place = F.rank().over(Window.partitionBy().orderBy(F.desc("percentage")))
    return at.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")
