"""RFM segmentation.

Plan: detail rows are aggregated once per order and once per person (two
shuffles); the global statistics (recency/monetary quintiles, frequency range)
are one-row scalar subqueries computed with the exact ordered-quantile plan,
so no group is ever gathered into one task and no join without a key appears.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlytics.functions.columns import (
    REFERENCE_EXCLUDED_STATUSES, RFM_SEGMENT_RULES, cut_equal_width, days_since, half_even,
    quantile_score, relabel, within_days)
from cartlytics.operators.commerce import paid
from cartlytics.plans.ordered import quantiles_wide
from cartlytics.session import materialise

_P = "customer_unique_id"
QUINTILES = (0.2, 0.4, 0.6, 0.8)


def order_values(cust_orders: DataFrame, order_items: DataFrame,
                 excluded_statuses: Sequence[str] = REFERENCE_EXCLUDED_STATUSES) -> DataFrame:
    """Per paid order: (order_id, order_purchase_timestamp, person, price).

    Item prices are summed per order *before* the join (partial + final
    aggregate), so the join sees one row per order on both sides: an order
    with a huge number of items cannot skew it, and the aggregate's order_id
    partitioning is reused by the join.  An order whose prices are all NULL
    sums to 0.0 (D4); orders without items drop out as in an inner join.
    """
    o = paid(cust_orders, excluded_statuses).select(
        "order_id", "order_purchase_timestamp", _P)
    totals = order_items.groupBy("order_id").agg(
        F.coalesce(F.sum("price"), F.lit(0.0)).alias("price"))
    return o.join(totals, "order_id")


def rfm_base(cust_orders: DataFrame, order_items: DataFrame, as_of, period_days: int = 7 * 365,
             excluded_statuses: Sequence[str] = REFERENCE_EXCLUDED_STATUSES,
             money_decimals: int | None = 6) -> DataFrame:
    """Per person recency (days since last order), frequency (orders on or
    after as_of - period_days), monetary (sum of order values).

    Floating sums depend on the order rows arrive in; monetary is rounded to
    ``money_decimals`` so that every evaluation of this table has the same values.
    """
    ov = order_values(cust_orders, order_items, excluded_statuses).where(F.col(_P).isNotNull())
    monetary = F.sum("price")
    if money_decimals is not None:
        monetary = F.round(monetary, money_decimals)
    return ov.groupBy(_P).agg(
        F.min(days_since(as_of, "order_purchase_timestamp")).alias("recency"),
        F.count_if(within_days("order_purchase_timestamp", as_of, period_days)).alias("frequency"),
        monetary.alias("monetary"))


def rfm_thresholds(base: DataFrame, n_buckets: int | None = None) -> dict:
    """Scalar-subquery columns r20..r80, m20..m80 (exact quintiles of recency
    and monetary, ONE ordered-quantile plan keyed by column) and f_min/f_max."""
    long = base.select(F.col("recency").cast("double").alias("recency"),
                       F.col("monetary").cast("double").alias("monetary")) \
        .unpivot([], ["recency", "monetary"], "column", "value")
    q = quantiles_wide(long, "value", QUINTILES, ["q20", "q40", "q60", "q80"], keys=["column"],
                       n_buckets=n_buckets)
    names = {"recency": "r", "monetary": "m"}
    one = q.agg(*[F.max(F.when(F.col("column") == c, F.col(f"q{k}"))).alias(f"{p}{k}")
                  for c, p in names.items() for k in (20, 40, 60, 80)])
    f = base.agg(F.min("frequency").cast("double").alias("f_min"),
                 F.max("frequency").cast("double").alias("f_max"))
    cols = {c: one.select(c).scalar() for c in one.columns}
    cols.update({c: f.select(c).scalar() for c in f.columns})
    return cols


def rfm_scores(base: DataFrame, n_buckets: int | None = None, frequency_bins: int = 5) -> DataFrame:
    """R (5 = most recent quintile), f (equal-width bin 1..5), m (1..5)."""
    base = materialise(base)  # thresholds and scores read one table of persons
    t = rfm_thresholds(base, n_buckets)
    return base.select(
        "*",
        quantile_score("recency", [t["r20"], t["r40"], t["r60"], t["r80"]], ascending=False).alias("r"),
        cut_equal_width(F.col("frequency").cast("double"), t["f_min"], t["f_max"],
                        frequency_bins).alias("f"),
        quantile_score("monetary", [t["m20"], t["m40"], t["m60"], t["m80"]], ascending=True).alias("m"))


def rfm_segments(scores: DataFrame, rules=RFM_SEGMENT_RULES) -> DataFrame:
    """3-digit code and segment label (first matching rule; else the code)."""
    code = F.concat(F.col("r").cast("string"), F.col("f").cast("string"), F.col("m").cast("string"))
    return (scores.withColumn("rfm_code", code)
                  .withColumn("segment", relabel("rfm_code", rules))
                  .withColumn("unmapped", F.col("segment") == F.col("rfm_code")))


def segment_shares(segments: DataFrame, decimals: int = 3) -> DataFrame:
    """R10 / PRF7: percent of people per segment.

    The total is a window over the aggregated rows: at most 125 codes + 5
    labels exist, so the one partition it uses is bounded by construction
    (a scalar subquery here would re-plan the nested RFM subqueries).
    """
    counts = segments.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))
    total = F.sum("customers").over(Window.partitionBy())
    return counts.withColumn("percentage", half_even(F.col("customers") * 100.0 / total, decimals))
