"""Mergeable sketches of users and order values (AGG6, D6, X4).

A table of sketches has one row for each (group, date): a HyperLogLog sketch of its users, a KLL sketch of its order values, and the exact
number of rows.  Sketches of any rows are merged without the details: running distinct users, users and
quantiles of any period.  New days are merged into a stored table by ``merge_sketches``; the result equals the
sketch of all rows together up to the stated error.

Errors: HyperLogLog with 2**lg_k registers has a relative standard error of 1.04 / sqrt(2**lg_k), 1.6% at 12; KLL with
parameter k has a rank error below 2.296 / k**0.9021 with 99% confidence, 0.55% at 800.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LG_K = 12
KLL_K = 800
KEYS = ("group", "date")


def users_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a number of users."""
    return 1.04 / 2 ** (lg_k / 2)


def rank_error(k: int = KLL_K) -> float:
    """Rank error of a quantile, as a share of the rows (99% confidence)."""
    return 2.296 / k ** 0.9021


def sketch_table(order_metrics: DataFrame, keys: Sequence[str] = KEYS, user: str = "user_id", value: str = "sum_price",
                 lg_k: int = LG_K, kll_k: int = KLL_K) -> DataFrame:
    """keys..., rows, users (sketch), amounts (sketch) from one aggregate over the details."""
    return order_metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(F.col(user), F.lit(lg_k)).alias("users"),
                                            F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(kll_k)).alias("amounts"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row a key: to coarser keys, or of several tables after a union."""
    return sketches.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("amounts").alias("amounts"))


def estimates(sketches: DataFrame, probs: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """rows, n_users (estimate) and a quantile q<percent> of the amounts for each probability, in place of the sketches."""
    others = [c for c in sketches.columns if c not in ("users", "amounts")]
    quantiles = [F.kll_sketch_get_quantile_double("amounts", F.lit(float(p))).alias(f"q{round(p * 100)}") for p in probs]
    return sketches.select(*others, F.hll_sketch_estimate("users").alias("n_users"), *quantiles)


def running_users(sketches: DataFrame, within: Sequence[str] = ("group",), by: str = "date") -> DataFrame:
    """within..., by, n_users: distinct users from the first day to this one, from the day rows alone (their number
    is bounded by the calendar)."""
    so_far = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return sketches.select(*within, by, F.hll_sketch_estimate(F.hll_union_agg("users").over(so_far)).alias("n_users"))
