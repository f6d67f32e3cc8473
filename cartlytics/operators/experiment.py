"""A/B experiment data set and group metrics.

Statistical tests take a long frame (metric, group, value[, unit ids]) so that
every metric is tested by the same job (see ``abtests``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlytics.functions.columns import half_even, parse_id_set
from cartlytics.plans.skew import skew_join

CREATE, CANCEL = "create_order", "cancel_order"


def created_orders(users: DataFrame, exclude_cancelled: bool = False) -> DataFrame:
    """FLT3: create actions.  ``exclude_cancelled`` also drops orders that were
    cancelled later (left anti join on cancelled order ids)."""
    created = users.where(F.col("action") == CREATE)
    if exclude_cancelled:
        cancelled = users.where(F.col("action") == CANCEL).select("order_id")
        created = created.join(cancelled, "order_id", "left_anti")
    return created


def order_products(ab_orders: DataFrame) -> DataFrame:
    """FN8-FN10: one row per (order_id, product_id) from the '{a, b}' text; rows that are already of
    (order_id, product_id) are taken as they are."""
    if "product_ids" not in ab_orders.columns:
        return ab_orders.select("order_id", "product_id")
    return ab_orders.select("order_id", F.explode(parse_id_set("product_ids")).alias("product_id"))


def ab_order_lines(users: DataFrame, ab_orders: DataFrame, products: DataFrame,
                   exclude_cancelled: bool = False, rows_a_task: int | None = None) -> DataFrame:
    """Created orders x their products x product prices (two inner joins).  With ``rows_a_task``, orders and
    products that hold many rows are looked for and cut into fragments of so many (``plans.skew``)."""
    u = created_orders(users, exclude_cancelled).select("user_id", "order_id", "action", "date", "group")
    p = products.select("product_id", "price")
    lines = order_products(ab_orders)
    if rows_a_task is None:
        return u.join(lines, "order_id").join(p, "product_id")
    lines = skew_join(u, lines, ["order_id"], rows_a_task=rows_a_task)
    return skew_join(lines, p, ["product_id"], rows_a_task=rows_a_task)


def ab_order_metrics(lines: DataFrame, money_decimals: int | None = 6) -> DataFrame:
    """Per (user, group, order, date): number_of_products, sum_price.

    A floating sum depends on the order rows arrive in; ``money_decimals``
    rounds it so equal baskets tie exactly (ranks, medians) on every run.
    """
    s = F.coalesce(F.sum("price"), F.lit(0.0))
    if money_decimals is not None:
        s = F.round(s, money_decimals)
    return lines.groupBy("user_id", "group", "order_id", "date").agg(
        F.count("product_id").alias("number_of_products"), s.alias("sum_price"))


def ab_order_metrics_preagg(users: DataFrame, ab_orders: DataFrame, products: DataFrame,
                            exclude_cancelled: bool = False,
                            money_decimals: int | None = 6) -> DataFrame:
    """X2 computed without materialising the line-level join.

    Lines are first counted per (order, product), so that repeats of a hot order are one row each;
    these rows are priced (a hot product's rows are split by AQE, both sides of the join being
    shuffles) and summed per order (partial + final aggregate); the join to the create actions then has
    one row per order on each side.  Same result as ``ab_order_metrics(ab_order_lines(...))``."""
    p = products.select("product_id", "price")
    counted = order_products(ab_orders).where("product_id IS NOT NULL").groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("_k"))
    per_order = (counted.join(p, "product_id")
                 .groupBy("order_id").agg(F.sum("_k").alias("_n"), F.sum(F.col("_k") * F.col("price")).alias("_s")))
    u = created_orders(users, exclude_cancelled).select("user_id", "order_id", "date", "group")
    s = F.coalesce(F.sum("_s"), F.lit(0.0))
    if money_decimals is not None:
        s = F.round(s, money_decimals)
    return u.join(per_order, "order_id").groupBy("user_id", "group", "order_id", "date").agg(
        F.sum("_n").alias("number_of_products"), s.alias("sum_price"))


def ab_user_orders(lines: DataFrame) -> DataFrame:
    """Per (user, group): distinct orders.

    Accepts the order lines or the order metrics (one row per order): the
    latter reuses the per-order aggregate instead of re-reading the lines.
    """
    return lines.groupBy("user_id", "group").agg(F.countDistinct("order_id").alias("orders"))


def split_check(order_metrics: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct users per group (``approx``: HyperLogLog++ with relative
    standard deviation ``rsd``, one pass without the distinct shuffle)."""
    users = F.approx_count_distinct("user_id", rsd) if approx else F.countDistinct("user_id")
    return order_metrics.groupBy("group").agg(users.alias("users"))


def group_summary(order_metrics: DataFrame, control=0, decimals: int = 2) -> DataFrame:
    """Revenue, mean check, orders, mean products per group and the revenue
    uplift in percent against the control group (AGG13)."""
    s = order_metrics.groupBy("group").agg(
        F.sum("sum_price").alias("revenue"),
        half_even(F.avg("sum_price"), decimals).alias("mean_check"),
        F.countDistinct("order_id").alias("orders"),
        half_even(F.avg("number_of_products"), decimals).alias("mean_products"))
    base = F.max(F.when(F.col("group") == control, F.col("revenue"))).over(Window.partitionBy())  # one row a group
    return s.withColumn("uplift_pct", F.try_divide(F.col("revenue") * 100.0, base) - 100.0)


def cumulative_orders(order_metrics: DataFrame) -> DataFrame:
    """Running number of orders by day per group.

    Daily distinct counts first; the running sum is a window over the daily
    rows of each group (rows bounded by the number of days).
    """
    daily = order_metrics.groupBy("group", "date").agg(F.countDistinct("order_id").alias("orders"))
    w = Window.partitionBy("group").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cumulative_orders", F.sum("orders").over(w))


def cancel_rate(users: DataFrame) -> DataFrame:
    """Cancellations as percent of creations per group (AGG14)."""
    return users.groupBy("group").agg(
        F.count_if(F.col("action") == CREATE).alias("created"),
        F.count_if(F.col("action") == CANCEL).alias("cancelled")).withColumn(
        "cancel_rate_pct", F.try_divide(F.col("cancelled") * 100.0, F.col("created")))


def metric_long(order_metrics: DataFrame, user_orders: DataFrame | None = None,
                order_metric_names: Sequence[str] = ("sum_price", "number_of_products")) -> DataFrame:
    """Long frame (metric, group, user_id, unit_id, value) of all metrics.

    Order-level metrics have unit_id = order_id; the user-level ``orders``
    metric has unit_id = user_id.
    """
    om = order_metrics.select(
        "group", "user_id", F.col("order_id").alias("unit_id"),
        *[F.col(m).cast("double").alias(m) for m in order_metric_names])
    long = om.unpivot(["group", "user_id", "unit_id"], list(order_metric_names), "metric", "value")
    if user_orders is not None:
        uo = user_orders.select("group", "user_id", F.col("user_id").alias("unit_id"),
                                F.lit("orders").alias("metric"),
                                F.col("orders").cast("double").alias("value"))
        long = long.unionByName(uo)
    return long


def metric_long_from_lines(lines: DataFrame, money_decimals: int | None = 6) -> DataFrame:
    """Long frame of sum_price, number_of_products (per order) and orders (per
    user) from the order lines; see :func:`metric_long_from_order_metrics`."""
    return metric_long_from_order_metrics(ab_order_metrics(lines, money_decimals))


def metric_long_from_order_metrics(om: DataFrame) -> DataFrame:
    """Long frame of sum_price, number_of_products (per order) and orders (per
    user) as ONE chain: the per-order aggregate (X2) is re-aggregated with
    GROUPING SETS ((user, group, order, date), (user, group)), so both
    granularities come from a single scan and shuffle of the input and no
    distinct-count rewrite is needed (each order is one row already)."""
    agg = om.groupingSets(
        [["user_id", "group", "order_id", "date"], ["user_id", "group"]],
        "user_id", "group", "order_id", "date").agg(
        F.sum("number_of_products").alias("number_of_products"),
        F.sum("sum_price").alias("sum_price"),
        F.count(F.lit(1)).alias("orders"), F.grouping_id().alias("_gid"))
    rec = "struct<metric:string,unit_id:bigint,value:double>"
    order_rows = F.array(
        F.struct(F.lit("sum_price").alias("metric"), F.col("order_id").cast("bigint").alias("unit_id"),
                 F.col("sum_price").cast("double").alias("value")),
        F.struct(F.lit("number_of_products").alias("metric"),
                 F.col("order_id").cast("bigint").alias("unit_id"),
                 F.col("number_of_products").cast("double").alias("value")))
    user_rows = F.array(F.struct(F.lit("orders").alias("metric"),
                                 F.col("user_id").cast("bigint").alias("unit_id"),
                                 F.col("orders").cast("double").alias("value")))
    recs = F.when(F.col("_gid") == 0, order_rows).otherwise(user_rows).cast(f"array<{rec}>")
    return agg.select("group", "user_id", F.explode(recs).alias("_r")) \
        .select("_r.metric", "group", "user_id", "_r.unit_id", "_r.value")


def log_metric(long: DataFrame, suffix: str = "_log", keep_original: bool = True) -> DataFrame:
    """ln(value) as metric '<name>_log'.  ln of a value <= 0 is NULL and the
    row is dropped (D5); see :func:`log_dropped` for the count.

    Original and log rows come out of one ``explode`` (no union), so the input
    is computed once whatever the optimizer does with each branch.
    """
    logv = F.when(F.col("value") > 0, F.ln("value"))
    recs = [F.struct(F.concat(F.col("metric"), F.lit(suffix)).alias("metric"),
                     logv.alias("value"), F.lit(True).alias("is_log"))]
    if keep_original:
        recs.insert(0, F.struct(F.col("metric"), F.col("value").cast("double").alias("value"),
                                F.lit(False).alias("is_log")))
    others = [c for c in long.columns if c not in ("metric", "value")]
    out = long.select(*others, F.explode(F.array(*recs)).alias("_r"))
    out = out.where(~F.col("_r.is_log") | F.col("_r.value").isNotNull())
    return out.select(F.col("_r.metric").alias("metric"), *others, F.col("_r.value").alias("value"))


def log_dropped(long: DataFrame) -> DataFrame:
    """Rows per (metric, group) whose log is undefined (value <= 0 or NULL)."""
    return long.groupBy("metric", "group").agg(
        F.count_if(F.col("value").isNull() | (F.col("value") <= 0)).alias("dropped"))


def user_metric_totals(long: DataFrame) -> DataFrame:
    """Per (metric, group, user) sum of the metric (histogram input)."""
    return long.groupBy("metric", "group", "user_id").agg(F.sum("value").alias("value"))
