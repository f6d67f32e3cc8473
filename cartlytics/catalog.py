"""Registered queries over the driver's test tables.

Each entry takes (spark, sf_dir) and returns a lazy DataFrame that runs one
library operator over the whole tables.  Floating columns are rounded to 6
decimals so results can be compared by value hash with the SQL oracle
(``cartlytics.oracle``); the operators themselves return full precision.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlytics.functions.pvalues import tail_arguments, upper_tail
from cartlytics.functions.columns import month_label
from cartlytics.operators import abtests, bootstrap, cohort, commerce, display, experiment, histogram, little_bootstrap, person_state, profile, rfm, sketches
from cartlytics.sources.layout import colocated, layout_name
from cartlytics.sources.readers import read_table, table_path
from cartlytics.session import materialise, shared_folder
from cartlytics.sources import testdata as td
from cartlytics.sources.csv_files import load_csv_table
from cartlytics.sources.schemas import TEST_TABLES, schema_report

P = td.PARAMS
BOOT_RESAMPLES = 2000
BOOT_BLOCKS = 1024
BOOT_SEED = 42
TOP = 20
ROWS_A_TASK = 1_000_000  # of one key in a join
BUCKETS = 16
COHORT_RANGE = ("1995-02-01", "1995-09-30")
COHORT_PERIODS = {"1995-02": 3, "1995-03": 5, "1995-04": 4}  # the other cohorts are shown whole


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals (for hash comparison).

    A first rounding at 10 decimals absorbs last-bit noise of floating sums, so
    a value that is exactly on a 6-decimal tie rounds the same way however its
    sum was ordered (the SQL oracle rounds a DECIMAL(38,10) the same way).
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.round(F.col(f"`{f.name}`"), 10), 6).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


# --- shared inputs ---------------------------------------------------------

def _co(spark, d):
    return commerce.customer_orders(td.customers(spark, d), td.orders(spark, d))


def _lines(spark, d):
    return experiment.ab_order_lines(td.ab_users_data(spark, d), td.ab_orders(spark, d),
                                     td.ab_products(spark, d))


def _order_metrics(spark, d):
    return experiment.ab_order_metrics_preagg(td.ab_users_data(spark, d), td.ab_order_products(spark, d),
                                              td.ab_products(spark, d))


def _metrics_long(spark, d):
    return experiment.metric_long_from_order_metrics(_order_metrics(spark, d))


def _rfm_base(spark, d):
    return rfm.rfm_base(_co(spark, d), td.order_items(spark, d), P["as_of"], P["period_days"],
                        P["excluded_statuses"])


def _rfm_segments(spark, d):
    return rfm.rfm_segments(rfm.rfm_scores(_rfm_base(spark, d)))


def _retention(spark, d, mode):
    return cohort.cohort_retention(_co(spark, d), P["excluded_statuses"], mode=mode)


def _by_order(spark, d, table, df):
    """A table laid out by order_id, once for all queries over ``d``."""
    return colocated(df, layout_name(table, d, ["order_id"], BUCKETS), ["order_id"], BUCKETS)


def _orders_laid_out(spark, d):
    return _by_order(spark, d, "orders", _co(spark, d)), _by_order(spark, d, "items", td.order_items(spark, d))


def _items_from_csv(spark, d):
    """The items table as a user's export has it (an index without a name, columns in another order, one more column, none for
    freight, NA and a text for some prices, one cell too many in some lines), read by its header."""
    order = F.col("order_id") % 100
    price = F.when(order == 7, F.lit("free")).when(order.isin(9, 13), F.lit("NA")).otherwise(F.col("price").cast("string"))
    cells = {"": "order_item_id", "price": price, "note": F.when(order == 13, F.lit("a,b")).otherwise(F.lit("x")), "product_id": "product_id",
             "order_item_id": "order_item_id", "shipping_limit_date": F.date_format("shipping_limit_date", "yyyy-MM-dd HH:mm:ss"), "seller_id": "seller_id", "order_id": "order_id"}
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}-csv"
    # one column with whole lines, under the header as its name
    (td.order_items(spark, d).select(F.concat_ws(",", *cells.values()).alias(",".join(cells)))
     .write.option("header", True).option("sep", "\u0001").option("quote", "\u0000").csv(path))
    return load_csv_table(spark, path, "order_items")


# --- queries ---------------------------------------------------------------

SOURCES = ("customer", "orders", "lineitem")


def q_csv_items(spark, d):
    """SRC1/SRC2: the good rows of an exported items file."""
    return r6(_items_from_csv(spark, d).rows)


def q_csv_quarantine(spark, d):
    """SRC1/SRC2: the bad lines of that file, each once."""
    return _items_from_csv(spark, d).quarantine.select("line", F.array_join("faults", ",").alias("faults"))


def q_csv_counts(spark, d):
    """SRC1/SRC2: bad cells by column, counted in the pass that reads the file."""
    return _items_from_csv(spark, d).counts


def q_schema_report(spark, d):
    """PRF2: the tables' columns against the wanted ones."""
    return schema_report({t: read_table(spark, d, t) for t in (*SOURCES, "part")}, TEST_TABLES)


def q_null_profile(spark, d):
    """Missing values of every column of all three source tables."""
    return display.union_all([profile.null_profile_of_files(spark, table_path(d, t)).select(F.lit(t).alias("table"), "column", "null_count")
                              for t in SOURCES])


def q_null_profile_of_frame(spark, d):
    """The same of a frame that is no file: the order lines of the A/B data."""
    return profile.null_profile(_lines(spark, d))


def q_describe_lineitem(spark, d):
    """describe() of every numeric column of the items table."""
    li = read_table(spark, d, "lineitem")
    return r6(profile.describe(li, [f.name for f in li.schema.fields if isinstance(f.dataType, T.NumericType)]))


def q_top_products(spark, d):
    """R3 as displayed: by quantity, largest first, ties by product."""
    best = commerce.top_weekday_per_product(td.orders(spark, d), td.order_items(spark, d), P["excluded_statuses"])
    return display.preview(best, TOP, by=[("quantity", False)], tiebreak=["product_id"])


def q_top_buyers_per_week(spark, d):
    """R4 as displayed: by rate, largest first, ties by month and person."""
    rates = commerce.purchases_per_week(_co(spark, d), P["excluded_statuses"])
    return r6(display.preview(rates, TOP, by=[("avg_purchases_per_week", False)], tiebreak=["year_month", "customer_unique_id"]))


def q_cohort_retention_range(spark, d):
    """R5 as asked: a range of cohorts, a number of months for each, and the month as a label."""
    got = cohort.cohort_retention(_co(spark, d), P["excluded_statuses"], n_periods=COHORT_PERIODS,
                                  cohort_from=COHORT_RANGE[0], cohort_to=COHORT_RANGE[1])
    return r6(got.withColumn("cohort_label", month_label("cohort")))


def q_histogram_cumulative_orders(spark, d):
    """H1 on integers: the running number of orders by day."""
    return r6(histogram.histogram_auto(experiment.cumulative_orders(_order_metrics(spark, d)), "cumulative_orders",
                                       keys=["group"]))


def q_contingency(spark, d):
    return r6(abtests.contingency(td.ab_users_data(spark, d), "group", "action"))


def q_log_metric_checks(spark, d):
    """Equality of variances and normality of the logs of the metrics, with verdicts."""
    logs = materialise(experiment.log_metric(_metrics_long(spark, d), keep_original=False))  # read by both tests
    even = abtests.levene(logs).select(F.lit("levene").alias("test"), "metric", F.lit(None).cast("int").alias("group"),
                                       F.col("w").alias("statistic"), "p_value", F.col("equal_var").alias("holds"))
    normal = abtests.normality(logs).select(F.lit("normality").alias("test"), "metric", "group",
                                            F.col("k2").alias("statistic"), "p_value", F.col("normal").alias("holds"))
    return r6(display.union_all([even, normal]))


def q_describe_price(spark, d):
    return r6(profile.describe(td.order_items(spark, d), ["price"]))


def q_quantile_p95(spark, d):
    return r6(profile.quantile(td.order_items(spark, d), "price", 0.95))


def q_price_tail(spark, d):
    return r6(profile.tail_profile(td.order_items(spark, d), "price", 0.95))


def q_order_value_profile(spark, d):
    return r6(profile.price_profile(td.order_items(spark, d)))


def q_value_counts_status(spark, d):
    return profile.value_counts(td.orders(spark, d), "order_status")


def q_orders_shape(spark, d):
    return profile.shape_of_files(spark, table_path(d, "orders"))


def q_lines_shape(spark, d):
    """PRF3 of a frame that is no file."""
    return profile.shape(_lines(spark, d))


def q_status_shares(spark, d):
    return r6(profile.value_counts(td.orders(spark, d), "order_status", normalize=True, decimals=3))


def q_inner_join_customer_orders(spark, d):
    return _co(spark, d)


def q_items_join(spark, d):
    return commerce.order_lines(td.orders(spark, d), td.order_items(spark, d))


def q_items_join_hot_keys(spark, d):
    """JN1 with hot orders looked for and cut into fragments."""
    return commerce.order_lines(td.orders(spark, d), td.order_items(spark, d), rows_a_task=ROWS_A_TASK)


def q_customer_orders_hot_keys(spark, d):
    return commerce.customer_orders(td.customers(spark, d), td.orders(spark, d), rows_a_task=ROWS_A_TASK)


def q_ab_order_lines_hot_keys(spark, d):
    """X1 with hot orders and products looked for and cut into fragments."""
    return r6(experiment.ab_order_lines(td.ab_users_data(spark, d), td.ab_orders(spark, d), td.ab_products(spark, d), rows_a_task=ROWS_A_TASK))


def q_items_join_colocated(spark, d):
    """JN1 from tables laid out by order: no exchange."""
    o, items = _orders_laid_out(spark, d)
    return commerce.order_lines(o, items)


def q_rfm_base_colocated(spark, d):
    """R7 from tables laid out by order: the only exchange is by person."""
    o, items = _orders_laid_out(spark, d)
    return r6(rfm.rfm_base(o, items, P["as_of"], P["period_days"], P["excluded_statuses"]))


def q_ab_order_metrics_colocated(spark, d):
    """X2 from tables laid out by order."""
    users = _by_order(spark, d, "ab_users", td.ab_users_data(spark, d))
    lines = _by_order(spark, d, "ab_lines", td.ab_order_products(spark, d))
    return r6(experiment.ab_order_metrics_preagg(users, lines, td.ab_products(spark, d)))


def q_explode_product_sets(spark, d):
    return experiment.order_products(td.ab_orders(spark, d))


def q_one_time_buyers(spark, d):
    return commerce.one_time_buyers(_co(spark, d), P["excluded_statuses"])


def q_undelivered_by_reason(spark, d):
    return r6(commerce.undelivered_by_reason(_co(spark, d), P["undelivered_statuses"]))


def q_top_weekday_per_product(spark, d):
    return commerce.top_weekday_per_product(td.orders(spark, d), td.order_items(spark, d),
                                            P["excluded_statuses"])


def q_purchases_per_week(spark, d):
    return r6(commerce.purchases_per_week(_co(spark, d), P["excluded_statuses"]))


def q_cohort_retention(spark, d):
    return r6(_retention(spark, d, "proper"))


def q_cohort_retention_compat(spark, d):
    return r6(_retention(spark, d, "compat"))


def q_best_cohort(spark, d):
    return r6(cohort.best_cohort(_retention(spark, d, "proper"), month_number=3))


def q_best_cohort_compat(spark, d):
    """R6 as the reference reads it: compat tables, third observed month."""
    return r6(cohort.best_cohort(_retention(spark, d, "compat"), month_number=3, position="row"))


def q_rfm_base(spark, d):
    return r6(_rfm_base(spark, d))


def q_rfm_scores(spark, d):
    return r6(rfm.rfm_scores(_rfm_base(spark, d)))


def q_rfm_segments(spark, d):
    return r6(_rfm_segments(spark, d))


def q_segment_shares(spark, d):
    return r6(rfm.segment_shares(_rfm_segments(spark, d)))


def q_histogram_price_auto(spark, d):
    return r6(histogram.histogram_auto(td.order_items(spark, d), "price"))


def q_histogram_order_value_auto(spark, d):
    return r6(histogram.histogram_auto(profile.order_totals(td.order_items(spark, d)), "price"))


def q_histogram_user_totals(spark, d):
    totals = experiment.user_metric_totals(experiment.log_metric(_metrics_long(spark, d)))
    return r6(histogram.histogram_fixed(totals, "value", keys=["metric", "group"], bins=10))


def q_ab_order_lines(spark, d):
    return r6(_lines(spark, d))


def q_ab_order_metrics(spark, d):
    return r6(_order_metrics(spark, d))


def q_ab_user_orders(spark, d):
    return experiment.ab_user_orders(_order_metrics(spark, d))


def q_split_check(spark, d):
    return experiment.split_check(_order_metrics(spark, d))


def q_group_summary(spark, d):
    return r6(experiment.group_summary(_order_metrics(spark, d)))


def q_cumulative_orders(spark, d):
    return experiment.cumulative_orders(_order_metrics(spark, d))


def q_group_summary_excl_cancelled(spark, d):
    om = experiment.ab_order_metrics_preagg(td.ab_users_data(spark, d), td.ab_order_products(spark, d),
                                            td.ab_products(spark, d), exclude_cancelled=True)
    return r6(experiment.group_summary(om))


def q_log_dropped(spark, d):
    return experiment.log_dropped(_metrics_long(spark, d))


def q_sketched_users_by_day(spark, d):
    """AGG6/X4 from day sketches: the running number of users, and whether the sketches are within three standard errors of it."""
    om = materialise(_order_metrics(spark, d))
    first = om.groupBy("group", "user_id").agg(F.min("date").alias("date")).groupBy("group", "date").agg(F.count(F.lit(1)).alias("new"))
    days = om.select("group", "date").distinct().join(first, ["group", "date"], "left")
    so_far = Window.partitionBy("group").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    exact = days.select("group", "date", F.sum(F.coalesce("new", F.lit(0))).over(so_far).alias("users"))
    got = exact.join(sketches.running_users(materialise(sketches.sketch_table(om))), ["group", "date"])
    return got.select("group", "date", "users", (F.abs(F.col("n_users") / F.col("users") - 1) <= 3 * sketches.users_error()).alias("within"))


def q_sketched_quantiles(spark, d):
    """D6 from day sketches: per group the rows, and whether the merged quantiles are within the sketches' rank error."""
    om = materialise(_order_metrics(spark, d))
    got = sketches.estimates(sketches.merge_sketches(sketches.sketch_table(om), ["group"]), (0.5, 0.95))
    both = om.join(materialise(got), "group").groupBy("group").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(cond).alias(n) for q in (50, 95) for n, cond in (
            (f"below{q}", F.col("sum_price") < F.col(f"q{q}")), (f"upto{q}", F.col("sum_price") <= F.col(f"q{q}")))])
    slack = F.col("rows") * sketches.rank_error()
    ok = [((F.col(f"below{q}") - slack <= F.col("rows") * q / 100) & (F.col("rows") * q / 100 <= F.col(f"upto{q}") + slack)).alias(f"within{q}") for q in (50, 95)]
    return both.select("group", "rows", *ok)


def _state(spark, d):
    """The person state of all orders in three batches that overlap in time."""
    co, items, paid = _co(spark, d), td.order_items(spark, d), P["excluded_statuses"]
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}-state"
    for k in range(3):
        person_state.append_batch(person_state.person_days(co.where(F.pmod(F.xxhash64("order_id"), F.lit(3)) == k), items, paid), path, f"b{k}")
    return person_state.read_state(spark, path)


def q_retention_from_state(spark, d):
    """R5 from merged batches of partial aggregates."""
    return r6(person_state.retention_from_state(_state(spark, d)))


def q_rfm_base_from_state(spark, d):
    """R7 from merged batches of partial aggregates."""
    return r6(person_state.rfm_base_from_state(_state(spark, d), P["as_of"], P["period_days"]))


def q_cancel_rate(spark, d):
    return r6(experiment.cancel_rate(td.ab_users_data(spark, d)))


def q_normality_k2(spark, d):
    return r6(abtests.normality(_metrics_long(spark, d)))


def q_log_normality_k2(spark, d):
    logs = experiment.log_metric(_metrics_long(spark, d), keep_original=False)
    return r6(abtests.normality(logs))


def q_t_test_pooled(spark, d):
    return r6(abtests.t_test(_metrics_long(spark, d), equal_var=True))


def q_t_test_welch(spark, d):
    return r6(abtests.t_test(_metrics_long(spark, d), equal_var=False))


def q_levene(spark, d):
    return r6(abtests.levene(_metrics_long(spark, d)))


def q_mann_whitney(spark, d):
    return r6(abtests.mann_whitney(_metrics_long(spark, d)))


def q_chi2_yates(spark, d):
    return r6(abtests.chi2_independence(td.ab_users_data(spark, d), "group", "action"))


def q_bootstrap_replicates(spark, d):
    return r6(bootstrap.bootstrap_replicates(_metrics_long(spark, d), n_resamples=BOOT_RESAMPLES,
                                             seed=BOOT_SEED, n_blocks=BOOT_BLOCKS))


def q_bootstrap_mean_ci(spark, d):
    return r6(bootstrap.bootstrap_mean_ci(_metrics_long(spark, d), n_resamples=BOOT_RESAMPLES,
                                          seed=BOOT_SEED, n_blocks=BOOT_BLOCKS))


def q_bootstrap_full_size(spark, d):
    """X13 with resamples of each group's whole size; random by seed, so without SQL."""
    return r6(little_bootstrap.little_bootstrap_ci(_metrics_long(spark, d), n_resamples=BOOT_RESAMPLES, seed=BOOT_SEED))


def q_ab_test_pvalues(spark, d):
    """Every test with its p-value: the statistics of all tests are unioned with the arguments of
    their tail (``pvalues.tail_arguments``), and the tail is evaluated once over these few rows."""
    long = materialise(experiment.log_metric(_metrics_long(spark, d)))  # read by all tests

    def rows(df, test, stat, kind, df1=None, df2=None, group=None, tail=None):
        v, k, c = tail_arguments(kind, tail or stat, df1, df2)
        return df.select(F.lit(test).alias("test"), "metric",
                         (F.col(group) if group else F.lit(None)).cast("int").alias("group"),
                         F.col(stat).cast("double").alias("statistic"), v.alias("_v"), k.alias("_k"), c.alias("_c"))

    chi = abtests.chi2_independence(td.ab_users_data(spark, d), "group", "action", with_p=False) \
        .withColumn("metric", F.lit("cancel_share"))
    whitney = abtests.mann_whitney(long, with_p=False).withColumn("_tail", F.greatest("z", F.lit(0.0)))
    parts = [
        rows(abtests.t_test(long, True, with_p=False), "t_pooled", "t", "t", "df"),
        rows(abtests.t_test(long, False, with_p=False), "t_welch", "t", "t", "df"),
        rows(abtests.levene(long, with_p=False), "levene", "w", "f", "df1", "df2"),
        rows(whitney, "mann_whitney", "u_a", "z", tail="_tail"),
        rows(abtests.normality(long, with_p=False), "normality", "k2", "k2", group="group"),
        rows(chi, "chi2", "statistic", "chi2", "dof"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return r6(out.withColumn("p_value", upper_tail("_v", "_k", "_c")).select(
        "test", "metric", "group", "statistic", "p_value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}

