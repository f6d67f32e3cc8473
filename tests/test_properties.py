"""Invariants on the real test tables."""

from pyspark.sql import functions as F

from cartlytics import catalog as C
from cartlytics.operators import abtests, cohort, commerce, experiment
from cartlytics.sources import testdata as td
from tests.conftest import rows

SF = "/root/testdata/sf0.001"
P = td.PARAMS


def test_proper_retention_starts_at_100(spark):
    r = cohort.cohort_retention(C._co(spark, SF), P["excluded_statuses"])
    first = r.where(F.col("month_offset") == 0).select("percentage").distinct().collect()
    assert [x.percentage for x in first] == [100.0]
    assert r.where(F.col("month_offset") < 0).count() == 0


def test_mann_whitney_u_symmetry(spark):
    long = C._metrics_long(spark, SF)
    ab = {r.metric: r for r in abtests.mann_whitney(long, a=0, b=1, with_p=False).collect()}
    ba = {r.metric: r for r in abtests.mann_whitney(long, a=1, b=0, with_p=False).collect()}
    for m in ab:
        assert ab[m].u_a + ba[m].u_a == ab[m].n_a * ab[m].n_b


def test_results_do_not_depend_on_partitioning(spark):
    co = C._co(spark, SF)
    items = td.order_items(spark, SF)
    a = rows(commerce.top_weekday_per_product(td.orders(spark, SF), items, P["excluded_statuses"]))
    b = rows(commerce.top_weekday_per_product(td.orders(spark, SF).repartition(5),
                                              items.repartition(3), P["excluded_statuses"]))
    assert a == b
    assert rows(commerce.one_time_buyers(co, P["excluded_statuses"])) == \
        rows(commerce.one_time_buyers(co.repartition(7), P["excluded_statuses"]))


def test_preaggregated_order_metrics_equal_line_level(spark):
    users, orders_, products = td.ab_users_data(spark, SF), td.ab_orders(spark, SF), td.ab_products(spark, SF)
    a = rows(experiment.ab_order_metrics(experiment.ab_order_lines(users, orders_, products)))
    b = rows(experiment.ab_order_metrics_preagg(users, orders_, products))
    assert a == b


def test_exclude_cancelled_option(spark):
    users = td.ab_users_data(spark, SF)
    kept = experiment.created_orders(users, exclude_cancelled=True)
    cancelled = users.where(F.col("action") == "cancel_order").select("order_id")
    assert kept.join(cancelled, "order_id").count() == 0
    assert kept.count() == users.where("action = 'create_order'").count() - cancelled.count()


def test_split_check_approx_close(spark):
    om = C._order_metrics(spark, SF)
    exact = dict(rows(experiment.split_check(om)))
    approx = dict(rows(experiment.split_check(om, approx=True)))
    for g, n in exact.items():
        assert abs(approx[g] - n) <= max(3, 0.05 * n)


def test_a_hot_order_and_a_hot_product_are_split(spark):
    """A third of the lines are of one order, a third of one product: results equal the line-level
    plan, and AQE splits the skewed join."""
    n = 30_000
    lines = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 2999 + 2).alias("order_id"),
        F.when(F.col("id") % 3 == 1, 7).otherwise(F.col("id") % 997 + 8).alias("product_id"))
    products = spark.range(1, 1100).select(F.col("id").alias("product_id"), (F.col("id") % 50 + 0.25).alias("price"))
    users = spark.range(1, 3100).select((F.col("id") % 40).alias("user_id"), F.col("id").alias("order_id"), F.lit("create_order").alias("action"),
                                        F.lit("2020-01-01").cast("date").alias("date"), (F.col("id") % 2).cast("int").alias("group"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        pre = experiment.ab_order_metrics_preagg(users, lines, products)
        got = rows(pre)
        assert "skew=true" in pre._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == rows(experiment.ab_order_metrics(experiment.ab_order_lines(users, lines, products)))
