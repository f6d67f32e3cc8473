"""Hot keys: found whatever the partitions, cut into fragments, no pair lost or doubled."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cartlytics.operators import commerce, experiment
from cartlytics.plans.skew import frequent_keys, hot_fragments, skew_join
from tests.conftest import rows


def orders_and_items(spark, n=9000):
    """A third of the items on one order, and two orders rows of that key; NULL keys on both sides."""
    items = spark.range(0, n, 1, 6).selectExpr("case when id % 3 = 0 then 7 when id % 100 = 1 then null else id % 500 end as order_id", "id % 11 as product_id")
    orders = spark.range(0, 600, 1, 3).selectExpr("case when id >= 590 then 7 when id = 5 then null else id end as order_id", "id as status")
    return orders, items


def test_frequent_keys_are_exact(spark):
    _, items = orders_and_items(spark)
    got = {r["order_id"]: r["n"] for r in frequent_keys(items, ["order_id"], 0.05).collect()}
    assert got == {7: items.where("order_id = 7").count()}
    assert frequent_keys(items.where("order_id <> 7"), ["order_id"], 0.05).count() == 0
    assert frequent_keys(items.limit(0), ["order_id"]).count() == 0
    two = frequent_keys(items.withColumn("p", F.lit("x")), ["order_id", "p"], 0.2).collect()
    assert [(r["order_id"], r["p"]) for r in two] == [(7, "x")]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_as_the_plain_join(spark, how):
    orders, items = orders_and_items(spark)
    for left, right in ((items, orders), (orders, items)):
        want = Counter(map(tuple, left.join(right, "order_id", how).collect()))
        got = skew_join(left, right, ["order_id"], how, share=0.01, rows_a_task=250)
        assert Counter(map(tuple, got.collect())) == want
        assert got.columns == left.join(right, "order_id", how).columns


def test_both_sides_hot(spark):
    left = spark.range(0, 3000, 1, 5).selectExpr("case when id % 3 = 0 then 1 else id end as k", "id as a")
    right = spark.range(0, 900, 1, 4).selectExpr("case when id % 3 = 0 then 1 else id end as k", "id as b")
    frags = hot_fragments(left, right, ["k"], rows_a_task=100).collect()
    assert [(r["k"], r["_l"], r["_r"]) for r in frags] == [(1, 11, 4)]
    got = skew_join(left, right, ["k"], rows_a_task=100)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, "k").collect()))


def test_largest_task_is_near_the_mean(spark):
    """A third of the rows on one key: rows of the join in each of 16 tasks, without help from AQE."""
    items = spark.range(0, 12000, 1, 8).selectExpr("case when id % 3 = 0 then 7 else id % 4000 end as k", "id as x")
    other = spark.range(0, 4000).selectExpr("id as k", "id as y")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = skew_join(items, other, ["k"], rows_a_task=50)
        plain = items.repartition(16, "k").groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        sizes = [r["count"] for r in tasks.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 12000 and plain > 4000 and max(sizes) < 2 * 12000 / 16


def test_operators_on_hot_keys(spark):
    customers = spark.range(0, 100).selectExpr("cast(id as string) as customer_id", "concat('p', id) as customer_unique_id")
    orders = spark.range(0, 3000).selectExpr("cast(id as string) as order_id", "cast(if(id % 3 = 0, 5, id % 120) as string) as customer_id")
    want = rows(commerce.customer_orders(customers, orders))
    assert rows(commerce.customer_orders(customers, orders, rows_a_task=200)) == want
    users = spark.range(0, 50).selectExpr("id as user_id", "id as order_id", "'create_order' as action", "date'2022-01-01' as date", "cast(id % 2 as int) as group")
    lines = spark.range(0, 2000).selectExpr("if(id % 3 = 0, 7, id % 60) as order_id", "if(id % 2 = 0, 3, id % 9) as product_id")
    products = spark.range(0, 9).selectExpr("id as product_id", "cast(id as double) as price")
    want = rows(experiment.ab_order_lines(users, lines, products))
    assert rows(experiment.ab_order_lines(users, lines, products, rows_a_task=100)) == want
