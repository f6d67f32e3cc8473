"""Sketches against exact numbers, and states that merge to what a full run gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cartlytics import catalog as C
from cartlytics.operators import cohort, person_state, rfm, sketches
from cartlytics.sources import testdata as td
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


def orders_frame(spark, n=20000):
    return spark.range(0, n).selectExpr("cast(pmod(hash(id), 2) as int) as group", "date_add(date'2022-01-01', cast(id % 30 as int)) as date", "pmod(hash(id, 1), 7000) as user_id",
                                        "exp(pmod(hash(id, 2), 1000) / 200.0) as sum_price")


def test_errors_hold_and_any_split_merges_to_the_same(spark):
    om = orders_frame(spark)
    whole = sketches.merge_sketches(sketches.sketch_table(om), ["group"])
    parts = [sketches.sketch_table(om.where(F.pmod(F.hash("user_id", "sum_price"), F.lit(3)) == k)) for k in range(3)]
    merged = sketches.merge_sketches(sketches.merge_sketches(parts[0].unionByName(parts[1])).unionByName(parts[2]), ["group"])
    exact = {r["group"]: r for r in om.groupBy("group").agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("n")).collect()}
    for table in (whole, merged):
        for r in sketches.estimates(table, [0.1, 0.5, 0.95]).collect():
            true = exact[r["group"]]
            assert r["rows"] == true["n"] and abs(r["n_users"] / true["users"] - 1) < 3 * sketches.users_error()
            for p, name in ((0.1, "q10"), (0.5, "q50"), (0.95, "q95")):
                mine = om.where(F.col("group") == r["group"])
                low, high = mine.where(F.col("sum_price") < r[name]).count(), mine.where(F.col("sum_price") <= r[name]).count()
                slack = sketches.rank_error() * true["n"]
                assert low - slack <= p * true["n"] <= high + slack


def test_running_users(spark):
    om = orders_frame(spark)
    got = sketches.running_users(sketches.sketch_table(om)).collect()
    first = om.groupBy("group", "user_id").agg(F.min("date").alias("date")).groupBy("group", "date").count().collect()
    for r in got:
        true = sum(x["count"] for x in first if x["group"] == r["group"] and x["date"] <= r["date"])
        assert abs(r["n_users"] / true - 1) < 4 * sketches.users_error()
    assert len(got) == 60 and sketches.sketch_table(om.limit(0)).count() == 0


@pytest.fixture(scope="module")
def frames(spark):
    return C._co(spark, SF), td.order_items(spark, SF)


def test_history_and_delta_give_the_full_result(spark, frames, tmp_path):
    co, items = frames
    paid = C.P["excluded_statuses"]
    splits = {  # by time, by person, at random (late rows of every day)
        "time": F.when(F.col("order_purchase_timestamp") < "1998-01-01", 0).otherwise(1),
        "person": F.pmod(F.hash("customer_unique_id"), F.lit(3)),
        "random": F.pmod(F.hash("order_id"), F.lit(4)),
    }
    want_r = rows(cohort.cohort_retention(co, paid))
    want_f = rows(rfm.rfm_base(co, items, C.P["as_of"], C.P["period_days"], paid), "customer_unique_id", "recency", "frequency", "monetary")
    for name, part in splits.items():
        path = str(tmp_path / name)
        for k in range(4):
            batch = co.withColumn("_b", part).where(F.col("_b") == k).drop("_b")
            for _ in range(2 if k == 1 else 1):  # a batch that is written again counts once
                person_state.append_batch(person_state.person_days(batch, items, paid), path, f"b{k}")
        state = person_state.read_state(spark, path)
        assert rows(person_state.retention_from_state(state), "cohort", "year_month", "customers_quantity", "month_offset", "percentage") == \
            rows(cohort.cohort_retention(co, paid), "cohort", "year_month", "customers_quantity", "month_offset", "percentage") and want_r
        got = rows(person_state.rfm_base_from_state(state, C.P["as_of"], C.P["period_days"]), "customer_unique_id", "recency", "frequency", "monetary")
        assert [g[:3] for g in got] == [w[:3] for w in want_f] and [g[3] for g in got] == pytest.approx([w[3] for w in want_f], abs=1e-5)
    small = person_state.compact(spark, path, str(tmp_path / "compact"))
    assert rows(small) == rows(state)


def test_other_dates_from_the_same_state(spark, frames):
    co, items = frames
    state = person_state.person_days(co, items, C.P["excluded_statuses"])
    for day, period in ((dt.date(1999, 5, 5), 100), (dt.date(2003, 1, 1), 4000)):
        got = rows(person_state.rfm_base_from_state(state, day, period), "customer_unique_id", "recency", "frequency")
        assert got == rows(rfm.rfm_base(co, items, day, period, C.P["excluded_statuses"]), "customer_unique_id", "recency", "frequency")


def test_bad_batch_name(spark, frames, tmp_path):
    with pytest.raises(ValueError, match="plain"):
        person_state.append_batch(person_state.person_days(*frames), str(tmp_path), "a/b")
