"""Bucketed layouts, and profiles that read footers."""

import re

from cartlytics import catalog as C
from cartlytics.operators import profile
from cartlytics.sources.layout import colocated
from cartlytics.sources.readers import read_table, table_path
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan_of(df))


def test_joins_and_sums_by_the_key_need_no_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = C.q_items_join_colocated(spark, SF)
        assert exchanges(joined) == [] and "SortMergeJoin" in plan_of(joined)
        assert rows(joined) == rows(C.q_items_join(spark, SF))
        base = C.q_rfm_base_colocated(spark, SF)
        assert [e for e in exchanges(base) if "order_id" in e] == [] and len(exchanges(base)) == 1
        assert [e for e in exchanges(C.q_items_join(spark, SF)) if "order_id" in e] or exchanges(C.q_items_join(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    metrics = C.q_ab_order_metrics_colocated(spark, SF)
    assert [e for e in exchanges(metrics) if e.startswith("order_id")] == []
    assert rows(metrics) == rows(C.q_ab_order_metrics(spark, SF))


def test_a_layout_is_written_once(spark):
    df = spark.range(0, 100).selectExpr("id % 7 as k", "id as v")
    first = colocated(df, "layout_once", ["k"], 4)
    again = colocated(df.where("k = 1"), "layout_once", ["k"], 4)
    assert rows(first) == rows(again) == rows(df)
    assert exchanges(first.groupBy("k").count()) == []


def test_null_profile_and_shape_come_from_footers(spark, tmp_path):
    nan = float("nan")
    data = [(1, None, 1.0), (None, "x", nan), (3, None, None), (4, "", 2.0)]
    for k in range(3):
        spark.createDataFrame(data, "id long, `a b` string, v double").write.mode("append").parquet(str(tmp_path / "t.parquet"))
    got = profile.null_profile_of_files(spark, str(tmp_path / "t.parquet"))
    assert rows(got, "column", "null_count") == [("a b", 6), ("id", 3), ("v", 6)]
    assert re.search(r"PushedAggregation: \[COUNT\(\*\), COUNT\(id\)", plan_of(got))
    read = re.findall(r"ReadSchema: struct<(.*?)>", plan_of(got).replace("\n", " "))
    assert not any("id:" in r for r in read)  # only the floating column is decoded
    size = profile.shape_of_files(spark, str(tmp_path / "t.parquet"))
    assert rows(size) == [(12, 3)] and "PushedAggregation: [COUNT(*)]" in plan_of(size)
    for t in ("orders", "lineitem"):
        assert rows(profile.null_profile_of_files(spark, table_path(SF, t))) == rows(profile.null_profile(read_table(spark, SF, t)))
    assert spark.conf.get("spark.sql.sources.useV1SourceList").count("parquet") == 1


def test_files_without_statistics_are_read(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"id": pa.array([1, None, 3]), "s": pa.array(["a", None, None])}), tmp_path / "u.parquet", write_statistics=False)
    assert rows(profile.null_profile_of_files(spark, str(tmp_path / "u.parquet"))) == [("id", 1), ("s", 2)]
