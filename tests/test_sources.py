"""Scans, schema checks and simple profiles."""

import datetime as dt

from cartlytics.operators import profile
from cartlytics.sources import check_schema, read_csv_table
from tests.conftest import rows


def test_csv_scan_with_fixed_schema(spark, tmp_path):
    p = tmp_path / "items.csv"
    p.write_text("order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
                 "o1,1,p1,s1,2017-09-19 09:45:35,58.9,13.29\n"
                 "o2,1,p2,s2,2017-05-03 11:05:13,NaN,19.93\n")
    df = read_csv_table(spark, str(p), "order_items")
    got = rows(df, "order_id", "price", "shipping_limit_date")
    assert got == [("o1", 58.9, dt.datetime(2017, 9, 19, 9, 45, 35)),
                   ("o2", None, dt.datetime(2017, 5, 3, 11, 5, 13))]
    assert check_schema(df, "order_items") == []


def test_check_schema_reports_problems(spark):
    df = spark.createDataFrame([("a", "x")], "order_id string, price string")
    problems = check_schema(df, "order_items", require=["order_id", "price", "product_id"])
    assert any("price" in p for p in problems) and any("product_id" in p for p in problems)


def test_null_profile_shape_value_counts(spark):
    df = spark.createDataFrame([("a", None), ("b", "x"), (None, "x")], "s string, t string")
    assert rows(profile.null_profile(df)) == [("s", 1), ("t", 1)]
    assert profile.shape(df).first().asDict() == {"rows": 3, "columns": 2}
    vc = rows(profile.value_counts(df, "t", normalize=True, decimals=3), "t", "count", "percentage")
    assert vc == [("x", 2, 100.0)]


def test_describe_and_tail(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 5, 9, 20]], "v double")
    d = profile.describe(df, ["v"], n_buckets=4).first()
    assert (d["count"], d["min"], d["q50"], d["max"]) == (5, 1.0, 5.0, 20.0)
    t = profile.tail_profile(df, "v", 0.95, n_buckets=4).first()
    assert abs(t.p_quantile - 17.8) < 1e-9 and t.n_above == 1 and abs(t.share_above - 0.2) < 1e-12


def test_keeping_corrupt_rows_leaves_the_schema_alone(spark, tmp_path):
    p = tmp_path / "items.csv"
    p.write_text("order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\no1,x,p1,s1,2017-09-19 09:45:35,58.9,13.29\n")
    for _ in range(2):
        assert read_csv_table(spark, str(p), "order_items", keep_corrupt=True).first()["_corrupt_record"].startswith("o1,x")
    plain = read_csv_table(spark, str(p), "order_items")
    assert "_corrupt_record" not in plain.columns and check_schema(plain, "order_items") == []


def test_parquet_nan_is_null_and_new_columns_are_seen(spark, tmp_path):
    from cartlytics.sources.readers import read_table
    nan = float("nan")
    spark.createDataFrame([(1, 2.0), (2, nan), (3, None)], "id long, v double").write.parquet(str(tmp_path / "t.parquet"))
    df = read_table(spark, str(tmp_path), "t")
    assert rows(profile.null_profile(df)) == [("id", 0), ("v", 2)]
    assert profile.describe(df, ["v"], n_buckets=4).first()["mean"] == 2.0
    spark.createDataFrame([(1, 2.0, "x")], "id long, v double, w string").write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path), "t").columns == ["id", "v", "w"]
