"""Column building blocks on hand-made rows (FIXTURES.md section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from cartlytics.functions.columns import (
    RFM_SEGMENT_RULES, cut_equal_width, month_start, not_in_null_safe, parse_id_set, relabel,
    weekday_name, weeks_in_month)


def test_paid_filter_keeps_null_status(spark):
    df = spark.createDataFrame([("a", "P"), ("b", None), ("c", "F")], "id string, s string")
    kept = sorted(r.id for r in df.where(not_in_null_safe("s", ["P"])).collect())
    assert kept == ["b", "c"]


def test_paid_filter_pushes_to_parquet(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    spark.createDataFrame([("a", "P")], "id string, s string").write.parquet(p)
    plan = spark.read.parquet(p).where(not_in_null_safe("s", ["P", "Q"]))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters" in plan and "EqualNullSafe" in plan


def _cut(spark, values, bins=5):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    st = df.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    out = df.select(cut_equal_width("x", st.select("lo").scalar(), st.select("hi").scalar(), bins)
                    .alias("b"))
    return [r.b for r in out.collect()]


def test_cut_right_closed_equal_width(spark):
    assert _cut(spark, [1, 4, 5, 7, 16, 13, 14]) == [1, 1, 2, 2, 5, 4, 5]


def test_cut_constant_column_goes_to_middle_bin(spark):
    assert _cut(spark, [0, 0]) == [3, 3]


def test_rfm_labels_first_match_and_unmapped_codes(spark):
    codes = ["555", "513", "511", "135", "111", "255", "141"]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    got = [r.l for r in df.select(relabel("code", RFM_SEGMENT_RULES).alias("l")).collect()]
    assert got == ["the_best", "valuable", "almost_new_common", "regular_common", "elder_common",
                   "255", "141"]


def test_parse_product_sets(spark):
    df = spark.createDataFrame([("{1, 22, 3}",), ("{7}",), ("{}",)], "t string")
    got = [r.a for r in df.select(parse_id_set("t").alias("a")).collect()]
    assert got == [[1, 22, 3], [7], [None]]


def test_calendar_helpers(spark):
    df = spark.createDataFrame([(dt.datetime(2017, 2, 10, 13, 0),), (dt.datetime(2017, 3, 3),)],
                               "ts timestamp_ntz")
    out = df.select(month_start("ts").alias("m"), weekday_name("ts").alias("w")) \
        .select("m", "w", weeks_in_month("m").alias("wk")).collect()
    assert out[0].m == dt.date(2017, 2, 1) and out[0].w == "Friday" and out[0].wk == 4.0
    assert abs(out[1].wk - 31 / 7) < 1e-12 and out[1].w == "Friday"
