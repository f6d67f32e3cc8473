"""CSV scans by header names, the quarantine, and the schema report."""

import datetime as dt

import pytest

from cartlytics.sources import SCHEMAS, load_csv_table, read_csv_table, schema_report
from cartlytics.sources.schemas import file_schemas
from tests.conftest import rows

FIXED = ",".join(SCHEMAS["customers"].names)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_columns_are_found_by_name(spark, tmp_path):
    """Reordered, extra and missing columns and an exported index."""
    plain = put(tmp_path / "a.csv", FIXED + "\nc1,u1,123,paris,FR\nc2,u2,77,NA,\n")
    moved = put(tmp_path / "b.csv", ",customer_city,note,CUSTOMER_ID,customer_zip_code_prefix,customer_unique_id\n0,paris,x,c1,123.0,u1\n1,NaN,\"y,z\",c2, 77 ,u2\n")
    want = [("c1", "u1", 123, "paris", "FR"), ("c2", "u2", 77, None, None)]
    assert rows(read_csv_table(spark, plain, "customers")) == want
    assert rows(read_csv_table(spark, moved, "customers")) == [(*w[:4], None) for w in want]
    assert read_csv_table(spark, moved, "customers").schema == SCHEMAS["customers"]
    with pytest.raises(ValueError, match="lacks customer_state"):
        read_csv_table(spark, moved, "customers", require=["customer_id", "customer_state"])
    both = rows(read_csv_table(spark, [plain, moved], "customers"))
    assert both == sorted([*want, *[(*w[:4], None) for w in want]], key=repr)


def test_good_rows_quarantine_and_counts_in_one_pass(spark, tmp_path):
    text = ("price,extra,order_id,order_item_id,product_id,seller_id,shipping_limit_date\n"
            "58.9,e,o1,1,p1,s1,2017-09-19 09:45:35\n"
            "free,e,o2,1,p2,s2,2017-05-03 11:05:13\n"
            "NaN,e,o3,2.0,p3,s3,2017-05-03\n"
            "1,e,o4,two,p4,s4,someday\n"
            "1,e,o5,1\n"
            "1,e,o6,1,p6,s6,2017-05-03 11:05:13,more\n"
            "1e3,\"a \"\"b\"\", c\",o7,7,p7,s7,\n")
    load = load_csv_table(spark, put(tmp_path / "i.csv", text), "order_items")
    assert rows(load.rows, "order_id", "order_item_id", "price", "shipping_limit_date") == [
        ("o1", 1, 58.9, dt.datetime(2017, 9, 19, 9, 45, 35)), ("o3", 2, None, dt.datetime(2017, 5, 3)), ("o7", 7, 1000.0, None)]
    bad = {r["line"].split(",")[2]: r["faults"] for r in load.quarantine.collect()}
    assert bad == {"o2": ["price"], "o4": ["order_item_id", "shipping_limit_date"], "o5": ["_cells"], "o6": ["_cells"]}
    assert all(r["file"].endswith("i.csv") for r in load.quarantine.collect()) and load.quarantine.count() == 4
    counts = {r["column"]: r["bad_cells"] for r in load.counts.collect()}
    assert counts["_rows"] == 7 and counts["_bad_rows"] == 4 and counts["price"] == 1 and counts["_cells"] == 2 and counts["order_id"] == 0
    for part in (load.rows, load.quarantine):  # both views read the written table, not the files
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "parquet" in plan and "csv" not in plan.lower().replace("i.csv", "")


def test_files_of_one_path(spark, tmp_path):
    put(tmp_path / "d" / "1.csv", FIXED + "\nc1,u1,1,x,A\n")
    put(tmp_path / "d" / "2.csv", FIXED + "\nc2,u2,2,y,B\n")
    assert [r[0] for r in rows(read_csv_table(spark, str(tmp_path / "d"), "customers"))] == ["c1", "c2"]
    put(tmp_path / "d" / "3.csv", "customer_city,customer_id,customer_unique_id,customer_zip_code_prefix,customer_state\nz,c3,u3,3,C\n")
    with pytest.raises(Exception, match="another header"):
        read_csv_table(spark, str(tmp_path / "d"), "customers").collect()
    got = rows(read_csv_table(spark, str(tmp_path / "d"), "customers", align_files=True))
    assert got == [("c1", "u1", 1, "x", "A"), ("c2", "u2", 2, "y", "B"), ("c3", "u3", 3, "z", "C")]


def test_empty_and_odd_files(spark, tmp_path):
    assert load_csv_table(spark, put(tmp_path / "h.csv", FIXED + "\n"), "customers").rows.count() == 0
    with pytest.raises(ValueError, match="twice"):
        read_csv_table(spark, put(tmp_path / "t.csv", "customer_id,Customer_Id\n1,2\n"), "customers")
    with pytest.raises(ValueError, match="no header"):
        read_csv_table(spark, put(tmp_path / "n.csv", ""), "customers")
    semi = put(tmp_path / "s.csv", "﻿user_id;order_id;action;time;date;group\n1;2;create_order;2022-08-24 01:52:00;2022-08-24 00:00:00;0\n")
    assert rows(read_csv_table(spark, semi, "ab_users_data", sep=";")) == [(1, 2, "create_order", dt.datetime(2022, 8, 24, 1, 52), dt.date(2022, 8, 24), 0)]


def test_schema_report_of_frames_and_files(spark, tmp_path):
    spark.createDataFrame([("a", "x")], "order_id string, price string").coalesce(1).write.parquet(str(tmp_path / "t" / "a.parquet"))
    spark.createDataFrame([(1, 2.0, 3)], "order_id long, price double, note int").coalesce(1).write.parquet(str(tmp_path / "t" / "b.parquet"))
    schemas = file_schemas(spark, str(tmp_path / "t" / "*"))
    got = rows(schema_report({"order_items": schemas}, require={"order_items": ["order_id", "price", "seller_id"]}), "column", "wanted", "found", "files", "verdict")
    assert got == sorted([("order_id", "string", "string", 1, "ok"), ("order_id", "string", "bigint", 1, "ok"), ("price", "double", "string", 1, "wrong type"),
                          ("price", "double", "double", 1, "ok"), ("seller_id", "string", None, 2, "missing"), ("note", None, "int", 1, "extra")], key=repr)
