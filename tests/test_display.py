from cartlytics.operators.display import preview, sorted_view, union_all


def test_sorted_view_and_preview(spark):
    df = spark.createDataFrame([("p1", 3), ("p2", 5), ("p3", 5), ("p4", None)], "k string, q int")
    got = [r.k for r in sorted_view(df, [("q", False)], tiebreak=["k"]).collect()]
    assert got == ["p2", "p3", "p1", "p4"]
    assert [r.k for r in preview(df, 2, [("q", False)], ["k"]).collect()] == ["p2", "p3"]


def test_union_all_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, n int")
    c = spark.createDataFrame([(3,)], "n int")
    assert sorted((r.n, r.s) for r in union_all([a, b, c], allow_missing=True).collect()) == \
        [(1, "x"), (2, "y"), (3, None)]
