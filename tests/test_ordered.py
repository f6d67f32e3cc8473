"""The bucketed prefix-count plan against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartlytics.plans.ordered import exact_quantiles, ranked_values
from tests.conftest import rows


def test_quantile_golden(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 5, 9, 20]], "v double")
    q = exact_quantiles(df, "v", [0.95], n_buckets=4).first()
    assert q.quantile == pytest.approx(17.8)


def test_quantiles_match_numpy_with_ties_and_skew(spark):
    rnd = random.Random(1)
    vals = [rnd.choice([5.0, 5.0, 5.0, rnd.random() * 100]) for _ in range(3000)]  # hot value
    keyed = [("a" if i % 3 else "b", v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(keyed, "k string, v double").repartition(7)
    qs = [0.0, 0.1, 0.25, 0.5, 0.77, 0.95, 1.0]
    got = {(r.k, r.q): r.quantile for r in exact_quantiles(df, "v", qs, keys=["k"], n_buckets=16).collect()}
    for k in "ab":
        arr = np.array([v for kk, v in keyed if kk == k])
        for q in qs:
            assert got[(k, q)] == pytest.approx(float(np.quantile(arr, q)), rel=1e-12)


def test_ranked_before_counts(spark):
    vals = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    r = ranked_values(df, "v", n_buckets=4)
    got = rows(r.rows, "v", "n", "before")
    want = sorted((float(v), vals.count(v), sum(1 for x in vals if x < v)) for v in set(vals))
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=200), st.sampled_from([2, 8, 64]))
def test_quantiles_property(spark, vals, buckets):
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = {r.q: r.quantile for r in exact_quantiles(df, "v", [0.2, 0.5, 0.9], n_buckets=buckets).collect()}
    for q in (0.2, 0.5, 0.9):
        assert got[q] == pytest.approx(float(np.quantile(np.array(vals, float), q)))


def test_plan_has_no_single_partition_exchange_on_detail(spark):
    df = spark.range(0, 5000).selectExpr("cast(id % 977 as double) as v")
    plan = exact_quantiles(df, "v", [0.5], n_buckets=8)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_approx_quantiles_close_to_exact(spark):
    from cartlytics.plans.ordered import approx_quantiles
    df = spark.range(0, 10001).selectExpr("cast(id as double) as v", "id % 2 as k")
    got = {(r.k, r.q): r.quantile for r in approx_quantiles(df, "v", [0.5, 0.9], keys=["k"]).collect()}
    assert abs(got[(0, 0.5)] - 5000) <= 10 and abs(got[(1, 0.9)] - 9000) <= 10


def bits_of(x):
    import struct

    b = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -b if x < 0 else b


def test_order_bits_are_those_of_the_double(spark):
    import math

    from pyspark.sql import functions as F

    from cartlytics.plans.ordered import order_bits
    rng = np.random.default_rng(4)
    vals = [0.0, -0.0, 5e-324, 2.0 ** -1022, math.nextafter(2.0 ** -1022, 0), 1.7976931348623157e308, math.inf, -math.inf, 1.6e15 + 1, 1.6e15]
    for k in (-1050, -1022, -300, -3, -1, 0, 1, 10, 53, 511, 1022, 1023):
        vals += [2.0 ** k, math.nextafter(2.0 ** k, math.inf), math.nextafter(2.0 ** k, 0)]
    vals += np.frombuffer(rng.bytes(8 * 3000)).tolist()
    vals = [v for v in vals if not math.isnan(v)]
    vals += [-v for v in vals]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = df.select("v", order_bits(F.col("v")).alias("b")).collect()
    assert all(r.b == bits_of(r.v) for r in got)


def crowded(n=6000):
    """Values far from zero and close together, with ties, another cluster and a few others."""
    rnd = random.Random(2)
    return [1.6e15 + rnd.randrange(20 * n) for _ in range(n)] + [1.6e15 + 7.0] * 500 + [rnd.random() for _ in range(50)] + [-3e300, 4e300]


def test_crowded_cells_are_cut(spark):
    from pyspark.sql import functions as F

    from cartlytics.plans.ordered import order_bits, ordered_summary, wanted_cells
    vals = crowded()
    df = spark.createDataFrame([("k", v) for v in vals] + [("other", float(i)) for i in range(100)], "k string, v double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    row = ordered_summary(df, "v", probs, ["k"], crowd=40).where("k = 'k'").first()
    for i, p in enumerate(probs):
        assert row[f"q{i}"] == pytest.approx(float(np.quantile(np.array(vals), p)), rel=1e-15), p
        low = sorted(vals)[int((len(vals) - 1) * p)]
        assert row[f"upto{i}"] == sum(v <= low for v in vals)
    data = df.select("k", F.col("v").alias("_v"), order_bits(F.col("v")).alias("_b"))
    for crowd in (40, 1500):
        single, to_read = wanted_cells(data, probs, ["k"], None, crowd)
        assert all(r["_n"] <= crowd for _, cells in to_read for r in cells.collect()) and (to_read or crowd == 40)
        assert all(r["_lo"] == r["_hi"] for r in single.collect())


def test_ranks_in_crowded_cells(spark):
    vals = crowded(3000)
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(5)
    r = ranked_values(df, "v", crowd=50).rows.collect()
    ordered = np.sort(np.array(vals))
    assert all(x["before"] == int(np.searchsorted(ordered, x["v"])) for x in r) and sum(x["n"] for x in r) == len(vals)
    sizes = {}
    for x in r:
        sizes[x["_cell"]] = sizes.get(x["_cell"], 0) + 1
    assert max(sizes.values()) <= 50


def test_bits_are_computed_once_a_scan(spark):
    from cartlytics.plans.ordered import ordered_summary
    df = spark.range(0, 5000).selectExpr("id % 3 as k", "cast(id * id as double) as v")
    plan = ordered_summary(df, "v", [0.25, 0.5], ["k"], n_buckets=8)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("LOG2(") == 1


def test_bits_beside_order_bits(spark):
    import math

    from pyspark.sql import functions as F

    from cartlytics.plans.ordered import order_bits, with_order_bits
    vals = [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, 1.0, -1.0, math.nextafter(8.0, 0), -8.0, 1e308, math.inf, -math.inf, math.nan]
    df = spark.createDataFrame([(v, "k") for v in vals], "v double, k string")
    got = with_order_bits(df, F.col("v"), "b")
    assert got.columns == ["v", "k", "b"] and not got.schema["b"].nullable
    assert all(r.b == r.plain for r in got.withColumn("plain", order_bits(F.col("v"))).collect())
