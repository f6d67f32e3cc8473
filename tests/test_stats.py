"""Test statistics: goldens from FIXTURES.md and commons-math3 (shipped with
Spark) as an independent oracle for t / U / F values."""

import math

import pytest
from pyspark.sql import functions as F

from cartlytics.functions import pvalues as pv
from cartlytics.operators import abtests

A = [1, 2, 3, 4, 9]
B = [2, 4, 6, 8, 15, 3]


def long_df(spark, groups, metric="m"):
    data = [(metric, g, float(v)) for g, vals in enumerate(groups) for v in vals]
    return spark.createDataFrame(data, "metric string, group int, value double")


def jarr(spark, xs):
    arr = spark._sc._gateway.new_array(spark._jvm.double, len(xs))
    for i, x in enumerate(xs):
        arr[i] = float(x)
    return arr


def test_moments(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 5, 9, 20]], "v double")
    r = df.agg(F.var_samp("v").alias("v"), F.skewness("v").alias("s"), F.kurtosis("v").alias("k")).first()
    assert r.v == pytest.approx(59.3) and r.s == pytest.approx(0.961613, abs=1e-6)
    assert r.k == pytest.approx(-0.531941, abs=1e-6)


def test_t_tests(spark):
    long = long_df(spark, [A, B])
    pooled = abtests.t_test(long, equal_var=True).first()
    welch = abtests.t_test(long, equal_var=False).first()
    assert pooled.t == pytest.approx(-1.017573, abs=1e-6)
    assert welch.t == pytest.approx(-1.059446, abs=1e-6)
    assert welch.p_value == pytest.approx(0.318198, abs=1e-6)
    tt = spark._jvm.org.apache.commons.math3.stat.inference.TTest()
    assert pooled.p_value == pytest.approx(tt.homoscedasticTTest(jarr(spark, A), jarr(spark, B)), abs=1e-9)
    assert welch.p_value == pytest.approx(tt.tTest(jarr(spark, A), jarr(spark, B)), abs=1e-9)


def test_mann_whitney_with_ties(spark):
    r = abtests.mann_whitney(long_df(spark, [A, B]), n_buckets=4).first()
    assert r.u_a == pytest.approx(9.5) and r.p_value == pytest.approx(0.358012, abs=1e-6)
    mw = spark._jvm.org.apache.commons.math3.stat.inference.MannWhitneyUTest()
    u = mw.mannWhitneyU(jarr(spark, A), jarr(spark, B))  # max(U_a, U_b)
    assert max(r.u_a, len(A) * len(B) - r.u_a) == pytest.approx(u)


def test_mann_whitney_no_ties(spark):
    r = abtests.mann_whitney(long_df(spark, [[19, 22, 16, 29, 24], [20, 11, 17, 12]]), n_buckets=2).first()
    assert r.u_a == pytest.approx(17) and r.p_value == pytest.approx(0.111347, abs=1e-6)


LEV = [[8.88, 9.12, 9.04, 8.98, 9.00, 9.08, 9.01, 8.85, 9.06, 8.99],
       [8.88, 8.95, 9.29, 9.44, 9.15, 9.58, 8.36, 9.18, 8.67, 9.05],
       [8.95, 9.12, 8.95, 8.85, 9.03, 8.84, 9.07, 8.98, 8.86, 8.98]]


def test_levene_median_centre(spark):
    r = abtests.levene(long_df(spark, LEV), n_buckets=4).first()
    assert r.w == pytest.approx(7.584953, abs=1e-6) and r.p_value == pytest.approx(0.0024315, abs=1e-7)
    assert (r.df1, r.df2) == (2, 27) and r.equal_var is False


def test_normality_z_scores(spark):
    long = long_df(spark, [[2, 8, 0, 4, 1, 9, 9, 0], list(range(20))])
    out = {r.group: r for r in abtests.normality(long).collect()}
    assert out[0].z_skew == pytest.approx(0.446264, abs=1e-6)
    assert out[1].z_kurt == pytest.approx(-1.705810, abs=1e-6)
    assert out[1].p_value == pytest.approx(math.exp(-out[1].k2 / 2))


def test_chi2_yates(spark):
    rows = ([(0, "create")] * 1609 + [(0, "cancel")] * 82 + [(1, "create")] * 2514 + [(1, "cancel")] * 132)
    df = spark.createDataFrame(rows, "group int, action string")
    r = abtests.chi2_independence(df, "group", "action").first()
    assert r.statistic == pytest.approx(0.018211, abs=1e-6) and r.dof == 1
    assert r.p_value == pytest.approx(0.892652, abs=1e-6)
    plain = abtests.chi2_independence(df, "group", "action", correction=False).first()
    assert plain.statistic > r.statistic


def test_chi2_fills_zero_cells(spark):
    df = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (1, "c")], "group int, action string")
    cells = abtests.contingency(df, "group", "action").collect()
    assert len(cells) == 6 and sum(c.observed for c in cells) == 4
    assert sum(c.expected for c in cells) == pytest.approx(4)


def test_distribution_tails_against_commons_math(spark):
    jm = spark._jvm.org.apache.commons.math3.distribution
    cases = [("t", t, df, None, 2 * jm.TDistribution(df).cumulativeProbability(-abs(t)))
             for t, df in [(-1.2, 7.5), (2.5, 30.0), (0.1, 3.0), (3.0, 1.0), (0.0, 5.0), (1.96, 1e5)]]
    cases += [("f", f, d1, d2, 1 - jm.FDistribution(float(d1), float(d2)).cumulativeProbability(f))
              for f, d1, d2 in [(7.584953, 2, 27), (1.3, 4, 100), (0.2, 1, 9), (1.1, 30, 40)]]
    cases += [("chi2", x, k, None, 1 - jm.ChiSquaredDistribution(float(k)).cumulativeProbability(x))
              for x, k in [(0.5, 1), (3.2, 2), (12.0, 5), (95.0, 100)]]
    cases += [("z", z, None, None, math.erfc(abs(z) / math.sqrt(2))) for z in (0.3, -1.96, 5.0)] + [("k2", 4.0, None, None, math.exp(-2.0))]
    for kind, x, d1, d2, ref in cases:
        lit = lambda v: None if v is None else F.lit(float(v))
        got = spark.range(1).select(pv.p_value_col(kind, lit(x), lit(d1), lit(d2)).alias("p")).first().p
        assert got == pytest.approx(ref, abs=1e-10), (kind, x, d1, d2)


def test_tails_reach_their_limit_for_many_degrees_of_freedom(spark):
    """t and F tend to the normal law: within 1e-9 at 1e12 degrees of freedom and beyond."""
    normal = math.erfc(1.96 / math.sqrt(2))
    for df in (1e10, 1e12, 1e13, 1e15):
        r = spark.range(1).select(pv.p_value_col("t", F.lit(1.96), F.lit(df)).alias("t"),
                                  pv.p_value_col("f", F.lit(1.96 ** 2), F.lit(1.0), F.lit(df)).alias("f")).first()
        assert r.t == pytest.approx(normal, abs=1e-9) and r.f == pytest.approx(normal, abs=1e-9)


def test_tails_without_a_sure_value_are_null(spark):
    lit = F.lit
    r = spark.range(1).select(
        pv.p_value_col("t", lit(None).cast("double"), lit(3.0)).alias("a"), pv.p_value_col("t", lit(float("nan")), lit(3.0)).alias("b"),
        pv.p_value_col("t", lit(1.0), lit(0.0)).alias("c"), pv.p_value_col("chi2", lit(1.0), lit(0.0)).alias("d"),
        pv.p_value_col("chi2", lit(50_000.0), lit(50_000.0)).alias("e"), pv.p_value_col("t", lit(float("inf")), lit(3.0)).alias("f")).first()
    assert r.a is None and r.b is None and r.c is None and r.d is None and r.e is None and r.f == 0.0


def test_a_metric_of_one_row_does_not_fail_the_others(spark):
    long = long_df(spark, [A, B]).unionByName(long_df(spark, [[1.0]], metric="lone"))
    got = {r.metric: r for r in abtests.mann_whitney(long, n_buckets=4).collect()}
    assert got["m"].u_a == pytest.approx(9.5) and got["lone"].p_value is None
    assert {r.metric: r.t for r in abtests.t_test(long).collect()}["lone"] is None


def test_methods_agree_on_clear_difference(spark):
    """Property from the reference's narrative: t, U and bootstrap agree."""
    import random
    rnd = random.Random(7)
    g0 = [rnd.gauss(10, 2) for _ in range(300)]
    g1 = [rnd.gauss(11, 2) for _ in range(300)]
    long = long_df(spark, [g0, g1])
    assert abtests.t_test(long, equal_var=False).first().p_value < 0.01
    assert abtests.mann_whitney(long, n_buckets=8).first().p_value < 0.01


def test_degenerate_groups_give_null_not_errors(spark):
    long = long_df(spark, [[5, 5, 5], [5, 5]])
    assert abtests.t_test(long, True).first().t is None
    assert abtests.t_test(long, False).first().t is None
    assert abtests.mann_whitney(long, n_buckets=2).first().z is None
    assert abtests.levene(long, n_buckets=2).first().w is None
    assert all(r.k2 is None for r in abtests.normality(long).collect())
