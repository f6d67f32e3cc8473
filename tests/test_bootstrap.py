"""Poisson bootstrap: determinism, coverage, partition invariance."""

import random

import pytest

from cartlytics.operators.bootstrap import POISSON1_CDF, bootstrap_mean_ci, bootstrap_replicates


def _long(spark, n=400, parts=3):
    rnd = random.Random(5)
    data = [("m", i % 2, i, rnd.gauss(100, 15)) for i in range(n)]
    return spark.createDataFrame(data, "metric string, group int, unit_id long, value double").repartition(parts)


def test_poisson_cdf_table():
    assert POISSON1_CDF[0] == pytest.approx(0.36787944117144233)
    assert POISSON1_CDF[-1] == pytest.approx(1.0)


def test_ci_contains_mean_and_is_deterministic(spark):
    long = _long(spark)
    a = {r.group: r for r in bootstrap_mean_ci(long, n_resamples=300, n_blocks=64, decimals=None).collect()}
    b = {r.group: r for r in bootstrap_mean_ci(_long(spark, parts=5), n_resamples=300, n_blocks=64,
                                               decimals=None).collect()}
    for g in (0, 1):
        assert a[g].ci_low < a[g].mean < a[g].ci_high
        assert a[g].ci_low == pytest.approx(b[g].ci_low, abs=1e-9)
        assert a[g].ci_high == pytest.approx(b[g].ci_high, abs=1e-9)


def test_spread_of_replicates_is_the_standard_error(spark):
    import statistics
    long = _long(spark, n=20_000).where("group = 0")
    values = [r.value for r in long.collect()]
    reps = bootstrap_replicates(long, n_resamples=2000, n_blocks=4096).collect()
    want = statistics.stdev(values) / len(values) ** 0.5
    # 2000 replicates alone leave 1.6%, 4096 blocks 1.1%
    assert statistics.stdev([r.mean for r in reps]) == pytest.approx(want, rel=0.04)


def test_normal_expressions_match_python(spark):
    from statistics import NormalDist

    from cartlytics.functions.normal import norm_cdf, norm_ppf
    xs = [-9.0, -3.2, -1.0, 0.0, 0.4, 2.9, 8.0]
    ps = [1e-8, 0.01, 0.3, 0.5, 0.97, 0.999999]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r, x in zip(df.select(norm_cdf("x").alias("c")).collect(), xs):
        assert r.c == pytest.approx(NormalDist().cdf(x), abs=1e-14)
    dp = spark.createDataFrame([(p,) for p in ps], "p double")
    for r, p in zip(dp.select(norm_ppf("p").alias("z")).collect(), ps):
        assert r.z == pytest.approx(NormalDist().inv_cdf(p), rel=2e-9, abs=1e-12)


def test_replicates_on_one_side_keep_the_group(spark):
    """With one replicate all lie on one side of the estimate: the limits are that replicate."""
    long = _long(spark)
    got = bootstrap_mean_ci(long, n_resamples=1, n_blocks=64, decimals=None).collect()
    reps = {r.group: r.mean for r in bootstrap_replicates(long, n_resamples=1, n_blocks=64).collect()}
    assert {r.group for r in got} == {0, 1}
    assert all(r.ci_low == r.ci_high == pytest.approx(reps[r.group]) for r in got)
