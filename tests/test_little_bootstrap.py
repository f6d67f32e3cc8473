"""Full-size resampling: widths against the analytic ones, the single subset against a plain bootstrap."""

import numpy as np
import pytest

from cartlytics import catalog as C
from cartlytics.operators.little_bootstrap import little_bootstrap_ci, subset_limits
from tests.conftest import rows


def frame(spark, values, parts=4, group=0):
    return spark.createDataFrame([("m", group, i, float(v)) for i, v in enumerate(values)], "metric string, group int, unit_id long, value double").repartition(parts)


@pytest.mark.parametrize("law", ["normal", "heavy"])
def test_width_is_that_of_the_whole(spark, law):
    rng = np.random.default_rng(11)
    n = 40000
    values = rng.normal(50, 9, n) if law == "normal" else np.exp(rng.normal(0, 1, n))
    got = little_bootstrap_ci(frame(spark, values), subset_rows=5000, n_resamples=24000, decimals=None).first()
    want = 2 * 1.959964 * values.std(ddof=1) / n ** 0.5
    assert got.ci_high - got.ci_low == pytest.approx(want, rel=0.02)
    assert got.mean == pytest.approx(values.mean()) and got.ci_low < got.mean < got.ci_high


def test_one_subset_is_the_plain_bootstrap(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.exponential(10, 300), 1)  # with ties, and skewed
    means = np.array([rng.choice(values, 300).mean() for _ in range(20000)])
    low, high = np.quantile(means, [0.025, 0.975])
    got = little_bootstrap_ci(frame(spark, values), n_resamples=20000, decimals=None).first()
    assert got.ci_low == pytest.approx(low, abs=0.06 * (high - low)) and got.ci_high == pytest.approx(high, abs=0.06 * (high - low))


def test_any_partitions_give_the_same_limits(spark):
    values = np.random.default_rng(5).normal(0, 1, 3000)
    a, b = (rows(little_bootstrap_ci(frame(spark, values, parts), subset_rows=700, n_resamples=500, decimals=None)) for parts in (2, 9))
    assert a[0][2:] == pytest.approx(b[0][2:], rel=1e-12)


def test_odd_groups(spark):
    df = frame(spark, [3.0]).unionByName(frame(spark, [5.0] * 40, group=1)).unionByName(frame(spark, [1.0, 2.0], group=None))
    df = df.unionByName(spark.createDataFrame([("m", 4, 1, None)], df.schema))
    got = {r.group: r for r in little_bootstrap_ci(df, n_resamples=200).collect()}
    assert set(got) == {0, 1, None} and (got[0].ci_low, got[0].ci_high) == (3.0, 3.0) and (got[1].ci_low, got[1].ci_high) == (5.0, 5.0)
    assert little_bootstrap_ci(df.limit(0)).count() == 0
    assert subset_limits(np.array([1.0]), np.array([7]), 7, 10, 0.95, 1) == (0.0, 0.0)


def test_a_hot_value_is_one_row_of_its_subset(spark):
    values = [1.0] * 20000 + list(np.random.default_rng(2).normal(0, 1, 2000))
    df = spark.createDataFrame([("m", 0, 7 if v == 1.0 else i, float(v)) for i, v in enumerate(values)], "metric string, group int, unit_id long, value double")
    got = little_bootstrap_ci(df, n_resamples=2000, decimals=None).first()
    want = 2 * 1.959964 * np.std(values) / len(values) ** 0.5
    assert got.ci_high - got.ci_low == pytest.approx(want, rel=0.3)


def test_query_agrees_with_the_blocked_form(spark):
    """The registered query against the Poisson form, which has SQL."""
    sf = "/root/testdata/sf0.001"
    full = {(r.metric, r.group): r for r in C.q_bootstrap_full_size(spark, sf).collect()}
    blocked = {(r.metric, r.group): r for r in C.q_bootstrap_mean_ci(spark, sf).collect()}
    assert set(full) == set(blocked)
    for k, r in full.items():
        width = blocked[k].ci_high - blocked[k].ci_low
        assert r.mean == pytest.approx(blocked[k].mean) and r.ci_low == pytest.approx(blocked[k].ci_low, abs=0.15 * width + 0.01)
