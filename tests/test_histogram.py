"""Histogram bins against numpy."""

import random

import numpy as np
import pytest

from cartlytics.operators.histogram import histogram_auto, histogram_fixed


def _check(got, counts, edges):
    want = {i: (float(edges[i]), float(edges[i + 1]), int(c)) for i, c in enumerate(counts) if c}
    have = {r.bin: (r.lower, r.upper, r["count"]) for r in got}
    assert set(have) == set(want)
    for b, (lo, hi, c) in want.items():
        assert have[b][2] == c
        assert have[b][0] == pytest.approx(lo) and have[b][1] == pytest.approx(hi)


@pytest.mark.parametrize("seed", [0, 1])
def test_auto_bins_match_numpy(spark, seed):
    rnd = random.Random(seed)
    vals = [rnd.expovariate(0.01) for _ in range(2000)] + [0.0, 1000.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    counts, edges = np.histogram(np.array(vals), bins="auto")
    _check(histogram_auto(df, "x", n_buckets=8).collect(), counts, edges)


def test_auto_bins_integer_width_at_least_one(spark):
    vals = list(range(5)) * 200
    df = spark.createDataFrame([(v,) for v in vals], "x long")
    counts, edges = np.histogram(np.array(vals), bins="auto")
    got = histogram_auto(df, "x", n_buckets=4).collect()
    assert sum(r["count"] for r in got) == len(vals)
    _check(got, counts, edges)


def test_fixed_bins_per_key(spark):
    rnd = random.Random(3)
    data = [(g, rnd.gauss(g * 10, 3)) for g in (0, 1) for _ in range(500)] + [(2, 4.0), (2, 4.0)]
    df = spark.createDataFrame(data, "g int, x double")
    out = histogram_fixed(df, "x", keys=["g"], bins=10).collect()
    for g in (0, 1, 2):
        vals = np.array([x for gg, x in data if gg == g])
        counts, edges = np.histogram(vals, bins=10)
        _check([r for r in out if r.g == g], counts, edges)
