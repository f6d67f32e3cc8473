import math

import numpy as np

from cartlytics.llm import importance as X
from cartlytics.llm.common import WordIds
from cartlytics.llm.decontam import BITS as X_BITS
from conftest_llm import ODD, frame, sentence


def tables(spark, n=300):
    junk = lambda i: " ".join(["zz%d |" % (i % 5)] * 20)
    rows = [(i, junk(i) if i % 4 == 0 else sentence(i, 30), "a") for i in range(n)]
    return frame(spark, rows), spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, n, 3)], "doc_id long, quality int, toxic int")


def test_good_texts_are_drawn_and_weights_equal_brute_force(spark):
    import re

    docs, labels = tables(spark)
    got = {r["doc_id"]: r for r in X.resample(docs, X.good_ids(labels), keep=0.6).collect()}
    assert len(got) == 180 and sum(i % 4 == 0 for i in got) <= 18
    ids, target, raw = WordIds(), np.zeros(X.BUCKETS), np.zeros(X.BUCKETS)
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    grams = {}
    for r in docs.collect():
        grams[r["doc_id"]] = X.ngram_buckets(ids.array(re.findall(X.WORD, r["text"].lower())))
        raw += np.bincount(grams[r["doc_id"]], minlength=X.BUCKETS)
        if r["doc_id"] in good:
            target += np.bincount(grams[r["doc_id"]], minlength=X.BUCKETS)
    ratio = np.log((target + .5) / (target + .5).sum()) - np.log((raw + .5) / (raw + .5).sum())
    for i, r in got.items():
        assert math.isclose(r["log_weight"], X.SHARPNESS * ratio[grams[i]].mean(), abs_tol=1e-9)
    plain = X.resample(docs, X.good_ids(labels), keep=0.6, sharpness=None).collect()  # the likelihood ratio itself
    assert len(plain) == 180 and not any(r["doc_id"] % 4 == 0 for r in plain)
    assert all(math.isclose(r["log_weight"], ratio[grams[r["doc_id"]]].sum(), abs_tol=1e-8) for r in plain)


def test_all_labels_count_and_no_others(spark, monkeypatch):
    """The bit array lets others pass; they are found by their ids, broadcast or joined, and not counted."""
    docs, labels = tables(spark)
    want = X.log_ratios(docs, X.good_ids(labels))
    for most in (X.BROADCAST_IDS, 0):
        monkeypatch.setattr(X, "BROADCAST_IDS", most)
        # an array with all bits set passes every id
        monkeypatch.setattr(X, "seed_bitmap", lambda seeds: b"\xff" * (1 << (X_BITS - 3)))
        assert np.allclose(X.log_ratios(docs, X.good_ids(labels)), want)


def test_largest_against_sorting(spark):
    rng = np.random.default_rng(1)
    values = [*rng.normal(size=3000).tolist(), *[0.25] * 500, *(1e6 + rng.random(50)).tolist()]
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "key double, tie long").repartition(5)
    for k in (0, 1, 50, 51, 1300, 1500, 3549, 3550, 9999):
        want = sorted(range(len(values)), key=lambda i: (-values[i], i))[:k]
        assert sorted(r["tie"] for r in X.largest(df, "key", k, bins=16).collect()) == sorted(want)


def test_draws_follow_the_weights(spark):
    """With equal weights, draws do not depend on the text's length or place."""
    docs, labels = tables(spark)
    drawn = [r["doc_id"] for r in X.resample(docs, X.good_ids(labels.limit(0)), keep=0.5).collect()]
    assert len(drawn) == 150 and 100 < sum(drawn) / len(drawn) < 200


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(6, 1, 0), (8, 1, 0), (None, 1, 0), (6, 1, 0), (11, 0, None)], "doc_id long, quality int, toxic int")
    assert X.resample(odd, X.good_ids(labels), keep=1.0).count() == len(ODD)
    assert X.resample(odd, X.good_ids(labels), keep=0.5).count() == len(ODD) // 2
    assert X.resample(empty, X.good_ids(labels)).count() == 0
