import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from cartlytics.llm import toxicity as X
from conftest_llm import ODD, frame, sentence


def brute_marginals(e, trans, start):
    """Sum over all state sequences."""
    total, toxic = 0.0, np.zeros(len(e))
    for ys in itertools.product((0, 1), repeat=len(e)):
        w = start[ys[0]] + sum(e[t] * y for t, y in enumerate(ys)) + sum(trans[a][b] for a, b in zip(ys, ys[1:]))
        total += math.exp(w)
        toxic += np.array(ys) * math.exp(w)
    return toxic / total


def test_marginals_are_those_of_all_sequences():
    rng = np.random.default_rng(1)
    model = {"trans": rng.normal(size=(2, 2)), "start": rng.normal(size=2)}
    sizes = [1, 5, 7, 2, 9, 1]
    e = rng.normal(scale=2, size=sum(sizes))
    first = np.zeros(len(e), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    for block in (1, 3, 4, 256):
        r, q, _ = X.forward_backward(e, first, model["trans"], model["start"], block)
        p = r * q / (1 + r * q)
        at = 0
        for n in sizes:
            assert np.allclose(p[at:at + n], brute_marginals(e[at:at + n], model["trans"], model["start"]), atol=1e-9)
            at += n


def corpus(spark, n=240):
    bad = ["grubble", "snorp"]
    rows, labels = [], []
    for i in range(n):
        text = sentence(i, 20 + i % 30)
        toxic = i % 4 == 1
        if toxic:
            words = text.split()
            words.insert(i % len(words), bad[i % 8 // 4] + "xyz"[i % 3])
            text = " ".join(words)
        rows.append((i, text, "a"))
        labels.append((i, 1, int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_texts_are_told_apart_and_spans_point_at_the_words(spark):
    docs, labels = corpus(spark)
    scored = X.score(docs, X.fit(docs, labels)).withColumn("held_out", X.in_held_out_fold()).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    held = [r for r in scored if r["held_out"]]
    assert held and all(r["predicted"] == r["toxic"] for r in held)
    for r in scored:
        assert 0 <= r["score"] <= 1
        said = [r["text"][s["start"]:s["end"]] for s in r["spans"]]
        assert all(w.startswith(("grubble", "snorp")) for w in said) and bool(said) == bool(r["toxic"])


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = corpus(spark)
    turned = labels.withColumn("toxic", F.when(X.in_held_out_fold(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = X.fit(docs, labels), X.fit(docs, turned)
    assert np.array_equal(a["weights"], b["weights"]) and a["scale"] == b["scale"] and a["shift"] == b["shift"]


def test_odd_rows(spark, odd, empty):
    docs, labels = corpus(spark, 80)
    model = X.fit(docs, labels)
    got = X.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert X.score(empty, model).count() == 0
    nothing = X.fit(empty, labels.limit(0))
    assert {r["predicted"] for r in X.score(odd, nothing).collect()} == {0}
    kept = X.clean_documents(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_offsets_survive_lower_casing_that_changes_lengths(spark):
    docs, labels = corpus(spark, 120)
    text = "İİİ river grubblex stone"
    r = X.score(frame(spark, [(1, text, "a")]), X.fit(docs, labels)).first()
    assert [text[s["start"]:s["end"]] for s in r["spans"]] == ["grubblex"]
