import re

from cartlytics.llm import decontam as X
from conftest_llm import ODD, frame, sentence


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, seed string")


def test_exact_and_substituted_passages(spark):
    item = sentence(100, 30).split()
    changed = list(item)
    for at in (4, 11, 19, 26):
        changed[at] = "changed"
    rows = [(1, sentence(1, 50) + " " + " ".join(item) + " " + sentence(2, 20), "a"),
            (2, " ".join(changed) + " " + sentence(3, 60), "a"),
            (3, sentence(4, 300), "a"),
            (4, " ".join(item[:6]) + " " + sentence(5, 60), "a"),  # too short an overlap
            (5, sentence(6, 40) + " " + " ".join(item[10:24]).upper(), "a")]
    got = {(r["doc_id"], r["item_id"]): r for r in X.overlaps(frame(spark, rows), benchmark(spark, [(7, " ".join(item)), (8, "too short"), (9, None)])).collect()}
    assert set(got) == {(1, 7), (2, 7), (5, 7)}
    assert (got[1, 7]["doc_word"], got[1, 7]["n_words"], got[1, 7]["n_equal"]) == (50, 30, 30)
    assert got[2, 7]["n_equal"] == 26
    assert X.clean_documents(frame(spark, rows), benchmark(spark, [(7, " ".join(item))])).select("doc_id").toPandas()["doc_id"].tolist() == [3, 4]


def test_all_pairs_by_brute_force(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    find = re.compile(X.WORD).findall
    items = {r["item_id"]: find(r["text"].lower()) for r in bench.collect()}
    shared = {}
    for i, ws in items.items():
        for j in range(len(ws) - 7):
            shared.setdefault(tuple(ws[j:j + 8]), set()).add(i)
    want = set()
    for r in docs.collect():
        ws = find((r["text"] or "").lower())
        hits = {}
        for j in range(len(ws) - 7):
            for i in shared.get(tuple(ws[j:j + 8]), ()):
                hits[i] = hits.get(i, 0) + 1
        want |= {(r["doc_id"], i) for i, n in hits.items() if n >= 5}
    got = {(r["doc_id"], r["item_id"]) for r in X.overlaps(docs, bench).collect()}
    assert want <= got and len(got - want) <= 0.1 * len(want) and want


def test_best_stretch_against_all_stretches():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        equal = (rng.random(rng.integers(1, 40)) < rng.random()).astype(np.int64)
        least = int(rng.integers(1, 15))
        best = max((int(equal[a:b].sum()) for a in range(len(equal)) for b in range(a + least, len(equal) + 1) if equal[a:b].mean() >= 0.8 - 1e-12), default=None)
        got = X.best_stretch(equal, least, 0.8)
        assert (got[2] if got else None) == best


def test_odd_rows(spark, odd, empty):
    bench = benchmark(spark, [(1, sentence(8, 5000)), (2, None), (3, ""), (4, sentence(6, 30)), (4, sentence(6, 30))])
    got = {(r["doc_id"], r["item_id"]) for r in X.overlaps(odd, bench).collect()}
    assert got == {(6, 4), (7, 4), (8, 1)}
    kept = X.clean_documents(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 4
    assert X.overlaps(empty, bench).count() == 0 and X.overlaps(odd, bench.limit(0)).count() == 0
    assert X.clean_documents(odd, bench.limit(0)).count() == len(ODD)


def test_short_items_are_exact_phrases(spark):
    rows = [(1, "Alpha beta, gamma delta epsilon", "a"), (2, "beta alpha gamma", "a"), (3, sentence(5, 40) + " zeta", "a"), (4, "alpha beta gamma changed", "a")]
    bench = benchmark(spark, [(1, "alpha beta"), (2, "alpha beta gamma delta"), (3, "zeta"), (4, "delta gamma"), (5, "!!")])
    got = {(r["doc_id"], r["item_id"]): (r["doc_word"], r["n_words"], r["n_equal"]) for r in X.overlaps(frame(spark, rows), bench).collect()}
    assert got == {(1, 1): (0, 2, 2), (4, 1): (0, 2, 2), (1, 2): (0, 4, 4), (3, 3): (40, 1, 1)}
    assert X.clean_documents(frame(spark, rows), bench).count() == len(rows)
