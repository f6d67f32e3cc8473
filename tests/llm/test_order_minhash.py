import re
from collections import Counter

import numpy as np

from cartlytics.llm import order_minhash as X
from conftest_llm import ODD, frame, sentence


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(5)
    for _ in range(400):
        a = rng.integers(0, 6, rng.integers(0, 25)).astype(np.uint32)
        b = a.copy() if rng.random() < 0.5 else rng.integers(0, 6, rng.integers(0, 25)).astype(np.uint32)
        if len(b) and rng.random() < 0.7:
            b[rng.integers(0, len(b))] = 9
        true, least = lcs(a.tolist(), b.tolist()), int(rng.integers(0, 20))
        got = X.aligned(a, b, least)
        assert got == true if true >= least else got < least


def shingles_of(text):
    w = re.findall(X.WORD, text.lower())
    k = min(5, len(w))
    return [tuple(w[i:i + k]) for i in range(len(w) - k + 1)] if w else []


def words_of(text):
    return re.findall(X.WORD, text.lower())


def similarity(a, b, shared):
    """Of two lists of words; ``shared``: their common ones, repeats counted, which bound the alignment."""
    if not a or not b or shared < 0.8 * (len(a) + len(b) - shared) - 1e-9:
        return 0.0
    n = lcs(a, b)
    return n / (len(a) + len(b) - n)


def classes_by_brute_force(texts, least_jaccard=0.0):
    """Components of all pairs of similarity 0.8 (and of that Jaccard similarity of shingles), texts without
    words alone; ids to least ids."""
    ids, parent = sorted(texts), {i: i for i in texts}
    lists = {i: words_of(t) for i, t in texts.items()}
    counts = {i: Counter(s) for i, s in lists.items()}
    grams = {i: set(shingles_of(t)) for i, t in texts.items()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and min(len(lists[a]), len(lists[b])) >= 0.8 * max(len(lists[a]), len(lists[b])) and find(a) != find(b):
                if len(grams[a] & grams[b]) < least_jaccard * len(grams[a] | grams[b]):
                    continue
                if similarity(lists[a], lists[b], (counts[a] & counts[b]).total()) >= 0.8 - 1e-9:
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: find(i) for i in ids}


def test_copies_with_one_word_in_twenty_replaced(spark):
    # the shingles agree in 0.6, so nearly every pair has a key in common
    texts = {}
    for i in range(40):
        words = sentence(i, 100 + i).split()
        texts[i] = " ".join(words)
        texts[100 + i] = " ".join(f"new{i}x{k}" if (k + i) % 20 == 7 else w for k, w in enumerate(words))
    got = {r["doc_id"]: r["class_id"] for r in X.near_duplicates(frame(spark, [(i, t, "a") for i, t in texts.items()])).collect()}
    assert sum(got[100 + i] == i for i in range(40)) >= 39 and len(set(got.values())) >= 40


def test_recall_at_one_word_in_twelve_and_in_ten(spark):
    for step, least in ((12, 0.9), (10, 0.85)):
        rows = []
        for i in range(100):
            words = sentence(i, 120 + i).split()
            rows += [(i, " ".join(words), "a"), (1000 + i, " ".join(f"new{i}x{k}" if (k + i) % step == 3 else w for k, w in enumerate(words)), "a")]
        got = {r["doc_id"]: r["class_id"] for r in X.near_duplicates(frame(spark, rows)).collect()}
        found = sum(got[1000 + i] == i for i in range(100)) / 100
        print("one word in", step, "found", found)
        assert found >= least


def test_texts_that_share_a_passage_are_compared_in_blocks(spark, monkeypatch):
    """Many unlike texts with one long passage, and near copies of one of them, whatever the size of the blocks."""
    passage = sentence(9, 60)
    texts = {i: passage + " " + sentence(1000 + i, 25) for i in range(120)}
    texts |= {500 + i: t.replace(" ", f" extra{i} ", 1) for i, t in list(texts.items())[:30]}
    rows = [(i, t, "a") for i, t in texts.items()]
    want = classes_by_brute_force(texts)
    assert len(set(want.values())) == 120
    for block in (X.BLOCK, 16):
        monkeypatch.setattr(X, "BLOCK", block)
        assert {r["doc_id"]: r["class_id"] for r in X.near_duplicates(frame(spark, rows)).collect()} == want


def test_far_apart_rules_out_no_link():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a = rng.integers(0, 40, rng.integers(5, 60)).astype(np.uint32)
        b = a.copy()
        for _ in range(rng.integers(0, 12)):
            b[rng.integers(0, len(b))] = rng.integers(0, 90)
        b = np.concatenate([b, rng.integers(0, 90, rng.integers(0, 5)).astype(np.uint32)])
        counts = np.array([np.bincount(t % 16, minlength=16) for t in (a, b)]).astype(np.int32)
        if X.similarity_of(a, b):
            assert not X.far_apart(counts, np.array([len(a), len(b)]), 0)[0]


def variants(n):
    """A base text and copies that differ from one another in several places."""
    base = sentence(50, 120).split()
    out = []
    for i in range(n):
        words = list(base)
        words[(i * 17) % 120] = f"new{i}"
        out.append(" ".join(words))
    return out


def test_classes_by_brute_force(spark):
    texts = {i: sentence(i, 40 + i) for i in range(20)}
    texts |= {100 + i: t for i, t in enumerate(variants(25))}
    texts |= {200: sentence(3, 43) + " more", 201: texts[5], 202: texts[5].upper(), 203: "one two", 204: "One, two!", 205: " ".join(texts[7].split()[::-1])}
    # a chain: each is near the next, the ends are not near each other
    words = sentence(77, 100).split()
    for k in range(8):
        texts[300 + k] = " ".join(["x%d" % j for j in range(k * 4)] + words[k * 4:])
    got = {r["doc_id"]: r["class_id"] for r in X.near_duplicates(frame(spark, [(i, t, "a") for i, t in texts.items()])).collect()}
    assert got == classes_by_brute_force(texts)
    assert got[205] == 205 and got[307] == got[300]


def test_on_a_table_by_shared_shingles(spark, docs):
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r["class_id"] for r in X.near_duplicates(docs).collect()}
    want = classes_by_brute_force(rows)
    blank = {i: rows[i] for i in rows if not words_of(rows[i])}
    assert {i: c for i, c in got.items() if i not in blank} == {i: c for i, c in want.items() if i not in blank} and len(set(want.values())) < len(rows)


def test_odd_rows(spark, odd, empty):
    got = [(r["doc_id"], r["class_id"]) for r in X.near_duplicates(odd).collect()]
    assert len(got) == len(ODD)
    assert {c for i, c in got if i in (6, 7)} == {6}
    assert all(i == c for i, c in got if i not in (6, 7))
    stay = X.one_of_each_class(odd)
    assert stay.columns == odd.columns
    ids = sorted(r["doc_id"] for r in stay.collect() if r["doc_id"] is not None)
    assert ids == [1, 2, 3, 4, 5, 6, 8, 10, 11, 11]
    assert X.near_duplicates(empty).count() == 0 and X.one_of_each_class(empty).count() == 0


def test_repeated_rows_stay_once(spark):
    text = sentence(4, 50)
    rows = [(1, text, "a"), (1, text, "a"), (2, text, "a"), (2, text, "a"), (3, "other words here", "a")]
    assert sorted(r["doc_id"] for r in X.one_of_each_class(frame(spark, rows)).collect()) == [1, 3]


def test_rows_with_a_shared_id_are_judged_one_by_one(spark):
    a, b = sentence(4, 50), sentence(5, 50)
    rows = [(1, a, "a"), (2, a, "a"), (2, b, "a"), (3, a + " more", "b"), (3, "!!! ...", "a"), (4, "!!! ...", "a"), (5, "!!! ...", "a"), (6, " ", "a"), (7, " ", "a")]
    got = sorted((r["doc_id"], r["text"]) for r in X.one_of_each_class(frame(spark, rows)).collect())
    assert got == sorted([(1, a), (2, b), (3, "!!! ..."), (6, " "), (7, " ")])
