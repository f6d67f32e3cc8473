import math

import numpy as np
import pytest

from cartlytics.llm import vector_cells as X

SF = "/root/testdata/sf0.01"


def links_by_hand(rows, threshold=0.93):
    """vec_id, n_links, component_id, kept of every row, by all pairs; rows: (vec_id, embedding, label)."""
    units = [X.unit(v) if v is not None and None not in v and label is not None else None for _, v, label in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j])
             and float(units[i] @ units[j]) >= threshold] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()]:
                if j not in group:
                    group.add(j)
                    stack.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(near[j]), least, rows[j][0] == least)
    return sorted(out, key=repr)


def said(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, links string, n_links int")


def cloud(rng, n, dim=64):
    v = rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def beside(rng, v, cosine):
    """Unit vectors at this cosine from those of v, in random directions."""
    d = cloud(rng, len(v), v.shape[1])
    d -= (d * v).sum(axis=1, keepdims=True) * v
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    return cosine * v + math.sqrt(1 - cosine * cosine) * d


def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in df.collect()]
    assert said(X.annotated(df)) == links_by_hand(rows)
    kept = X.representatives(df)
    assert kept.columns == df.columns and kept.count() == sum(r[3] for r in links_by_hand(rows))


@pytest.mark.parametrize(("cells", "block"), [(None, X.BLOCK), (12, 7), (1, 40)])
def test_exact_reach_equals_all_pairs(spark, cells, block):
    """Dense groups, wide groups around them, copies, chains across cells, several labels and lengths."""
    rng = np.random.default_rng(7)
    base = cloud(rng, 60, 6)
    tight = beside(rng, np.repeat(base[:3], 40, axis=0), 0.995)
    wide = beside(rng, np.repeat(base[3:5], 40, axis=0), 0.95)
    chain = [np.array([math.cos(0.2 * k), math.sin(0.2 * k), 0, 0, 0, 0]) for k in range(30)]
    vectors = [*base, *tight, *wide, *chain, *tight[:5], *tight[:5]]
    rows = [(i, list(map(float, v)), 1 if i % 9 else 2) for i, v in enumerate(vectors)]
    rows += [(5000 + i, [1.0, 0.01 * i], 1) for i in range(30)]
    got = said(X.annotated(frame(spark, rows), reach=X.exact_reach(), cells=cells, block=block))
    assert got == links_by_hand(rows)


def test_recall_of_the_default_reach(spark):
    """Pairs at the threshold, in random directions, among many others; what is found is never below the threshold."""
    rng = np.random.default_rng(2)
    base = cloud(rng, 9000)
    near = beside(rng, base[:1500], 0.9301)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, near]))]
    got = {r[0]: r[1] for r in said(X.annotated(frame(spark, rows)))}
    found = sum(got[i] == 1 for i in range(1500)) / 1500
    print("recall at the threshold", found)
    assert found >= 0.99 and all(got[i] == 0 for i in range(1500, 3000))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 2.0], None), (8, [1.0, 2.0], None),
            (9, [1.0, 2.0], 3), (9, [1.0, 2.0], 3), (None, [1.0, 2.0], 3), (10, [2.0, 4.0], 3), (10, [-1.0, 3.0], 3), (11, [1e300, 2e300], 3), (None, [5.0, 1.0], 4), (None, [5.0, 1.0], 4),
            (12, [1.0, -0.0], 5), (13, [1.0, 0.0], 5), (14, [1.0, 2.0, 0.0], 3), (15, [-7.0, 21.0], 3)]
    got = said(X.annotated(frame(spark, rows)))
    want = links_by_hand(rows)
    assert got == sorted(((v, n, c, True if v is None and c is None else k) for v, n, c, k in want), key=repr)
    assert X.annotated(frame(spark, []).limit(0)).count() == 0


def test_a_group_of_a_third_makes_no_products(spark):
    rng = np.random.default_rng(3)
    base = cloud(rng, 1200)
    group = beside(rng, np.repeat(base[:1], 600, axis=0), 0.993)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, group]))]
    df = frame(spark, rows)
    assert said(X.annotated(df)) == links_by_hand(rows)
    classes = X.class_table(df, "vec_id", "label", "embedding")
    centres = spark.sparkContext.broadcast(X.fit_cells(classes, None, X.THRESHOLD))
    placed = classes.select("node", "label", "dim", "weight", "vec").mapInArrow(X.place(centres, X.THRESHOLD, None), X.PLACED)
    kinds = {r["kind"]: r["count"] for r in placed.groupBy("kind").count().collect()}
    assert kinds["core"] >= 590 and kinds["visitor"] < 6 * len(rows)
