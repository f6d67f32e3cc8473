import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cartlytics.llm import prefix_trie as X

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_by_hand(rows):
    """Rows of the report by plain dictionaries; rows: (conv_id, turn, role, text)."""
    original = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            original[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    original = {c: [t[1:] for t in sorted(ts)] for c, ts in original.items()}
    members, ended = defaultdict(list), defaultdict(list)
    for c in sorted(original):
        h = zlib.crc32(str(c).encode()) % 6
        whole = original.get(c - c % 100, [])[:h] + original[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ended[tuple(whole)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, ms in members.items():
        cost = (len(ms) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += cost
    return sorted((ms[0], len(p), members[p[:-1]][0] if p else -1, len(ms), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ended.get(p, []))).encode()).hexdigest()) for p, ms in members.items())


def said(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("block", [X.BLOCK, 12])
def test_given_table(spark, block):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert said(X.prefix_trie(df, block)) == trie_by_hand(rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, node string, depth string")


@pytest.mark.parametrize("block", [X.BLOCK, 25])
def test_odd_rows_and_shapes(spark, block, monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 7)
    rng = random.Random(3)
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, None, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (5, 7, "user", ""), (-3, 0, "user", "n"), (-103, 1, "user", "n")]
    rows += [(200 + c, t, "user" if t % 2 == 0 else "assistant", "same 👍") for c in range(30) for t in range(8)]  # copies
    rows += [(300, t, "user", f"long {t}") for t in range(90)] + [(301, t, "user", f"long {t}" if t < 60 else "other") for t in range(90)]  # deep
    rows += [(400 + c, t, "user", rng.choice("xyz")) for c in range(100) for t in range(rng.randint(1, 9))]
    rows += [(1000 + 100 * c, 0, "user", f"{c}") for c in range(80)]  # many children of one node
    assert said(X.prefix_trie(frame(spark, rows).repartition(5), block)) == trie_by_hand(rows)


def test_empty_table(spark):
    assert X.prefix_trie(frame(spark, []).limit(0)).count() == 0


def test_centroid_totals_against_plain_sums():
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, 10, 40, 200]:
        for shape in ("random", "chain", "star"):
            parent = [-1] + [int(rng.integers(0, v)) if shape == "random" else v - 1 if shape == "chain" else 0 for v in range(1, n)]
            names = rng.permutation(n)
            moved = [0] * n
            for v, p in enumerate(parent):
                moved[names[v]] = int(names[p]) if p >= 0 else -1
            values = rng.integers(0, 9, (n, 2))
            want = values.copy()
            for v in range(n - 1, 0, -1):
                want[names[parent[v]]] += want[names[v]]
            assert (X.centroid_totals(moved, values) == want).all(), (n, shape)
