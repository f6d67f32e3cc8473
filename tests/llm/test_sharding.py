import hashlib
import random
import zlib

from cartlytics.llm import sharding as X
from conftest_llm import ODD, frame, sentence


def least_capacity(sums, shards):
    """By dynamic programming over all contiguous partitions."""
    upto = [0]
    for s in sums:
        upto.append(upto[-1] + s)
    best = upto[:]
    for _ in range(shards - 1):
        best = [min(max(best[j], upto[i] - upto[j]) for j in range(i + 1)) for i in range(len(upto))]
    return best[-1]


def test_capacity_and_cuts():
    rng = random.Random(1)
    for _ in range(300):
        sums = [rng.choice([1, 2, 3, 50, rng.randint(1, 400)]) for _ in range(rng.randint(0, 25))]
        shards = rng.randint(1, 8)
        capacity = X.smallest_capacity(sums, shards)
        assert capacity == least_capacity(sums, shards)
        ends = X.even_cuts(sums, shards, capacity)
        assert len(ends) == shards and ends == sorted(ends) and ends[-1] == len(sums)
        assert all(sum(sums[a:b]) <= capacity for a, b in zip([0, *ends], ends))


def plan_of(rows, got, shards):
    """The plan holds the law, by the groups of the whole table."""
    assert len(got) == len(rows)
    sizes, shard_of, slots = {}, {}, {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {(i, zlib.crc32((t or "").encode())): t or "" for i, t in rows}
    load = {}
    for r in got:
        t = text[r["doc_id"], r["text_crc32"]]
        assert r["size"] == len(t.encode()) + 1
        assert shard_of.setdefault(t, r["shard"]) == r["shard"]
        key = hashlib.md5(t.encode()).hexdigest()
        sizes[key] = sizes.get(key, 0) + r["size"]
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert max(load.values()) == least_capacity([sizes[k] for k in sorted(sizes)], shards) if sizes else not load


def test_tables(spark, docs, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plan_of(rows, X.shard_plan(docs).collect(), 8)
    plan_of([(i, t) for i, t, _ in ODD], X.shard_plan(odd).collect(), 8)
    assert X.shard_plan(empty).count() == 0


def test_a_hot_group_and_the_documents(spark):
    rows = [(i, sentence(i, 20), "a") for i in range(60)] + [(1000 + i, sentence(999, 30), "a") for i in range(40)]
    docs = frame(spark, rows)
    plan_of([(i, t) for i, t, _ in rows], X.shard_plan(docs).collect(), 8)
    placed = X.shard_documents(docs)
    assert sorted(placed.columns) == sorted({*docs.columns, "shard"})
    assert {(r["doc_id"], r["shard"]) for r in placed.collect()} == {(r["doc_id"], r["shard"]) for r in X.shard_plan(docs).collect()}
    assert len({r["shard"] for r in placed.collect()}) >= 7
