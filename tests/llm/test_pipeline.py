from collections import Counter

import corpus_pipeline as P
from cartlytics.llm import decontam, mixing, order_minhash, sharding, toxicity
from cartlytics.llm.common import materialise

SF = "/root/testdata/sf0.001"


def test_each_stage_takes_its_operators_decisions(spark, docs, labels):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    before, ids = docs, lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    for name, stage in P.STAGES:
        after = materialise(stage(spark, before, SF))
        if name == "toxicity":
            scored = toxicity.score(before, toxicity.fit(before, labels)).collect()
            want = Counter(r["doc_id"] for r in scored if r["predicted"] == 0)
        elif name == "near_duplicates":
            want = Counter(r["doc_id"] for r in order_minhash.near_duplicates(before).collect() if r["doc_id"] == r["class_id"])
        elif name == "decontamination":
            bad = {r["doc_id"] for r in decontam.overlaps(before, bench).collect()}
            want = Counter({i: n for i, n in ids(before).items() if i not in bad})
        elif name == "mixing":
            want = Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_plan(before).collect() if r["taken"]})
        else:
            want = ids(before)
            plan = Counter((r["doc_id"], r["shard"]) for r in sharding.shard_plan(before).collect())
            assert Counter((r["doc_id"], r["shard"]) for r in after.collect()) == plan
        assert ids(after) == want and want, name
        assert after.columns[:5] == docs.columns, name
        before = after
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
