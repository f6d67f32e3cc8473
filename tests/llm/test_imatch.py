import hashlib

from cartlytics.llm import imatch as X
from conftest_llm import ODD, frame, sentence


def edited(texts):
    """SHA-256 of each text's edited form, for texts in the order of their ids."""
    out = []
    for i, t in enumerate(texts):
        cut, after = len(t) // 4, texts[(i + 1) % len(texts)]
        out.append(hashlib.sha256((t[:len(t) - cut] + after[:cut]).encode()).hexdigest())
    return out


def test_table(spark, docs):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = sorted(X.fingerprints(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    assert [r["n_chars"] for r in got] == [len(t) for _, t in rows]
    assert [r["edited_sha256"] for r in got] == edited([t for _, t in rows])
    same = {}
    for (_, t), r in zip(rows, got):
        assert same.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    near = sum(r["near_edited"] > r["near_next"] for r in got) / len(got)
    assert near > 0.9 and sum(r["near_next"] for r in got) / len(got) < 0.1


def test_successors_across_ranges(spark):
    rows = [(i * i * 10**9 - 7, sentence(i, 3 + i % 40), "a") for i in range(500)]
    got = sorted(X.fingerprints(frame(spark, rows).repartition(7)).collect(), key=lambda r: r["doc_id"])
    texts = [t for _, t, _ in sorted(rows)]
    assert [r["edited_sha256"] for r in got] == edited(texts)


def test_odd_rows(spark, odd, empty):
    got = X.fingerprints(odd).collect()
    assert len(got) == len(ODD)
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert sorted(r["edited_sha256"] for r in got) == sorted(edited([t or "" for _, t, _ in order]))
    assert X.fingerprints(empty).count() == 0
    one = X.fingerprints(frame(spark, [(5, "single text here", "a")])).first()
    assert one["edited_sha256"] == edited(["single text here"])[0] and one["near_next"] == 1.0


def test_copies_and_rare_words(spark):
    """A text in a third of the rows, boilerplate in a sixth and long texts in words of their own keep their likeness to their edited form."""
    rare = lambda i, n: " ".join(f"zq{i}w{k}" for k in range(n))
    kinds, rows = {}, []
    for i in range(600):
        kinds[i] = "copy" if i % 3 == 0 else "boiler" if i % 6 == 1 else "rare" if i % 24 == 2 else "other"
        text = {"copy": rare("copy", 120), "boiler": rare("boiler", 150) + f" only{i}", "rare": rare(i, 200)}.get(kinds[i]) or sentence(i, 20 + i % 200)
        rows.append((i, text, "a"))
    got = {r["doc_id"]: r for r in X.fingerprints(frame(spark, rows)).collect()}
    for kind in ("copy", "boiler", "rare"):
        near = [got[i]["near_edited"] for i in got if kinds[i] == kind]
        assert sum(near) / len(near) > 0.3 and sum(x == 0 for x in near) <= len(near) / 20, (kind, near)
    unlike = [got[i]["near_next"] for i in range(599) if kinds[i] != kinds[i + 1]]
    assert sum(unlike) / len(unlike) < 0.05


def test_document_frequency_counts_distinct_texts(spark):
    """Copies of one text do not push its terms out of the band."""
    rows = [(i, sentence(i, 50), "a") for i in range(300)]
    lexicon = lambda rs: {r["term"] for r in X.lexicon(frame(spark, rs)).collect()}
    assert lexicon(rows) == lexicon(rows + [(1000 + i, rows[0][1], "a") for i in range(150)])


# ---------------------------------------------------------------- the same by plain code

def spark_hash(*values):
    """Spark's xxhash64 of strings, longs and ints: each value is hashed with the hash so far as its seed."""
    import struct

    import xxhash

    h = 42
    for kind, v in values:
        raw = v.encode() if kind == "s" else struct.pack("<q" if kind == "l" else "<i", v)
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def terms_of(text):
    import regex

    return sorted({spark_hash(("s", w)) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w})


def first_level(n):
    import math

    return min(X.LEVELS, max(1, math.ceil(math.log2(n) / 2)))


def parts_of(terms):
    if not terms:
        return "0:"
    out = []
    for bit in range((first_level(len(terms)) - 1) * X.SUBSETS, X.LEVELS * X.SUBSETS):
        for half in (0, 1):
            kept = [t for t in terms if spark_hash(("l", t), ("i", half), ("i", bit)) % 4 ** (bit // X.SUBSETS + 1) == 0]
            h = spark_hash(*[("l", t) for t in kept]) if kept else 42
            out.append(f"{h & (1 << 64) - 1:X}"[-8:].replace("2A", ""))
    return f"{len(terms)}:" + ",".join(out)


def fingerprint_of(text, lexicon):
    every = terms_of(text)
    found = [t for t in every if t in lexicon]
    scarce = len(found) < X.SCARCE[0] or len(found) * X.SCARCE[1] < len(every)
    return parts_of(found) + ("|" + parts_of(every) if scarce else "")


def alike(a, b):
    if a == b:
        return 1.0
    (na, pa), (nb, pb) = ((int(x.split(":")[0]), x.split(":")[1].split(",")) for x in (a, b))
    if not na or not nb:
        return 0.0
    first = first_level(max(na, nb))
    pa, pb = (p[(first - first_level(n)) * 2 * X.SUBSETS:] for p, n in ((pa, na), (pb, nb)))
    some = [(x, y) for x, y in zip(pa, pb, strict=True) if x or y]
    return sum(x == y for x, y in some) / len(some) if some else 0.0


def likeness_of(a, b):
    (la, wa), (lb, wb) = ((x.split("|")[0], x.split("|")[-1]) for x in (a, b))
    few = any(int(x.split(":")[0]) < X.FEW[0] or int(x.split(":")[0]) * X.FEW[1] < int(w.split(":")[0]) for x, w in ((la, wa), (lb, wb)))
    return alike(wa, wb) if "|" in a and "|" in b and few else alike(la, lb)


def test_band_subsets_and_likeness_by_plain_code(spark, docs):
    """Every returned column again; the likenesses follow from the returned fingerprints alone."""
    from collections import Counter

    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    texts = [t for _, t in rows]
    df = Counter(t for text in set(texts) for t in terms_of(text))
    n = len(set(texts))
    lexicon = {t for t, k in df.items() if max(1, X.MIN_SHARE * n) <= k <= max(1, X.MAX_SHARE * n)}
    got = sorted(X.fingerprints(docs).collect(), key=lambda r: r["doc_id"])
    assert {r["term"] for r in X.lexicon(docs).collect()} == lexicon
    for k, r in enumerate(got):
        following = texts[(k + 1) % len(texts)]
        cut = len(texts[k]) // 4
        assert r["fingerprint"] == fingerprint_of(texts[k], lexicon), r["doc_id"]
        assert r["edited_fingerprint"] == fingerprint_of(texts[k][:len(texts[k]) - cut] + following[:cut], lexicon)
        assert r["near_edited"] == likeness_of(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == likeness_of(r["fingerprint"], got[(k + 1) % len(got)]["fingerprint"])
