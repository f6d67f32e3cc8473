import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from cartlytics.llm import turn_repair as X

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?")


def best_by_enumeration(initials, faults):
    """Least (cost, audit, role initials) over all edits of all rows and up to two insertions in each gap."""
    per_row = []
    for x, fault in zip(initials, faults, strict=True):
        more = 5 if fault == "truncated" else 0
        options = [("D", 2, "")]
        if fault not in ("blank", "duplicate"):
            options += [("K", more, x or "?"), ("R", 1 + more, "u"), ("R", 1 + more, "a")]
        per_row.append(options)
    gaps = [("", 0, ""), ("I", 5, "u"), ("I", 5, "a"), ("II", 10, "ua"), ("II", 10, "au")]
    best = None
    for edits in itertools.product(*per_row):
        cost = sum(c for _, c, _ in edits)
        if best and cost > best[0]:
            continue
        for put in itertools.product(gaps, repeat=len(edits) + 1):
            total = cost + sum(c for _, c, _ in put)
            if best and total > best[0]:
                continue
            parts = [put[0], *itertools.chain.from_iterable(zip(edits, put[1:], strict=True))]
            roles = "".join(r for _, _, r in parts)
            if GOOD.fullmatch(roles):
                found = (total, "".join(k for k, _, _ in parts), roles)
                best = min(best, found) if best else found
    return best


def test_search_against_enumeration():
    rng = random.Random(4)
    cases = [([], []), (["s"], [""]), (["u"], [""]), (["a"], [""]), (["s", "s"], ["", ""])]
    for _ in range(150):
        n = rng.randint(1, 4)
        cases.append(([rng.choice("suaax") if rng.random() < 0.9 else "" for _ in range(n)],
                      [rng.choice(["", "", "", "blank", "duplicate", "truncated"]) for _ in range(n)]))
    for initials, faults in cases:
        cost, audit = X.cheapest_edits(initials, faults)
        want = best_by_enumeration(initials, faults)
        assert (cost, audit) == want[:2], (initials, faults)
        after = X.apply_edits([(i, "t") for i in initials], audit)
        assert "".join(r[:1] for r, _ in after) == want[2]


def test_long_conversations_take_linear_work():
    n = 20000
    initials = ["u", "u", "a", "s"] * (n // 4)
    cost, audit = X.cheapest_edits(initials, [""] * n)
    assert len(audit) - audit.count("I") == n and cost > 0
    assert X.cheapest_edits(["u"] * n, [""] * n)[0] == n // 2


def expected(rows):
    """Digest of one damaged conversation by plain code; rows: (turn, role, text) sorted."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(initials[i] + initials[i + 1] not in ("su", "ua", "au") for i in range(len(rows) - 1))
    return faults, initials, (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal)


def damaged_by_hand(rows):
    out = {}
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        d = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        kept = out.setdefault(conv, [])
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        kept += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def check(spark, frame):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in frame.collect()]
    got = {r["conv_id"]: r for r in X.report(X.repair(X.damage(frame)), frame).collect()}
    by_hand = damaged_by_hand(rows)
    assert set(got) == set(by_hand)
    for conv, kept in by_hand.items():
        r, (faults, initials, counts) = got[conv], expected(kept)
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == counts, conv
        if len(initials) <= 4:
            cost, audit, _ = best_by_enumeration(initials, faults)
            assert (r["cost"], r["audit"]) == (cost, audit), conv
        said, at, open_u = [], 0, False
        for letter in r["audit"]:  # the repaired turns, read from the audit alone
            if letter == "I":
                said.append(("assistant" if open_u else "user") + ":")
            else:
                _, role, text = kept[at]
                at += 1
                if letter == "D":
                    continue
                said.append((role if letter == "K" else "assistant" if open_u else "user") + ":" + text)
            open_u = said[-1][0] == "u"
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(said).encode()).hexdigest(), conv
    return got


def test_given_table(spark):
    check(spark, spark.read.parquet(f"{SF}/conversations.parquet"))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "a."), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 9, "", "c!"), (2, 3, "assistant", "    "),
            (None, 1, "user", "x."), (None, None, "assistant", "y."), (4, 5, "sage", "z?"), (4, 6, "user", "z?"), (4, 6, "user", "z?"), (4, 7, "assistant", "w.\n ")]
    rows += [(100 + k, 0, "user", "only.") for k in range(60)]  # some of these lose all rows
    rows += [(7, t, "user" if t % 2 else "assistant", "word " * 3000 + f"{t}.") for t in range(30)]
    frame = spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, dealt string, cost string")
    got = check(spark, frame)
    empty = [r for r in got.values() if r["audit"] == "" and r["cost"] == 0]
    assert empty and all(r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() for r in empty)
    assert X.report(X.repair(X.damage(frame.limit(0))), frame.limit(0)).count() == 0


def test_repeats_across_batches(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} says {t}.") for c in range(50) for t in range(100)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = X.repair(frame.repartition(7)).select("conv_id", "audit", F.size("turns").alias("n")).collect()
    assert {(r["audit"], r["n"]) for r in got} == {("K" * 100, 100)} and len(got) == 50
