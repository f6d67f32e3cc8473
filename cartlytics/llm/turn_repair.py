"""Repair of a conversation's structure by depth-first branch-and-bound.

A conversation is a sequence of rows (role, text); it is well formed if the initials of its roles
read ``(s?(ua)+)?``.  Each row is kept (cost 0), given the role user or assistant (1), or deleted (2);
a turn of user or assistant without text may be inserted anywhere (5).  Blank rows and repeated ones (same role and
text as an earlier row of the conversation) must be deleted; a truncated row that is not deleted
costs 5 more.  ``repair`` finds the cheapest edits, and among these the audit, the string of their initials
(D, I, K, R), that is least in ASCII order.

The search (``cheapest_edits``) keeps an explicit stack of prefixes.  A node is (rows decided, what the
role pattern has reached).  Its suffix lower bound is the least cost of the rows still to come from that
node, found backwards once; it relaxes the audit only, so that the first dive ends in an optimum.  The incumbent is
(cost, audit).  Prefixes whose cost and bound are equal come in ASCII order of their audits (edits are tried by bound,
then letter), so a prefix is cut if its cost and bound reach the incumbent's cost: it is dearer, or its audit is greater.
A table by node holds the cheapest prefix that came there, and cuts later ones that are not cheaper in the same way.
The search ends when the stack is empty: the incumbent is then proved.  Since the bound is exact but for
the audit, only nodes of optimal prefixes are expanded, each once; the time is linear in the rows.

Cases: a null role or text is one space; rows are in the order of turn (null first), role, text, so that
ties and repeated rows have one order; rows of a null conv_id are one conversation; a conversation without
rows has no faults and no edits; extra columns are ignored; an empty table gives no rows.
A conversation's result is one row (its audit has a letter a row), so its rows meet in one task; they
come sorted, and the task holds one conversation at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlytics.llm.common import fresh, partitions, ship, small_batches

ship(__name__)

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = "\t\n\x0b\x0c\r "
# What the pattern (s?(ua)+)? has reached: nothing, s, an open u, a closed ua.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn of user or assistant, whichever the pattern wants next, leads from each of these.
NEXT = (USER, USER, ASSISTANT, USER)
WANTS = ("user", "user", "assistant", "user")

REPAIRED = T.StructType([
    T.StructField("conv_id", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    T.StructField("audit", T.StringType()),
    T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))),
])


def kept_as(state: int, initial: str) -> int:
    """Where a kept row of this initial leads, or -1."""
    if initial == "s":
        return SYSTEM if state == START else -1
    if initial == WANTS[state][0]:
        return NEXT[state]
    return -1


def choices(state: int, initial: str, fault: str) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row, in ASCII order."""
    out = [("D", DELETE, state)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        if (kept := kept_as(state, initial)) >= 0:
            out.append(("K", KEEP + more, kept))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


def suffix_bounds(initials: list[str], faults: list[str]) -> list[list[int]]:
    """Least cost of rows i, i + 1, ... from each state, for every i."""
    def with_insertions(costs: list[int]) -> list[int]:
        once = [min(costs[s], INSERT + costs[NEXT[s]]) for s in range(4)]
        return [min(once[s], INSERT + once[NEXT[s]]) for s in range(4)]

    unreachable = 1 << 60
    bounds = [with_insertions([0, unreachable, unreachable, 0])]
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        after = bounds[-1]
        bounds.append(with_insertions([min(c + after[t] for _, c, t in choices(s, initial, fault)) for s in range(4)]))
    return bounds[::-1]


def cheapest_edits(initials: list[str], faults: list[str]) -> tuple[int, str]:
    """(cost, audit) of the best repair of a conversation's rows."""
    n, bounds = len(initials), suffix_bounds(initials, faults)
    cheapest: dict[tuple[int, int], int] = {}
    best_cost, best_audit = 1 << 60, None
    # (rows decided, state, cost, letters as a linked list: (letter, rest))
    stack = [(0, START, 0, None)]
    while stack:
        i, state, cost, letters = stack.pop()
        bound = cost + bounds[i][state]
        # what comes later with the incumbent's cost has a greater audit
        if bound >= best_cost or cheapest.get((i, state), 1 << 60) <= cost:
            continue
        cheapest[i, state] = cost
        if i == n and state in (START, ASSISTANT):
            best_cost, best_audit = cost, _letters(letters)
            continue
        found = [(cost + INSERT, "I", i, NEXT[state])]
        if i < n:
            found += [(cost + c, letter, i + 1, t) for letter, c, t in choices(state, initials[i], faults[i])]
        # the last pushed comes first: least bound, then least letter
        found.sort(key=lambda x: (x[0] + bounds[x[2]][x[3]], x[1]), reverse=True)
        for c, letter, j, t in found:
            if c + bounds[j][t] < best_cost:
                stack.append((j, t, c, (letter, letters)))
    return best_cost, best_audit


def _letters(linked) -> str:
    out = []
    while linked is not None:
        letter, linked = linked
        out.append(letter)
    return "".join(reversed(out))


def apply_edits(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns after the edits of an audit."""
    out, i, state = [], 0, START
    for letter in audit:
        if letter == "I":
            out.append((WANTS[state], ""))
            state = NEXT[state]
            continue
        role, text = rows[i]
        i += 1
        if letter == "K":
            out.append((role, text))
            state = kept_as(state, role[:1])
        elif letter == "R":
            out.append((WANTS[state], text))
            state = NEXT[state]
    return out


class _Conversation:
    """Rows of one conversation, and the faults found in them."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.turns, self.seen, self.faults = conv_id, [], set(), set(), []

    def add(self, turn, role: str, text: str) -> None:
        import hashlib

        said = text.strip(SPACE)
        mark = hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
        fault = ("blank" if not said else "duplicate" if mark in self.seen else "truncated" if said[-1] not in ".!?" else "")
        self.seen.add(mark)
        self.faults.append(fault)
        self.rows.append((role, text))
        if turn is not None:
            self.turns.add(turn)

    def result(self) -> tuple:
        initials = [r[:1] for r, _ in self.rows]
        cost, audit = cheapest_edits(initials, self.faults)
        gaps = max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        counts = [self.faults.count(f) for f in ("blank", "duplicate", "truncated")]
        return (self.conv_id, gaps, *counts, illegal, cost, audit, [{"role": r, "text": t} for r, t in apply_edits(self.rows, audit)])


def repair_sorted(batches: Iterator) -> Iterator:
    """mapInArrow: conv_id, turn, role, text, sorted by conversation -> REPAIRED."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, now = to_arrow_schema(REPAIRED), None
    for batch in batches:
        done = []
        for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(conv)
            now.add(turn, role, text)
        if done:
            yield _batch(done, schema)
    if now is not None:
        yield _batch([now.result()], schema)


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns (array of role and text, as repaired)
    of every conversation that has rows in ``turns`` (conv_id, turn, role, text)."""
    spark = turns.sparkSession
    small_batches(spark)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _or_space("role").alias("role"), _or_space("text").alias("text"))
    return (rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
            .mapInArrow(repair_sorted, REPAIRED))


# ---------------------------------------------------------------- damage

def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by crc32 of ``conv_id:turn`` modulo 20 (a null is one space): 0 drops the
    row, 1 empties its text, 2 takes its full stops, question and exclamation marks away, 3 repeats it,
    4 makes it the user's.  conv_id, turn, role, text."""
    dealt, many = fresh(conversations.select("conv_id", "turn", "role", "text"), "dealt", "many")
    rows = conversations.select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"))
    rows = rows.withColumn(dealt, F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")) % 20)
    d = F.col(dealt)
    damaged = rows.where(d != 0).select(
        "conv_id", "turn", F.when(d == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(d == 1, F.lit("")).when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(d == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias(many))
    return damaged.drop(many)


def report(repaired: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conv_ids``: the counts, cost and audit of its repair and the SHA-256 of its
    repaired turns; zeros where nothing was to be repaired."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    said = repaired.select(F.col("conv_id").alias("repaired_id"), *counts, "audit", F.sha2(whole, 256).alias("repaired_sha256"))
    ids = conv_ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.join(said, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left")
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
