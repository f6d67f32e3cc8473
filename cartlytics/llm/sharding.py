"""Sharding by minimax contiguous partition.

Rows of equal text are one atomic group.  Groups are ordered by the MD5 of their text, a uniform
order that needs no sort; a shard is a contiguous range of it.  The smallest feasible shard
capacity is found by binary search, each step a greedy check that fills shards in order, and the
cuts follow that capacity.  A group is larger than an even share only if copies make it so; then
the cuts after the minimal capacity spread what is left evenly.

Law: ``bytes`` (the largest shard is as small as whole groups in this order allow).

The search never sees all groups.  Ranges of the order are summed, at most 16 ** DIGITS for each range at a time; a
cut can only lie in the range that a check ends in, so only those ranges are summed again, finer,
until they are single groups.  Slots number a shard's rows by a hash of the id, in small windows
over an offset table, so that a hot group is numbered in many tasks.

Cases: a null text has no bytes and is grouped with the empty text; repeated rows get slots of
their own; fewer groups than shards leave shards empty; an empty table gives no rows;
extra columns are kept by ``shard_documents``.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlytics.llm.common import materialise, text_or_empty

SHARDS = 8
#: Hex digits of the order that one step tells apart: 4096 ranges.
DIGITS = 3
CELLS = 512


def group_key(text: str = "text"):
    return F.md5(text_or_empty(text).cast("binary"))


def size_of(text: str = "text"):
    return (F.octet_length(text_or_empty(text)) + 1).cast("long")


def _greedy(upto: list[int], capacity: int, shards: int, start: int = 0) -> list[int]:
    """Ends (exclusive) of the ranges with which each shard is full; ``upto``: running sums."""
    ends = []
    for _ in range(shards):
        start = max(start, bisect_right(upto, (upto[start - 1] if start else 0) + capacity))
        ends.append(start)
    return ends


def smallest_capacity(sums: list[int], shards: int) -> int:
    """The least capacity with which greedy filling puts all of ``sums`` into ``shards`` shards."""
    if not sums:
        return 0
    upto = list(accumulate(sums))
    low, high = max(max(sums), -(-upto[-1] // shards)), upto[-1]
    while low < high:
        middle = (low + high) // 2
        if _greedy(upto, middle, shards)[-1] == len(sums):
            high = middle
        else:
            low = middle + 1
    return low


def even_cuts(sums: list[int], shards: int, capacity: int) -> list[int]:
    """Ends of the shards: each takes what is nearest to an even share of what is left, one group at
    least, never more than ``capacity``, and leaves no more than the later ones can take."""

    def even_share(left: list[int], k: int) -> float:
        """The mean of what is left, groups above it having a shard of their own."""
        total = sum(left)
        for large in sorted(left, reverse=True):
            if k == 1 or large * k <= total:
                break
            total, k = total - large, k - 1
        return total / k

    upto, ends, start = list(accumulate(sums)), [], 0
    for k in range(shards, 0, -1):
        base = upto[start - 1] if start else 0
        most = max(start, bisect_right(upto, base + capacity))
        share = even_share(sums[start:], k)
        end = min(most, max(start + 1, bisect_right(upto, base + share)))
        if end < most and upto[end] - base - share < share - ((upto[end - 1] if end else 0) - base):
            end += 1
        while end < most and _greedy(upto, capacity, k - 1, end)[-1:] != [len(sums)] and end < len(sums):
            end += 1
        ends.append(len(sums) if k == 1 else min(end, most))
        start = ends[-1]
    return ends


def _sums(groups: DataFrame, digits: int) -> list[tuple[str, int, bool]]:
    """Ranges of the order by their first digits: (digits, bytes, whether they have several groups)."""
    rows = groups.groupBy(F.substring("key", 1, digits).alias("range")).agg(
        F.sum("size").alias("size"), (F.min("key") != F.max("key")).alias("many")).collect()
    return sorted((r["range"], int(r["size"]), bool(r["many"])) for r in rows)


def cuts(groups: DataFrame, shards: int = SHARDS) -> list[str]:
    """The first key of every shard but the first, for (key, size) rows; ``~``, after all keys, for
    shards that stay empty."""
    ranges = _sums(groups, DIGITS)
    while True:
        sizes = [s for _, s, _ in ranges]
        capacity = smallest_capacity(sizes, shards)
        ends = even_cuts(sizes, shards, capacity)
        # a cut, or the end of a check just below the capacity, may lie within the ranges beside it
        beside = {*ends, *_greedy(list(accumulate(sizes)), capacity - 1, shards)}
        touched = {i for e in beside for i in (e - 1, e) if 0 <= i < len(ranges)} | {i for i, s in enumerate(sizes) if s == capacity}
        fine = {i for i in touched if ranges[i][2]}
        if not fine:
            return [ranges[e][0] if e < len(ranges) else "~" for e in ends[:-1]]
        rest = [r for i, r in enumerate(ranges) if i not in fine]
        for digits in sorted({len(ranges[i][0]) for i in fine}):
            prefixes = [ranges[i][0] for i in fine if len(ranges[i][0]) == digits]
            rest += _sums(groups.where(F.substring("key", 1, digits).isin(prefixes)), digits + DIGITS)
        ranges = sorted(rest)


def shard_of(key, first_keys: list[str]):
    out = F.lit(0)
    for first in first_keys:
        out = out + F.when(key >= first, 1).otherwise(0)
    return out.cast("int")


def shard_plan(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Slots are in the order of (cell, doc_id, key), cells being slices of a hash of the id."""
    rows = materialise(docs.select("doc_id", size_of().alias("size"), F.crc32(text_or_empty()).alias("text_crc32"), group_key().alias("key")))
    placed = (rows.withColumn("shard", shard_of(F.col("key"), cuts(rows, shards)))
              .withColumn("cell", F.pmod(F.xxhash64("doc_id", "size"), F.lit(CELLS)).cast("int")))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("before"))  # at most shards * CELLS rows
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "key"))
    return (placed.withColumn("place", place).join(F.broadcast(offsets), ["shard", "cell"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` with their shard: the cuts come from (key, size) rows, and each row
    finds its shard from its own text, so that no text is shuffled."""
    groups = materialise(docs.select(group_key().alias("key"), size_of().alias("size")))
    return docs.withColumn("shard", shard_of(group_key(), cuts(groups, shards)))
