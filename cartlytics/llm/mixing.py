"""Mixing sources to target weights by fitting a word budget exactly.

Each source has a target number of words; a document is taken 0 to ``MAX_REPEAT`` times.  Per
source, documents are only counted by exact length.  The whole repeats that every document
gets are taken off the target; of the rest, each length gets its proportional share of
documents, rounded down, then more documents from the longest length down while they fit, and
the last words are filled by a bounded-knapsack dynamic programme over the documents that
are left.  The number of documents per (source, length) then selects documents in the order of
a seeded hash of their id and text.

Work is on (source, length, count) rows; a source's histogram has at most as many rows as
there are different lengths.  What is selected of a (source, length) is said by one value, the hash at which
it ends (``cuts``), which is looked for within one of 128 ranges of the hash, so that a length that many copies
share is not ordered in one task.  Each document then decides for itself: no text is shuffled.

Cases: a null text has no words; null is a source of its own, the last one; empty documents are
never taken; only rows of equal id and text share a hash: where the cut falls among them, some of them are taken once
less, and only then are rows ranked; an empty table gives no rows; extra columns are ignored (``mix`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlytics.llm.common import fresh, materialise, ship

ship(__name__)

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2
SEED = 17
#: The dynamic programme fills the last words of a source's budget, up to twice this many; more is filled greedily before.
WINDOW_WORDS = 4096
SLICE_BITS = 7  # ranges of the hash
BROADCAST_ROWS = 500_000  # of cuts, a few numbers each
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target.  ``share`` of all words is dealt by weight; no target is above
    ``repeat`` times its source, and the excess is dealt to the others by weight.  The result is
    least(repeat * size, level * weight): the level follows from the sources in the order of
    repeat * size / weight, in one window over the sources (one row each)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = repeat * F.col("source_size").cast("double")
    ordered = totals.withColumn("weight", weight).withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    upto = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.lit(share) * F.sum("source_size").over(every)
    filled = F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    # if all before this one are full, the level that spends the budget; it holds for the first that it does not fill
    level = ordered.withColumn("level", (budget - filled) / open_weight)
    nth = F.row_number().over(Window.orderBy("full_at", F.col("source").asc_nulls_last()))
    holds = F.when(F.col("level") <= F.col("full_at"), F.struct(nth.alias("nth"), "level"))
    level = level.withColumn("holds", holds).withColumn("level", F.min("holds").over(every)["level"])
    return level.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def fit_counts(lengths: list[int], counts: list[int], budget: int, window: int = WINDOW_WORDS) -> list[int]:
    """How many documents of each length to take (0 to its count) so that the lengths add up as
    near to ``budget`` from below as documents allow."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [c * budget // total for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        more = min(counts[i] - take[i], max(0, rest - window) // lengths[i])
        take[i] += more
        rest -= more * lengths[i]
    for i in order:  # documents longer than the window may still be above it
        while rest > 2 * window and take[i] < counts[i] and lengths[i] <= rest:
            take[i] += 1
            rest -= lengths[i]
    # bounded knapsack: by[v] is the length that first reached v words, used[v] how many of it
    goal = min(rest, 2 * window)
    by, used = [0] * (goal + 1), [0] * (goal + 1)
    reached = [True] + [False] * goal
    for i in sorted(order, key=lambda i: lengths[i]):
        left, n = counts[i] - take[i], lengths[i]
        if not left or n > goal or reached[goal]:
            continue
        for v in range(n, goal + 1):
            if not reached[v] and reached[v - n]:
                times = used[v - n] + 1 if by[v - n] == i + 1 else 1
                if times <= left:
                    reached[v], by[v], used[v] = True, i + 1, times
    v = max(v for v in range(goal + 1) if reached[v])
    while v:
        i = by[v] - 1
        take[i] += 1
        v -= lengths[i]
    return take


def fit_source(histogram):
    """applyInPandas over the (size, documents) rows of one source: whole repeats, and how many
    documents of each size get one more."""
    import pandas as pd

    sizes = [int(v) for v in histogram["size"]]
    counts = [int(v) for v in histogram["documents"]]
    total, target = int(histogram["source_size"].iloc[0]), float(histogram["target"].iloc[0])
    base = min(int(target // total), int(histogram["repeat"].iloc[0])) if total else 0
    budget = int(round(target - base * total))
    extra = fit_counts(sizes, counts, budget) if base < int(histogram["repeat"].iloc[0]) else [0] * len(sizes)
    return pd.DataFrame({"source_key": histogram["source_key"], "size": sizes, "base": base, "extra": extra})


def sizes_of(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size (words), order (seeded hash of id and text) of every row, written once."""
    return materialise(docs.select("doc_id", "source", n_words().alias("size"), place_in_order(seed).alias("order")))


def place_in_order(seed: int):
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce("text", F.lit("")))


def source_key():
    """One key for each source, null too."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))


def cuts(sized: DataFrame, of_source: DataFrame, repeat: int = MAX_REPEAT) -> DataFrame:
    """source_key, size, base, cut, tie_take, tie_rows: of the documents of a source and size each is taken ``base`` times; those
    whose order is below ``cut`` once more, and of the ``tie_rows`` rows at ``cut`` itself ``tie_take``."""
    keyed = sized.where("size > 0").withColumn("source_key", source_key()).withColumn("slice", F.shiftright("order", 64 - SLICE_BITS).cast("int"))
    slices = materialise(keyed.groupBy("source_key", "size", "slice").agg(F.count(F.lit(1)).alias("documents")))
    histogram = (slices.groupBy("source_key", "size").agg(F.sum("documents").alias("documents"))
                 .join(of_source.select(source_key().alias("source_key"), "source_size", "target"), "source_key")
                 .withColumn("repeat", F.lit(repeat)))
    fitted = materialise(histogram.groupBy("source_key").applyInPandas(fit_source, "source_key string, size long, base long, extra long"))
    before = F.coalesce(F.sum("documents").over(
        Window.partitionBy("source_key", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = (slices.withColumn("before", before).join(fitted.where("extra > 0").select("source_key", "size", "extra"), ["source_key", "size"])
            .where("before < extra AND extra <= before + documents").select("source_key", "size", "slice", (F.col("extra") - F.col("before")).alias("need")))
    upto = F.sum("tie_rows").over(Window.partitionBy("source_key", "size", "slice").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    ordered = (keyed.groupBy("source_key", "size", "slice", "order").agg(F.count(F.lit(1)).alias("tie_rows")).join(last, ["source_key", "size", "slice"])
               .withColumn("upto", upto).where("need <= upto AND need > upto - tie_rows")
               .select("source_key", "size", F.col("order").alias("cut"), (F.col("need") - F.col("upto") + F.col("tie_rows")).alias("tie_take"), "tie_rows"))
    return materialise(fitted.where("base > 0 OR extra > 0").select("source_key", "size", "base").join(ordered, ["source_key", "size"], "left"))


def _decided(rows: DataFrame, key: str, size: str, order: str, of_size: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` with ``names["times"]``; ``key``, ``size`` and ``order`` are its columns of these meanings."""
    few = of_size.select(*[F.col(c).alias(names[c]) for c in of_size.columns])
    few = F.broadcast(few) if of_size.count() <= BROADCAST_ROWS else few
    joined = rows.join(few, (F.col(key) == F.col(names["source_key"])) & (F.col(size) == F.col(names["size"])), "left")
    cut, take, ties = (F.col(names[c]) for c in ("cut", "tie_take", "tie_rows"))
    more = F.when(F.col(order) < cut, 1).when((F.col(order) == cut) & (take == ties), 1).otherwise(0)
    out = joined.withColumn(names["times"], F.coalesce(F.col(names["base"]) + more, F.lit(0)))
    if of_size.where("tie_take < tie_rows").isEmpty():
        return out
    # the cut falls among equal rows: only these are ranked
    tied = F.coalesce((F.col(order) == cut) & (take < ties), F.lit(False))
    nth = F.row_number().over(Window.partitionBy(key, size, order).orderBy(order))
    some = out.where(tied).withColumn(names["times"], F.col(names["base"]) + F.when(nth <= take, 1).otherwise(0))
    return out.where(~tied).unionByName(some)


_NAMES = ("source_key", "size", "base", "cut", "tie_take", "tie_rows", "times")


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) of every document."""
    sized = sizes_of(docs, seed)
    of_source = materialise(targets(sized, weights, share, repeat))
    rows = sized.select("doc_id", "source", source_key().alias("key"), F.col("size").alias("words"), "order")
    decided = _decided(rows, "key", "words", "order", cuts(sized, of_source, repeat), {c: f"_{c}" for c in _NAMES})
    small = of_source.select(source_key().alias("key"), "source_size", "target")
    return decided.join(small, "key").select("doc_id", "source", F.col("words").alias("size"), "source_size", "target", (F.col("_times") * F.col("words")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns kept."""
    sized = sizes_of(docs, seed)
    of_size = cuts(sized, materialise(targets(sized, weights, share, repeat)), repeat)
    key, size, order, *others = fresh(docs, "key", "words", "order", *_NAMES)
    names = dict(zip(_NAMES, others, strict=True))
    rows = docs.withColumns({key: source_key(), size: n_words(), order: place_in_order(seed)})
    decided = _decided(rows, key, size, order, of_size, names).where(F.col(names["times"]) > 0)
    return decided.withColumn(names["times"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["times"]).cast("long")))).select(*docs.columns)
