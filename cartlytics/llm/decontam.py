"""Benchmark decontamination by spaced-seed hashing.

A spaced seed reads the words under the ones of a mask and ignores those under the zeros,
so a substituted word under a zero does not hide a match.  Seeds of the benchmark items
and of the documents meet in a join; each (document, item, diagonal) that meets is
verified: along the diagonal, words are compared one by one, and the overlap is reported
if it has a stretch of at least ``MIN_WORDS`` words (or the whole item, if shorter) in
which at least ``MIN_SHARE`` of the words agree.

Only seeds that a benchmark item may have leave the document pass: a bit array of fixed
size (2**BITS bits, whatever the benchmark's size) drops the others, and the join decides
exactly.  With a seed go no texts; the words around the seeds of a document travel once
per region of seeds, as 32-bit hashes.

Words are lower-cased runs of letters and digits.  Items of one to four words are sought as exact phrases, by seeds of their
whole length; they are reported by ``overlaps``, but too little evidence for ``clean_documents`` to reject a document.
Cases: null texts are empty; items without words are never found; equal items are all
reported; repeated documents (equal doc_id and text) give the same row once; extra columns
are ignored; empty tables give no rows.  Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlytics.llm.common import WordIds, fresh, materialise, ship, small_batches, text_or_empty

ship(__name__)

#: Fixed masks; weight 5 each.
MASKS = ("11111", "110111", "1101011", "10110011")
MIN_WORDS = 12
MIN_SHARE = 0.8
BITS = 25
BROADCAST_ITEMS = 200_000
#: Words of context on both sides of a region's seeds: an overlap of MIN_WORDS words around a seed lies within.
CONTEXT = 64
WORD = r"[^\W_]+"

HITS = T.StructType([
    T.StructField("kind", T.IntegerType()),  # 0: a seed, 1: a region
    T.StructField("doc_id", T.LongType()),
    T.StructField("text_hash", T.LongType()),
    T.StructField("region", T.IntegerType()),  # position of the region's first word
    T.StructField("seed", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("words", T.BinaryType()),  # uint32 hashes
])
SEEDS = T.StructType([
    T.StructField("kind", T.IntegerType()),  # 0: a seed, 1: an item's words
    T.StructField("item_id", T.LongType()),
    T.StructField("seed", T.LongType()),
    T.StructField("item_pos", T.IntegerType()),
    T.StructField("item_words", T.BinaryType()),
])
OVERLAPS = T.StructType([
    T.StructField("text_hash", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("doc_word", T.IntegerType()),
    T.StructField("n_words", T.IntegerType()),
    T.StructField("n_equal", T.IntegerType()),
])


def seed_hashes(h, mask: str):
    """One 64-bit seed per position at which the mask fits into the word hashes ``h``."""
    import numpy as np

    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for k in (i for i, c in enumerate(mask) if c == "1"):
        out = (out ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def bits_of(seed):
    """Two bit positions for each seed."""
    import numpy as np

    return (seed >> np.uint64(64 - BITS)).astype(np.int64), (seed & np.uint64((1 << BITS) - 1)).astype(np.int64)


def benchmark_seeds(batches: Iterator) -> Iterator:
    """mapInArrow: item_id, text -> SEEDS."""
    import re

    import numpy as np
    import pyarrow as pa

    find, ids = re.compile(WORD).findall, WordIds()
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = ids.array(find((text or "").lower()))
            if not len(h):
                continue
            rows.append((1, item, None, None, h.astype(np.uint32).tobytes()))
            for mask in MASKS if len(h) >= 5 else ("1" * len(h),):
                rows += [(0, item, s, p, None) for p, s in enumerate(seed_hashes(h, mask).view(np.int64).tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
            names=SEEDS.names)


def document_hits(bitmap, masks=MASKS):
    """mapInArrow: doc_id, text_hash, text -> HITS; ``bitmap``: broadcast bytes of 2**BITS bits."""

    def run(batches: Iterator) -> Iterator:
        import re

        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(bitmap.value, np.uint8)
        find, ids = re.compile(WORD).findall, WordIds()

        def inside(at):
            return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1

        for batch in batches:
            out = [[] for _ in HITS.names]
            for doc, whole, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = ids.array(find(text.lower()))
                seeds, places = [], []
                for mask in masks:
                    s = seed_hashes(h, mask)
                    a, b = bits_of(s)
                    at = np.flatnonzero(inside(a))
                    at = at[inside(b[at]) > 0]
                    seeds.append(s[at])
                    places.append(at)
                at = np.concatenate(places)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, s = at[order], np.concatenate(seeds)[order]
                cut = np.flatnonzero(np.diff(at, prepend=-10**9) > CONTEXT)
                small = h.astype(np.uint32)
                for lo, hi in zip(cut, [*cut[1:], len(at)], strict=True):
                    region = max(0, int(at[lo]) - CONTEXT)
                    n = int(hi - lo)
                    for column, values in zip(out, (
                            [1] + [0] * n, [doc] * (n + 1), [whole] * (n + 1), [region] * (n + 1),
                            [None, *s[lo:hi].view(np.int64).tolist()], [None, *at[lo:hi].tolist()],
                            [small[region:int(at[hi - 1]) + CONTEXT].tobytes(), *[None] * n]), strict=True):
                        column += values
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                names=HITS.names)

    return run


def best_stretch(equal, least: int, share: float):
    """The stretch of at least ``least`` words with most equal ones among those with ``share`` equal:
    (start, length, equal words) or None.  A stretch qualifies iff the sum of (equal - share) is >= 0."""
    import numpy as np

    n = len(equal)
    if n < least:
        return None
    total = np.concatenate([[0], np.cumsum(equal)])
    height = total - share * np.arange(n + 1)
    # for each end, the earliest start whose height is not above: the running minimum is monotone
    low = np.minimum.accumulate(height)
    best = None
    for end in range(least, n + 1):
        start = int(np.searchsorted(-low, -(height[end] + 1e-9), side="left"))
        if start <= end - least:
            found = int(total[end] - total[start])
            if best is None or found > best[2]:
                best = (start, end - start, found)
    return best


def verify(batches: Iterator) -> Iterator:
    """mapInArrow: text_hash, region, words, item_id, item_words, diagonal -> OVERLAPS."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows = []
        for doc, region, words, item, item_words, diagonal in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            d, b = np.frombuffer(words, np.uint32), np.frombuffer(item_words, np.uint32)
            shift = diagonal - region  # item word j faces region word j + shift
            lo, hi = max(0, -shift), min(len(b), len(d) - shift)
            found = best_stretch((b[lo:hi] == d[lo + shift:hi + shift]).astype(np.int64), min(MIN_WORDS, len(b)), MIN_SHARE) if hi > lo else None
            if found:
                rows.append((doc, item, diagonal + lo + found[0], found[1], found[2]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
            names=OVERLAPS.names)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The best overlap of each contaminated (doc_id, item_id): doc_word (position of its first
    word in the document, words from 0), n_words, n_equal."""
    hits, found = _overlaps_of_texts(docs, benchmark)
    return (hits.where("kind = 1").select("doc_id", "text_hash").distinct().join(found, "text_hash")
            .select("doc_id", "item_id", "doc_word", "n_words", "n_equal"))


def _overlaps_of_texts(docs: DataFrame, benchmark: DataFrame, phrases: bool = True) -> tuple[DataFrame, DataFrame]:
    """The hits of the documents, and the overlaps by 64-bit hash of the text: copies are verified once.  ``phrases``: items of
    under five words, too."""
    spark = docs.sparkSession
    small_batches(spark)
    seeds = materialise(benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
                        .mapInArrow(benchmark_seeds, SEEDS))
    lengths = F.length("item_words") / 4
    if not phrases:
        long = seeds.where("kind = 1").where(lengths >= 5).select("item_id").distinct()
        seeds = materialise(seeds.join(F.broadcast(long) if long.count() <= BROADCAST_ITEMS else long, "item_id", "left_semi"))
    short = [int(r["n"]) for r in seeds.where("kind = 1").select(lengths.alias("n")).where("n < 5").distinct().collect()]  # at most 4
    masks = (*MASKS, *("1" * n for n in sorted(short)))
    bitmap = spark.sparkContext.broadcast(seed_bitmap(seeds.where("kind = 0")))
    hits = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
                       .select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
                       .mapInArrow(document_hits(bitmap, masks), HITS))
    met = (hits.where("kind = 0").select("text_hash", "region", "seed", "pos").distinct()
           .join(seeds.where("kind = 0").select("seed", "item_id", "item_pos"), "seed")
           .select("text_hash", "region", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
           .distinct())
    regions = hits.where("kind = 1").groupBy("text_hash", "region").agg(F.max("words").alias("words"))
    found = (met.join(regions, ["text_hash", "region"])
             .join(seeds.where("kind = 1").groupBy("item_id").agg(F.max("item_words").alias("item_words")), "item_id")
             .select("text_hash", "region", "words", "item_id", "item_words", "diagonal")
             .mapInArrow(verify, OVERLAPS))
    best = F.max(F.struct("n_equal", (-F.col("n_words")).alias("s"), (-F.col("doc_word")).alias("w"))).alias("b")
    return hits, (found.groupBy("text_hash", "item_id").agg(best)
                  .select("text_hash", "item_id", (-F.col("b.w")).alias("doc_word"), (-F.col("b.s")).alias("n_words"),
                          F.col("b.n_equal").alias("n_equal")))


def seed_bitmap(seeds: DataFrame) -> bytes:
    """2**BITS bits as bytes: at most 2**(BITS - 6) rows of 64 bits come to the driver."""
    import numpy as np

    value = F.col("seed")
    places = F.explode(F.array(F.shiftrightunsigned(value, 64 - BITS), value.bitwiseAND(F.lit((1 << BITS) - 1))))
    words = (seeds.select(places.alias("bit"))
             .select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
             .groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas())
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
    return bits.tobytes()


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has no overlap with any item of five words or more, all columns kept.  Spark
    broadcasts the hashes of the rejected texts only if the written table is small enough."""
    name, = fresh(docs, "rejected")
    bad = materialise(_overlaps_of_texts(docs, benchmark, phrases=False)[1].select(F.col("text_hash").alias(name)).distinct())
    return docs.join(bad, F.xxhash64(text_or_empty()) == F.col(name), "left_anti")
