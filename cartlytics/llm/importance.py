"""Quality by importance resampling of hashed n-gram models.

Two bag-of-n-grams models over ``BUCKETS`` hashed words and word pairs are counted: one of the
target texts (labelled of good quality), one of all raw texts.  A text's log weight is its log likelihood ratio
target : raw, the sum over its n-grams (``sharpness=None``), or, by default, that ratio at the temperature n / ``SHARPNESS`` for a text of n
n-grams, i.e. ``SHARPNESS`` times the mean, so that long texts do not outweigh the noise.  Adding independent Gumbel noise to
the log weights and taking the k largest draws k texts without replacement in proportion to the
weights.  The noise is a seeded hash of the id, so that reruns agree.

All counts cover all rows and all labels; a partition sends one vector of counts.  Whether a row is labelled is asked of a broadcast
bit array of fixed size (2**25 bits); the ids that pass it without a label are found exactly by a join of ids alone, and excluded, so no text
is shuffled.  The k-th largest key is found by
counting keys in ever finer ranges, one aggregation a level, not by a global sort.

Cases: a null or empty text has no n-grams and weight 0 in the log (neutral); ties at the last place
are broken by id; rows equal in all are kept or left together only as far as k allows; without
labelled target texts all log weights are 0; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlytics.llm.common import WordIds, materialise, mix64, ship, small_batches, text_or_empty
from cartlytics.llm.decontam import bits_of, seed_bitmap

ship(__name__)

BUCKETS = 16_384
#: Share of the raw texts that is drawn.
KEEP = 0.8
SHARPNESS = 25.0
#: Ids that pass the bit array without a label: so many are broadcast, more are joined.
BROADCAST_IDS = 500_000
SEED = 23
WORD = r"[^\W_]+|[^\w\s]"


def ngram_buckets(h):
    """Buckets of the words and word pairs of a text's word hashes."""
    import numpy as np

    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([h * np.uint64(0xA0761D6478BD642F), pairs]) >> np.uint64(50)).astype(np.int64)  # 64 - log2(BUCKETS)


COUNTS = T.StructType([T.StructField("target", T.BooleanType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])


def passes(bits, ids):
    """Whether each id (int64) is in the bit array."""
    import numpy as np

    held = np.frombuffer(bits, np.uint8)
    a, b = bits_of(mix64(ids.view(np.uint64)))
    return ((held[a >> 3] >> (a & 7).astype(np.uint8)) & (held[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def mixed_ids(batches: Iterator) -> Iterator:
    """mapInArrow: doc_id -> seed, the id's hash."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(mix64(ids.view(np.uint64)).view(np.int64))], names=["seed"])


def possible_targets(bits):
    """mapInArrow: doc_id (not null) -> the ids that may be labelled."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[passes(bits.value, ids)])], names=["doc_id"])

    return run


def count_ngrams(bits):
    """mapInArrow: doc_id, excluded, text -> COUNTS, one row for each bucket that the partition has."""

    def run(batches: Iterator) -> Iterator:
        import re

        import numpy as np
        import pyarrow as pa

        find, ids = re.compile(WORD).findall, WordIds()
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False) & ~batch.column(1).to_numpy(zero_copy_only=False)
            own = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for target, text in zip((known & passes(bits.value, own)).tolist(), batch.column(2).to_pylist(), strict=True):
                h = ids.array(find(text.lower()))
                if len(h):
                    counts[int(target)] += np.bincount(ngram_buckets(h), minlength=BUCKETS)
        for target in (0, 1):
            at = np.flatnonzero(counts[target])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), bool(target))), pa.array(at.astype(np.int32)), pa.array(counts[target][at])], names=COUNTS.names)

    return run


def log_ratios(docs: DataFrame, target_ids: DataFrame):
    """log(p_target / p_raw) of every bucket, as a numpy vector.  ``target_ids``: distinct doc_id."""
    import numpy as np

    target_ids = materialise(target_ids)
    bits = docs.sparkSession.sparkContext.broadcast(seed_bitmap(target_ids.mapInArrow(mixed_ids, "seed long")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    wrong = materialise(own.select("doc_id").where("doc_id IS NOT NULL").mapInArrow(possible_targets(bits), "doc_id long").distinct()
                        .join(target_ids, "doc_id", "left_anti"))
    few = F.broadcast(wrong) if wrong.count() <= BROADCAST_IDS else wrong
    flagged = own.join(few.select("doc_id", F.lit(True).alias("wrong")), "doc_id", "left").select("doc_id", F.coalesce("wrong", F.lit(False)).alias("excluded"), "text")
    rows = flagged.mapInArrow(count_ngrams(bits), COUNTS).groupBy("target", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * BUCKETS rows
    counts = np.zeros((2, BUCKETS))
    counts[rows["target"].astype(int), rows["bucket"]] = rows["n"]
    target, raw = counts[1], counts[0] + counts[1]  # the raw model is of all texts
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 0.5) / (target + 0.5).sum()) - np.log((raw + 0.5) / (raw + 0.5).sum())


WEIGHTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()),
                         T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())])


def weigh(ratios, sharpness: float | None = SHARPNESS):
    """mapInArrow: doc_id, text_hash, text -> WEIGHTED."""

    def run(batches: Iterator) -> Iterator:
        import re

        import numpy as np
        import pyarrow as pa

        find, ids = re.compile(WORD).findall, WordIds()
        for batch in batches:
            sizes, weights = [], []
            for text in batch.column(2).to_pylist():
                at = ngram_buckets(ids.array(find(text.lower())))
                sizes.append(len(at))
                weights.append(float(ratios[at].sum()) * (1.0 if sharpness is None else sharpness / len(at)) if len(at) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(weights, pa.float64())], names=WEIGHTED.names)

    return run


def largest(keyed: DataFrame, key: str, k: int, bins: int = 4096) -> DataFrame:
    """The ``k`` rows of largest ``key`` (double), ties broken by least tie.  A range that has
    the k-th key is cut into ``bins`` counted ranges until one range has few rows or one key."""
    bounds = keyed.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if k >= bounds["n"]:
        return keyed
    lo, hi, above = bounds["lo"], bounds["hi"], 0  # rows over hi: all taken
    while True:
        inside = keyed.where(F.col(key).between(lo, hi))
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            break
        bin_ = F.least(F.floor((F.col(key) - lo) / width), F.lit(bins - 1))
        counted = sorted(((r["b"], r["n"], r["lo"], r["hi"]) for r in inside.groupBy(bin_.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()), reverse=True)  # at most bins rows
        for _, n, low, high in counted:
            if above + n >= k:
                break
            above += n
        lo, hi = low, high
        if n <= bins or lo == hi:
            break
    edge = keyed.where(F.col(key).between(lo, hi))
    return keyed.where(F.col(key) > hi).unionByName(edge.orderBy(F.col(key).desc(), "tie").limit(k - above))


def resample(docs: DataFrame, target_ids: DataFrame, keep: float = KEEP, seed: int = SEED, sharpness: float | None = SHARPNESS) -> DataFrame:
    """doc_id, n_grams, log_weight and gumbel_key of the drawn texts: round(keep * rows) of them.  ``sharpness``: None for the
    plain likelihood ratio."""
    small_batches(docs.sparkSession)
    ratios = log_ratios(docs, target_ids)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weighted = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(weigh(ratios, sharpness), WEIGHTED)
        .withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
        .withColumn("tie", F.coalesce("doc_id", "text_hash")))
    return largest(weighted, "gumbel_key", round(keep * weighted.count())).select("doc_id", "n_grams", "log_weight", "gumbel_key")


def good_ids(labels: DataFrame) -> DataFrame:
    """The labelled target: distinct ids of good quality."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
