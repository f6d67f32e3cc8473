"""Equi-joins that survive a hot key on either side or on both.

``frequent_keys`` finds the keys that hold more than a share of a frame's rows with a frequent-items sketch: partial
sketches of bounded size are built where the rows are, merged, and the few candidates are then counted exactly, so that no key
above the share is missed (the sketch keeps at least ``8 / share`` counters) and none below it is taken.

``skew_join`` cuts the rows of such keys into fragments: with L fragments on the left and R on the right, a left row
gets one of L numbers and is repeated for all R, a right row gets one of R numbers and is repeated for all L, and rows meet where
both numbers agree.  Each pair of rows meets exactly once, and no task has more than about ``rows_a_task`` rows
of a key.  Other rows keep fragment (0, 0) and are not repeated; no row is dropped.  Where no key is hot, the join is a plain one.

A row's number is a hash of its own values and of its partition, so a task that is run again deals its rows the same way,
and rows that are equal in all columns go to as many fragments as the partitions that they come from.  (A row's place in its
partition would spread them further, but it may change when a task is run again.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlytics.session import materialise

SHARE = 0.01
ROWS_A_TASK = 1_000_000
MOST_KEYS = 1000  # 1 / share at most: the table of hot keys is broadcast


def frequent_keys(df: DataFrame, keys: Sequence[str], share: float = SHARE) -> DataFrame:
    """keys..., n (exact) of the keys that hold more than ``share`` of the rows; NULL keys never join and are left out."""
    if not 1 / MOST_KEYS <= share < 1:
        raise ValueError(f"share must be in [{1 / MOST_KEYS}, 1)")
    rows = df.select(*keys).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).withColumn("_k", F.xxhash64(*keys))
    counters = 1 << max(10, (int(8 / share)).bit_length())
    top = rows.agg(F.expr(f"approx_top_k(_k, {min(counters // 2, int(2 / share))}, {counters})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    found = [t["item"] for t in top["top"] or [] if t["count"] > share * top["n"] / 2]
    if not found:
        return df.sparkSession.createDataFrame([], rows.drop("_k").schema).withColumn("n", F.lit(0).cast("long"))
    counted = rows.where(F.col("_k").isin(found)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > share * top["n"])


def _fragment(df: DataFrame, count: Column) -> Column:
    """A number from 0 to count - 1 for each row."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return F.pmod(F.xxhash64(*plain, F.spark_partition_id()), count)


def _range(count: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), count - 1)


def hot_fragments(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", share: float = SHARE,
                  rows_a_task: int = ROWS_A_TASK) -> DataFrame | None:
    """keys..., _l, _r: fragments of each hot key, or None if no key needs any.  Written and small."""
    keys = list(keys)
    a = frequent_keys(left, keys, share).withColumnRenamed("n", "_nl")
    b = frequent_keys(right, keys, share).withColumnRenamed("n", "_nr")
    parts = lambda n: F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce(n, F.lit(0)) / rows_a_task))
    both = a.join(b, keys, "full").select(*keys, parts(F.col("_nl")).alias("_l"), parts(F.col("_nr")).alias("_r"))
    if how != "inner":  # a left row must meet all of its key's rows at once, or it would seem to have none
        both = both.withColumn("_r", F.lit(1).cast("long"))
    both = materialise(both.where("_l > 1 OR _r > 1"))
    return None if both.isEmpty() else both


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", share: float = SHARE,
              rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``left.join(right, keys, how)`` for ``inner`` and ``left``, hot keys in fragments."""
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    keys = list(keys)
    hot = hot_fragments(left, right, keys, how, share, rows_a_task)
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot)  # at most 2 / share rows
    one = F.lit(1).cast("long")
    a = left.join(hot, keys, "left").withColumn("_l", F.coalesce("_l", one)).withColumn("_r", F.coalesce("_r", one))
    a = a.withColumn("_fl", _fragment(left, F.col("_l"))).withColumn("_fr", F.explode(_range(F.col("_r")))).drop("_l", "_r")
    b = right.join(hot, keys, "left").withColumn("_l", F.coalesce("_l", one)).withColumn("_r", F.coalesce("_r", one))
    b = b.withColumn("_fr", _fragment(right, F.col("_r"))).withColumn("_fl", F.explode(_range(F.col("_l")))).drop("_l", "_r")
    return a.join(b, [*keys, "_fl", "_fr"], how).drop("_fl", "_fr")
