"""Bootstrap at the full size, distributed: the bag of little bootstraps.

The rows of a key are dealt by hash into subsets of about ``subset_rows``.  Each subset is resampled to the size of the whole: a
replicate gives its rows multinomial weights that add up to n, the key's number of rows, so that its mean has the spread of
a mean of n rows, not of a subset.  Each subset yields the bias-corrected percentile limits relative to its own
mean; the interval is the whole mean plus their average over subsets, weighted by rows.  A key that fits one subset is resampled n of
n, as in one process.

Equal values of a subset are one row with a count before they meet (their weights are drawn together, which is the same
law), so a task holds at most one subset's distinct values, and replicates are drawn a few at a time.  The number of
replicates a subset is ``n_resamples`` over the number of subsets, ``LEAST`` at least: the cost is linear in the rows.
Seeds come from (seed, key, subset) alone and rows are put in order first, so that any number of partitions gives the same limits.

Cases: NULL values are left out, keys without values have no row; rows of equal unit id and value stay together; a single row
or equal rows have limits at their value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlytics.functions.columns import half_even
from cartlytics.plans.ordered import attach

LEAST = 100
AT_ONCE = 1_000_000  # weights drawn at a time


def subset_limits(values, counts, n: int, replicates: int, confidence: float, seed: int) -> tuple[float, float]:
    """Bias-corrected percentile limits of the mean of n rows, relative to the mean of this subset."""
    from statistics import NormalDist

    import numpy as np

    rng, normal = np.random.default_rng(seed), NormalDist()
    share = counts / counts.sum()
    centre = float((values * share).sum())
    moved = values - centre
    step = max(1, AT_ONCE // len(values))
    means = np.concatenate([rng.multinomial(n, share, size=min(step, replicates - at)) @ moved / n for at in range(0, replicates, step)])
    below = float((means < 0).mean() + (means == 0).mean() / 2)
    at = []
    for tail in ((1 - confidence) / 2, (1 + confidence) / 2):
        if 0 < below < 1:
            at.append(normal.cdf(2 * normal.inv_cdf(below) + normal.inv_cdf(tail)))
        else:
            at.append(float(below >= 1))  # all replicates on one side
    low, high = np.quantile(means, at)
    return float(low), float(high)


def little_bootstrap_ci(long: DataFrame, unit: str = "unit_id", value: str = "value", keys: Sequence[str] = ("metric", "group"), n_resamples: int = 2000,
                        confidence: float = 0.95, seed: int = 42, subset_rows: int = 20_000, decimals: int | None = 2) -> DataFrame:
    """(keys..., mean, ci_low, ci_high) by resamples of the whole size."""
    keys = list(keys)
    data = long.where(F.col(value).isNotNull()).select(*keys, F.col(unit).cast("string").alias("_u"), F.col(value).cast("double").alias("_x"))
    # keys take part in the join below also where they are NULL
    marked = data.withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    sizes = marked.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_mean"), *[F.first(k).alias(k) for k in keys])
    sizes = sizes.withColumn("_m", F.ceil(F.col("_n") / subset_rows))
    dealt = attach(marked.drop(*keys), sizes, ["_key"])
    dealt = dealt.withColumn("_s", F.pmod(F.xxhash64("_u", "_x", F.lit(seed)), F.col("_m")))
    counted = (dealt.groupBy("_key", "_s", "_x").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"), F.first("_m").alias("_m")))

    def limits(table):
        import hashlib

        import numpy as np
        import pyarrow as pa

        key, subset = table.column("_key")[0].as_py(), table.column("_s")[0].as_py()
        n, m = table.column("_n")[0].as_py(), table.column("_m")[0].as_py()
        x, c = table.column("_x").to_numpy(), table.column("_c").to_numpy()
        order = np.argsort(x)
        own = int.from_bytes(hashlib.md5(f"{seed}:{key}:{subset}".encode()).digest()[:8], "big")
        low, high = subset_limits(x[order], c[order], n, max(LEAST, -(-n_resamples // m)), confidence, own)
        return pa.table({"_key": pa.array([key]), "_low": pa.array([low]), "_high": pa.array([high]), "_rows": pa.array([int(c.sum())])})

    schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_low", T.DoubleType()), T.StructField("_high", T.DoubleType()), T.StructField("_rows", T.LongType())])
    each = counted.groupBy("_key", "_s").applyInArrow(limits, schema)
    both = each.groupBy("_key").agg(*[(F.sum(F.col(c) * F.col("_rows")) / F.sum("_rows")).alias(c) for c in ("_low", "_high")])
    out = both.join(sizes, "_key").select(*keys, F.col("_mean").alias("mean"), (F.col("_mean") + F.col("_low")).alias("ci_low"), (F.col("_mean") + F.col("_high")).alias("ci_high"))
    if decimals is not None:
        out = out.withColumn("ci_low", half_even("ci_low", decimals)).withColumn("ci_high", half_even("ci_high", decimals))
    return out
