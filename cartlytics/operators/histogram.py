"""Plot-ready histogram tables (H1, H2): counts per bin, bins as numpy makes them.

Statistics per key (n, min, max, quartiles) are one aggregation; each row's
bin is then pure arithmetic and the counts are a partial+final aggregate.
Only non-empty bins are emitted, so the output is bounded by the data even when
the automatic rule asks for very many bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlytics.plans.ordered import attach, ordered_summary


def _assign(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Bin index as np.histogram computes it for equal-width bins.

    Expects columns _lo, _hi (outer edges) and _nb (number of bins).
    """
    x = F.col(value).cast("double")
    rng = F.col("_hi") - F.col("_lo")
    step = rng / F.col("_nb")

    def edge(i: Column) -> Column:
        return F.when(i == F.col("_nb"), F.col("_hi")).otherwise(i * step + F.col("_lo"))

    idx = (((x - F.col("_lo")) / rng) * F.col("_nb")).cast("long")
    idx = F.when(idx == F.col("_nb"), idx - 1).otherwise(idx)
    out = df.withColumn("_i0", idx)
    out = out.withColumn("_i1", F.when(x < edge(F.col("_i0")), F.col("_i0") - 1)
                         .otherwise(F.col("_i0")))
    out = out.withColumn("bin", F.when((x >= edge(F.col("_i1") + 1))
                                       & (F.col("_i1") != F.col("_nb") - 1), F.col("_i1") + 1)
                         .otherwise(F.col("_i1")))
    # a sum that is evaluated anew can differ from the edge it gave in the last bit: it stays in the outer bin
    out = out.withColumn("bin", F.greatest(F.lit(0).cast("long"), F.least("bin", F.col("_nb") - 1)))
    counts = out.groupBy(*keys, "bin", "_lo", "_hi", "_nb").agg(F.count(F.lit(1)).alias("count"))
    return counts.select(*keys, "bin", edge(F.col("bin")).alias("lower"),
                         edge(F.col("bin") + 1).alias("upper"), "count")


def _edges(stats: DataFrame) -> DataFrame:
    """Outer edges: (min, max), widened by 0.5 when min == max."""
    same = F.col("_min") == F.col("_max")
    return (stats.withColumn("_lo", F.when(same, F.col("_min") - 0.5).otherwise(F.col("_min")))
                 .withColumn("_hi", F.when(same, F.col("_max") + 0.5).otherwise(F.col("_max"))))


def histogram_fixed(df: DataFrame, value: str, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """H2: ``bins`` equal-width bins between min and max (per key)."""
    keys = list(keys)
    data = df.where(F.col(value).isNotNull())
    stats = data.groupBy(*keys).agg(F.min(F.col(value).cast("double")).alias("_min"),
                                    F.max(F.col(value).cast("double")).alias("_max"))
    stats = _edges(stats).withColumn("_nb", F.lit(bins).cast("long")).drop("_min", "_max")
    return _assign(attach(data, stats, keys), value, keys)


def histogram_auto(df: DataFrame, value: str, keys: Sequence[str] = (),
                   integer_width: bool | None = None, n_buckets: int | None = None) -> DataFrame:
    """H1: numpy ``bins='auto'`` (what seaborn ``histplot`` uses).

    width = min(Freedman-Diaconis 2*IQR*n^(-1/3), Sturges range/(log2 n + 1)),
    Sturges alone when IQR = 0; bins = ceil(range / width); integer data has
    width at least 1 (D18; detected from the column type unless given).
    """
    keys = list(keys)
    if integer_width is None:
        integer_width = isinstance(df.schema[value].dataType, T.IntegralType)
    data = df.where(F.col(value).isNotNull())
    v = data.select(*keys, F.col(value).cast("double").alias("_v"))
    stats = ordered_summary(v, "_v", [0.25, 0.75], keys, n_buckets).select(
        *keys, F.col("count").alias("_n"), F.col("min").alias("_min"), F.col("max").alias("_max"), F.col("q0").alias("_q25"), F.col("q1").alias("_q75"))
    ptp = F.col("_max") - F.col("_min")
    fd = 2.0 * (F.col("_q75") - F.col("_q25")) * F.pow(F.col("_n").cast("double"), F.lit(-1.0 / 3.0))
    sturges = ptp / (F.log2(F.col("_n").cast("double")) + 1.0)
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    if integer_width:
        width = F.when((width > 0) & (width < 1), F.lit(1.0)).otherwise(width)
    stats = _edges(stats.withColumn("_w", width))
    nb = F.when(F.col("_w") > 0, F.ceil((F.col("_hi") - F.col("_lo")) / F.col("_w"))).otherwise(F.lit(1))
    stats = stats.withColumn("_nb", nb.cast("long")).select(*keys, "_lo", "_hi", "_nb")
    return _assign(attach(data, stats, keys), value, keys)
