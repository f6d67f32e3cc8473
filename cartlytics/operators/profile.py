"""Data profiles (PRF1-PRF8, R11).

Every profile is one aggregation pass (+ the ordered-quantile plan when
quantiles are asked for); multi-column profiles unpivot to a long
(column, value) frame so a single job covers all columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlytics.plans.ordered import ordered_summary, quantiles_wide
from cartlytics.sources.schemas import check_schema  # noqa: F401  (PRF2)


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """PRF1: (column, null_count) for each column, one scan."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "null_count")


def _footers(spark: SparkSession, path: str) -> DataFrame:
    """The files as a source that answers count(*) and count(column) from the Parquet footers.  Spark picks that source when the
    frame is made; whether aggregates are pushed to it is a session default of this library."""
    name = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(name)
    spark.conf.set(name, "")
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(name, before)


def _from_footers(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """One row: rows, and the number of values of each column; None where a file lacks the statistics for it."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)])
    try:
        counts.first()  # reads footers only
    except (Py4JError, PySparkException):
        return None
    return counts


def null_profile_of_files(spark: SparkSession, path: str) -> DataFrame:
    """PRF1 of Parquet files: (column, null_count).  A column's nulls are rows less values, both from the footers; only
    floating columns are read, since NaN counts as missing and footers do not know it; so are columns of files without statistics."""
    df = _footers(spark, path)
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    plain = [c for c in df.columns if c not in floating]
    counts = _from_footers(df, plain) if plain else None
    if counts is None:
        plain, floating = [], list(df.columns)
    parts = []
    if plain:
        wide = counts.select(*[(F.col("rows") - F.col(f"n{i}")).alias(c) for i, c in enumerate(plain)])
        parts.append(wide.unpivot([], plain, "column", "null_count"))
    if floating:
        given = spark.read.parquet(path)
        missing = lambda f: F.col(f"`{f.name}`").isNull() | F.isnan(f"`{f.name}`") if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`").isNull()
        wide = given.agg(*[F.count_if(missing(f)).alias(f.name) for f in given.schema.fields if f.name in floating])
        parts.append(wide.unpivot([], floating, "column", "null_count"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def shape_of_files(spark: SparkSession, path: str) -> DataFrame:
    """PRF3 of Parquet files: one row (rows, columns), from the footers."""
    return shape(_footers(spark, path))


def shape(df: DataFrame) -> DataFrame:
    """PRF3: one row (rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]) \
        .unpivot([], list(columns), "column", "value")


def describe(df: DataFrame, columns: Sequence[str], n_buckets: int | None = None) -> DataFrame:
    """PRF4: pandas ``describe()`` per column with *exact* quartiles.

    Rows (column, count, mean, std, min, q25, q50, q75, max).
    """
    long = _long(df, columns)
    return describe_long(long, ["column"], n_buckets)


def describe_long(long: DataFrame, keys: Sequence[str], n_buckets: int | None = None,
                  value: str = "value", extra: Sequence[tuple[float, str]] = ()) -> DataFrame:
    """Describe per key of a long frame: moments and exact quantiles from the same first scan; ``extra``
    adds more quantiles (q, column name).  A key without values has no row."""
    probs = [0.25, 0.5, 0.75] + [q for q, _ in extra]
    s = ordered_summary(long, value, probs, list(keys), n_buckets)
    names = ["q25", "q50", "q75"] + [n for _, n in extra]
    q = [F.col(f"q{i}").alias(n) for i, n in enumerate(names)]
    return s.select(*keys, "count", "mean", "std", "min", *q[:3], "max", *q[3:])


def quantile(df: DataFrame, column: str, q: float, n_buckets: int | None = None) -> DataFrame:
    """PRF5: one row with the exact linear-interpolation quantile."""
    return quantiles_wide(df.select(F.col(column).cast("double").alias(column)), column, [q],
                          ["quantile"], n_buckets=n_buckets)


def value_counts(df: DataFrame, column: str, normalize: bool = False,
                 decimals: int | None = None) -> DataFrame:
    """PRF6/PRF7: (value, count) and optionally the percent of all rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("count"))
    if normalize:
        # total as a scalar subquery: no window without partition keys, so a
        # high-cardinality column never lands in one partition
        total = counts.agg(F.sum("count").alias("t")).select("t").scalar()
        pct = F.col("count") * 100.0 / total
        counts = counts.withColumn("percentage", F.bround(pct, decimals) if decimals is not None else pct)
    return counts


def tail_profile(df: DataFrame, column: str, q: float = 0.95,
                 n_buckets: int | None = None) -> DataFrame:
    """PRF8: (p_q, max, share of rows above p_q, count above): the rows up to the order statistic at
    or below the quantile are those not above it."""
    s = ordered_summary(df, column, [q], n_buckets=n_buckets)
    above = F.col("count") - F.col("upto0")
    return s.select(F.col("q0").alias("p_quantile"), "max", (above / F.col("count")).alias("share_above"), above.alias("n_above"))


def order_totals(order_items: DataFrame, money_decimals: int | None = 6) -> DataFrame:
    """Order value: sum of item prices per order (AGG1, D4), rounded as in ``rfm_base``."""
    total = F.coalesce(F.sum("price"), F.lit(0.0))
    return order_items.groupBy("order_id").agg((F.round(total, money_decimals) if money_decimals is not None else total).alias("price"))


def price_profile(order_items: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Describe + p95 of item price and of order value, one job with one
    ordered-quantile plan for all quantiles."""
    items = order_items.select(F.lit("item_price").alias("column"),
                               F.col("price").cast("double").alias("value"))
    orders = order_totals(order_items).select(F.lit("order_value").alias("column"),
                                              F.col("price").alias("value"))
    return describe_long(items.unionByName(orders), ["column"], n_buckets, extra=[(0.95, "p95")])
