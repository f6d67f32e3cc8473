"""Ordered prefix counts and exact quantiles without a sort of all rows.

Every value has an order-preserving 64-bit form (``order_bits``: sign, exponent, 52 bits of mantissa).  A cell is a prefix of it:
all values that agree in the leading bits.  At first there are ``per_octave`` cells between any two powers of two.  A
cell is a pure function of the value: no sample and no sketch is needed, and a recomputed task puts every value
in the same cell.

Values far from zero and close together share a cell (a year of microseconds since 1970 has some 115 cells of the first level).  A
cell with more than ``crowd`` rows is cut again by its next 12 bits, and so on: a hierarchical radix count.  Only rows of crowded
cells that are wanted are read for it, and at the last bit a cell is one value, so no task orders more than ``crowd`` values.

Quantiles, moments and extremes (``ordered_summary``):

1. rows per (key, cell) with their count, moments and extremes, a partial+final aggregate, so a task sends
   one small row a cell; windows over these rows give each cell's offset, the key's totals
   and the cells that hold a wanted order statistic; this small table is written;
2. while a wanted cell is crowded, a scan that counts its sub-cells;
3. a scan that keeps only the rows of the wanted cells, collapses ties, and counts within the cell.  A cell of one value needs no scan.

No detail row is shuffled before its cell is known to be wanted.

``ranked_values`` needs the rank of every value: ties are collapsed and written first, crowded cells are cut as above, then
running counts are windows per (key, cell) plus the offset of the cell.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlytics.session import materialise

PER_OCTAVE = 4096
CROWD = 1_000_000
STEP = 12  # bits by which a crowded cell is cut
BROADCAST_ROWS = 100_000
_MANTISSA = 52


def _first_shift(n: int | None) -> int:
    n = n or PER_OCTAVE
    if n < 2 or n & (n - 1) or n > 1 << 20:
        raise ValueError("n_buckets, the cells per octave, must be a power of two in [2, 2**20]")
    return _MANTISSA - (n.bit_length() - 1)


def order_bits(value: Column, keep: Callable[[str, Column], Column] = lambda part, c: c) -> Column:
    """A double as a long in the same order, equal values only being equal: the bits of its size (exponent, then mantissa) with
    its sign.  NaN comes after infinity.  ``keep`` gets the parts that are used more than once."""
    size = keep("_size", F.abs(value))
    exponent = keep("_exponent", F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022)))
    ratio = keep("_ratio", size / F.pow(F.lit(2.0), exponent.cast("double")))
    # log2 may round across a power of two
    exponent = exponent + F.when(ratio >= 2, 1).when(ratio < 1, -1).otherwise(0)
    ratio = F.when(ratio >= 2, ratio / 2).when(ratio < 1, ratio * 2).otherwise(ratio)
    normal = F.shiftleft((exponent + 1023).cast("long"), _MANTISSA) + ((ratio - 1) * float(1 << _MANTISSA)).cast("long")
    subnormal = (size * 2.0 ** 537 * 2.0 ** 537).cast("long")
    top = F.lit(2047 << _MANTISSA).cast("long")
    bits = keep("_bits", F.when(F.isnan(size), top + 1).when(size == float("inf"), top).when(size < 2.0 ** -1022, subnormal).otherwise(normal))
    return F.when(value < 0, -bits).otherwise(bits)


def with_order_bits(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add ``order_bits`` of values that are not NULL.  Each part is a column of its own projection: in one expression the logarithm
    would be taken again wherever a part is used.  The result is never NULL, else a join on it would test the expression for NULL
    below the projections, where it is one expression again."""
    columns = df.columns

    def keep(part: str, c: Column) -> Column:
        nonlocal df
        df = df.withColumn(part, c)
        return F.col(part)

    bits = order_bits(value, keep)
    return df.select(*columns, F.coalesce(bits, F.lit(0).cast("long")).alias(name))


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of ``small`` (one row per key) to ``df``.

    With keys: ``small`` is written and counted, and broadcast only if it has few rows.  Without
    keys ``small`` has one row and its columns become scalar subqueries.
    """
    if keys:
        return df.join(_light(materialise(small)), list(keys))
    return df.withColumns({c: small.select(c).scalar() for c in small.columns})


def _light(written: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is counted to be small."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


@dataclass
class Ranked:
    rows: DataFrame      # keys..., value, n, extra counts..., _cell, before
    keys: list[str]


def _cell_start(shift: Column | int) -> Column:
    return F.expr(f"shiftleft(shiftright(_b, {shift}), {shift})")


def ranked_values(df: DataFrame, value: str, keys: Sequence[str] = (),
                  counts: Mapping[str, Column] | None = None, n_buckets: int | None = None, crowd: int = CROWD) -> Ranked:
    """Distinct values per key with ``n`` (rows) and ``before`` (rows of the key with a smaller value).

    ``counts`` adds conditional counts per distinct value, e.g. ``{"n0": F.col("group") == 0}``.  NULL
    values are dropped.  ``n_buckets``: cells per octave; ``crowd``: distinct values that a cell may have.
    """
    keys = list(keys)
    shift = _first_shift(n_buckets)
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, cond in (counts or {}).items():
        aggs.append(F.count(F.when(cond, F.lit(1))).alias(name))
    d = with_order_bits(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*aggs), F.col(value).cast("double"), "_b")
    d = materialise(d).withColumn("_cell", _cell_start(shift)).withColumn("_shift", F.lit(shift))
    while shift > 0:
        # only the cells of the last level can still be too full
        full = materialise(d.where(F.col("_shift") == shift).groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > crowd))
        if full.isEmpty():
            break
        finer = max(0, shift - STEP)
        d = (d.join(_light(full), [*keys, "_cell"], "left")
             .withColumn("_cell", F.when(F.col("_k").isNotNull(), _cell_start(finer)).otherwise(F.col("_cell")))
             .withColumn("_shift", F.when(F.col("_k").isNotNull(), F.lit(finer)).otherwise(F.col("_shift"))).drop("_k"))
        shift = finer
    d = d.drop("_b", "_shift")
    offsets = d.groupBy(*keys, "_cell").agg(F.sum("n").alias("_cn"))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(*keys, "_cell", F.coalesce(F.sum("_cn").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = (d.join(offsets, [*keys, "_cell"])
            .withColumn("before", F.col("_offset") + F.coalesce(F.sum("n").over(within), F.lit(0))).drop("_offset"))
    return Ranked(rows=rows, keys=keys)


_MOMENTS = ["count", "mean", "_ss", "min", "max"]


def _still_wanted() -> Column:
    """The targets of a cell that lie in it."""
    return F.filter("_targets", lambda t: (t["idx"] >= F.col("_before")) & (t["idx"] < F.col("_before") + F.col("_n")))


def _wanted_cells(data: DataFrame, probs: Sequence[float], keys: list[str], shift: int) -> DataFrame:
    """keys..., _cell, _before, _n, _lo, _hi, moments of the key, _targets of the first level's cells that hold an order statistic."""
    cells = data.groupBy(*keys, F.shiftright("_b", shift).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_avg"), (F.var_pop("_v") * F.count(F.lit(1))).alias("_m2"),
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    n, avg = F.col("_n"), F.col("_avg")
    cells = (cells.withColumn("count", F.sum(n).over(whole)).withColumn("mean", F.sum(n * avg).over(whole) / F.col("count"))
             .withColumn("_ss", F.sum(F.col("_m2") + n * (avg - F.col("mean")) * (avg - F.col("mean"))).over(whole))
             .withColumn("min", F.min("_lo").over(whole)).withColumn("max", F.max("_hi").over(whole))
             .withColumn("_before", F.coalesce(F.sum(n).over(earlier), F.lit(0))))

    def target(i: int, p: float, kind: str) -> Column:
        at = (F.col("count") - 1) * float(p)
        return F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), (F.floor(at) if kind == "lo" else F.ceil(at)).cast("long").alias("idx"),
                        (at - F.floor(at)).alias("frac"))

    cells = cells.withColumn("_targets", F.array(*[target(i, p, k) for i, p in enumerate(probs) for k in ("lo", "hi")])).withColumn("_targets", _still_wanted())
    return cells.where(F.size("_targets") > 0).select(*keys, "_cell", "_before", "_n", "_lo", "_hi", *_MOMENTS, "_targets")


def _in_cells(data: DataFrame, cells: DataFrame, keys: list[str], shift: int) -> DataFrame:
    return data.withColumn("_cell", F.shiftright("_b", shift)).join(_light(cells), [*keys, "_cell"])


def _cut(data: DataFrame, cells: DataFrame, keys: list[str], shift: int, finer: int) -> DataFrame:
    """The wanted sub-cells of crowded cells: at most 2**STEP a cell are counted."""
    about = ["_before", *_MOMENTS, "_targets"]
    counted = (_in_cells(data, cells.select(*keys, "_cell", *about), keys, shift).groupBy(*keys, "_cell", F.shiftright("_b", finer).alias("_sub"))
               .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *[F.first(c).alias(c) for c in about]))
    below = Window.partitionBy(*keys, "_cell").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(below), F.lit(0))).withColumn("_targets", _still_wanted())
    return counted.where(F.size("_targets") > 0).select(*keys, F.col("_sub").alias("_cell"), "_before", "_n", "_lo", "_hi", *_MOMENTS, "_targets")


def wanted_cells(data: DataFrame, probs: Sequence[float], keys: list[str], n_buckets: int | None, crowd: int) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """(cells of one value, [(shift, cells of at most ``crowd`` rows)]) that hold the wanted order statistics.

    ``data``: keys..., _v, _b."""
    shift = _first_shift(n_buckets)
    single, to_read = None, []
    cells = materialise(_wanted_cells(data, probs, keys, shift))
    while True:
        alone, crowded = F.col("_lo") == F.col("_hi"), F.col("_n") > crowd
        some = cells.agg(F.count_if(~alone & ~crowded).alias("few"), F.count_if(~alone & crowded).alias("many")).first()
        here = cells.where(alone)
        single = here if single is None else single.unionByName(here)
        if some["few"]:
            to_read.append((shift, cells.where(~alone & ~crowded)))
        if not some["many"] or not shift:
            return single, to_read
        finer = max(0, shift - STEP)
        cells = materialise(_cut(data, cells.where(~alone & crowded), keys, shift, finer))
        shift = finer


def ordered_summary(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (),
                    n_buckets: int | None = None, crowd: int = CROWD) -> DataFrame:
    """keys..., count, mean, std, min, max, and per probability i: q{i} (linear interpolation between the
    order statistics around (n - 1) q, exact) and upto{i} (rows at most as large as the lower one).
    ``crowd``: rows of a cell that one task may order."""
    keys = list(keys)
    data = with_order_bits(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), F.col("_v"), "_b")
    single, to_read = wanted_cells(data, probs, keys, n_buckets, crowd)
    hits = single.select(*keys, *_MOMENTS, F.col("_lo").alias("_v"), (F.col("_before") + F.col("_n")).alias("_upto"), F.explode("_targets").alias("_t"))
    about = ["_before", *_MOMENTS, "_targets"]
    for shift, cells in to_read:
        seen = _in_cells(data, cells.select(*keys, "_cell", *about), keys, shift)
        ties = seen.groupBy(*keys, "_cell", "_v").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in about])
        below = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        ranked = ties.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(below), F.lit(0)))
        hits = hits.unionByName(ranked.select(*keys, *_MOMENTS, "_v", (F.col("_before") + F.col("_n")).alias("_upto"), F.explode(_still_wanted()).alias("_t")))
    picked = []
    for i in range(len(probs)):
        here = F.col("_t.i") == i
        low, high = (F.max(F.when(here & (F.col("_t.kind") == k), F.col("_v"))) for k in ("lo", "hi"))
        frac = F.max(F.when(here, F.col("_t.frac")))
        picked += [F.when(frac == 0, low).otherwise(low + (high - low) * frac).alias(f"q{i}"),
                   F.max(F.when(here & (F.col("_t.kind") == "lo"), F.col("_upto"))).alias(f"upto{i}")]
    out = hits.groupBy(*keys).agg(*[F.first(c).alias(c) for c in _MOMENTS], *picked)
    std = F.when(F.col("count") > 1, F.sqrt(F.try_divide(F.col("_ss"), F.col("count") - 1)))
    return out.select(*keys, "count", "mean", std.alias("std"), "min", "max", *[c for i in range(len(probs)) for c in (f"q{i}", f"upto{i}")])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    keys: Sequence[str] = (), n_buckets: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles (pandas / numpy / DuckDB quantile_cont), exact: long rows
    (keys..., q, quantile)."""
    wide = ordered_summary(df, value, probs, keys, n_buckets).where(F.col("count") > 0)
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("q"), F.col(f"q{i}").alias("quantile")) for i, p in enumerate(probs)])
    return wide.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.q", "_p.quantile")


def approx_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                     keys: Sequence[str] = (), accuracy: int = 10000) -> DataFrame:
    """Opt-in approximate quantiles (D6): ``percentile_approx`` sketches, one
    aggregation; rank error at most n / accuracy.  Same long layout as
    :func:`exact_quantiles`."""
    keys = list(keys)
    qs = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), [float(p) for p in probs], accuracy).alias("_q"))
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("q"), F.col("_q").alias("quantile"))
    return qs.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.q", "_p.quantile")


def quantiles_wide(df: DataFrame, value: str, probs: Sequence[float],
                   names: Sequence[str], keys: Sequence[str] = (),
                   n_buckets: int | None = None, approx: bool = False) -> DataFrame:
    """Same as :func:`exact_quantiles` (or :func:`approx_quantiles` with ``approx``), one row per key
    and one column per q."""
    if not approx:
        wide = ordered_summary(df, value, probs, keys, n_buckets)
        return wide.select(*keys, *[F.col(f"q{i}").alias(nm) for i, nm in enumerate(names)])
    aggs = [F.max(F.when(F.col("q") == float(p), F.col("quantile"))).alias(nm) for p, nm in zip(probs, names)]
    return approx_quantiles(df, value, probs, keys).groupBy(*keys).agg(*aggs)
