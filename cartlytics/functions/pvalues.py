"""Tail probabilities of the test statistics as Column expressions.

Normal, chi-square, t and F tails are all one integral.  With k degrees of freedom above, c the
reciprocal of the degrees of freedom below (0 for none: normal and chi-square) and v = k * F,

    p = I(sqrt(v)) / I(0),   I(s0) = integral from s0 to infinity of
        s^(k - 1) * exp(-(1 + k c) / 2 * log(1 + c s^2) / c) ds.

t and z are k = 1 with v their square.  Normalising by I(0) needs no gamma function, so nothing
cancels however large the degrees of freedom are.  Both integrals are sums over the nodes of
the exp-sinh rule, s = s0 + exp(pi / 2 * sinh(tau)).  The same sums over every other node
bound the error: where the two disagree the result is NULL, never a wrong number (this happens
for some hundreds of degrees of freedom above).  All of it runs on the JVM, on result rows only.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nodes on either side of 0, and their distance in tau.
NODES, STEP = 256, 1.0 / 64
TOLERANCE = 1e-9

_STD = NormalDist()


def normal_ppf(p: float) -> float:
    if p <= 0.0:
        return float("-inf")
    if p >= 1.0:
        return float("inf")
    return _STD.inv_cdf(p)


def _column(x) -> Column:
    if x is None:
        return F.lit(None).cast("double")
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def upper_tail(v, k, c) -> Column:
    """P(V > v) in the notation of the module's docstring; NULL for undefined arguments."""
    v, k, c = _column(v), _column(k), _column(c)
    zero = F.lit(0.0)

    def log_density(s: Column) -> Column:
        u = c * s * s
        # log(1 + u) / c without dividing by a c of 0
        exponent = F.when(u < 1e-6, s * s * (1.0 - u / 2.0 + u * u / 3.0)).otherwise(F.try_divide(F.log1p(u), c))
        return (k - 1.0) * F.ln(s) - 0.5 * (1.0 + k * c) * exponent

    mode = F.sqrt((k - 1.0) / (1.0 + c))
    peak = F.when(k > 1.0, log_density(F.greatest(mode, F.lit(1e-9)))).otherwise(zero)
    start, scale = F.sqrt(F.greatest(v, zero)), F.sqrt(F.greatest(k, F.lit(1.0)))
    sums = F.struct(*[zero.alias(n) for n in ("tail", "all", "tail2", "all2")])

    def add(acc: Column, j: Column) -> Column:
        tau = j * STEP
        x = scale * F.exp(math.pi / 2 * F.sinh(tau))  # nodes are densest where the mass is
        weight = F.cosh(tau) * x
        tail = weight * F.exp(log_density(start + x) - peak)
        every = weight * F.exp(log_density(x) - peak)
        even = j % 2 == 0
        return F.struct((acc["tail"] + tail).alias("tail"), (acc["all"] + every).alias("all"),
                        (acc["tail2"] + F.when(even, tail).otherwise(zero)).alias("tail2"),
                        (acc["all2"] + F.when(even, every).otherwise(zero)).alias("all2"))

    def settled(acc: Column) -> Column:
        fine, coarse = F.try_divide(acc["tail"], acc["all"]), F.try_divide(acc["tail2"], acc["all2"])
        return F.when(F.abs(fine - coarse) <= TOLERANCE, F.least(fine, F.lit(1.0)))

    p = F.aggregate(F.sequence(F.lit(-NODES), F.lit(NODES)), sums, add, settled)
    fine = v.isNotNull() & ~F.isnan(v) & (k > 0) & (c >= 0) & ~F.isnan(c)
    return F.when(fine & (v <= 0), F.lit(1.0)).when(fine & (v == float("inf")), zero).when(fine, p)


def tail_arguments(kind: str, stat, df1=None, df2=None) -> tuple[Column, Column, Column]:
    """(v, k, c) of a statistic.  kind: 't' and 'z' (two-sided), 'f', 'chi2' (upper), 'k2' (D'Agostino
    K^2, chi-square with 2 degrees of freedom)."""
    x, one, none = _column(stat), F.lit(1.0), F.lit(0.0)
    if kind == "t":
        return x * x, one, F.try_divide(one, _column(df1))
    if kind == "z":
        return x * x, one, none
    if kind == "f":
        return x * _column(df1), _column(df1), F.try_divide(one, _column(df2))
    if kind == "chi2":
        return x, _column(df1), none
    if kind == "k2":
        return x, F.lit(2.0), none
    raise ValueError(f"unknown kind {kind!r}")


def p_value_col(kind: str, stat, df1=None, df2=None) -> Column:
    return upper_tail(*tail_arguments(kind, stat, df1, df2))
