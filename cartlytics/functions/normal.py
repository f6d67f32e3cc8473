"""Standard normal CDF and quantile as plain arithmetic expressions.

Both are published rational approximations, as Column expressions (no Python):

* CDF: Hart's double-precision algorithm 5666 (as popularised by G. West),
  absolute error about 1e-14;
* quantile: P. J. Acklam's rational approximation, relative error below
  1.15e-9.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (published coefficients) ---------------------------------
# Hart 5666 numerator (highest order first) and denominator, |x| < 7.07106781186547
HART_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
HART_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_SPLIT = 7.07106781186547
SQRT_2PI = 2.506628274631
# Acklam's coefficients
ACK_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
ACK_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01)
ACK_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
ACK_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00)
ACK_LOW = 0.02425
# ----------------------------------------------------------------------------


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_cdf(x) -> Column:
    """Phi(x) as a Column expression."""
    x = F.col(x) if isinstance(x, str) else x
    size = F.abs(x)
    e = F.exp(-(size * size) / 2.0)
    inner = e * _horner(HART_NUM, size) / _horner(HART_DEN, size)
    t = size + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        t = size + k / t
    outer = e / t / SQRT_2PI
    tail = F.when(size > 37.0, 0.0).when(size < HART_SPLIT, inner).otherwise(outer)
    return F.when(x > 0.0, 1.0 - tail).otherwise(tail)


def norm_ppf(p) -> Column:
    """Phi^-1(p) for 0 < p < 1 as a Column expression (NULL outside)."""
    p = F.col(p) if isinstance(p, str) else p
    ok = (p > 0) & (p < 1)
    p = F.when(ok, p).otherwise(0.5)

    def tail(q: Column) -> Column:
        return _horner(ACK_C, q) / (_horner(ACK_D, q) * q + 1.0)

    q = p - 0.5
    r = q * q
    central = _horner(ACK_A, r) * q / (_horner(ACK_B, r) * r + 1.0)
    out = (F.when(p < ACK_LOW, tail(F.sqrt(-2.0 * F.ln(p)))).when(p <= 1.0 - ACK_LOW, central)
           .otherwise(-tail(F.sqrt(-2.0 * F.ln(1.0 - p)))))
    return F.when(ok, out)
