"""Column-expression building blocks (FN1-FN18, FLT1-FLT5).

All of these are plain Catalyst expressions: they run inside whole-stage
codegen and push down where the optimizer can.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "REFERENCE_EXCLUDED_STATUSES", "REFERENCE_UNDELIVERED_STATUSES", "RFM_SEGMENT_RULES",
    "col_of", "not_in_null_safe", "month_start", "weekday_name", "weeks_in_month",
    "month_label", "parse_id_set", "cut_equal_width", "quantile_score", "relabel",
    "half_even", "days_since", "within_days", "date_lit",
]

# ---- fixed values that must equal the reference's -------------------------
# Order statuses that are not a purchase (the "paid" filter).
REFERENCE_EXCLUDED_STATUSES = ("canceled", "unavailable", "approved", "invoiced")
# Reasons an order was not delivered.
REFERENCE_UNDELIVERED_STATUSES = ("canceled", "unavailable")
# RFM code (recency digit, frequency digit, monetary digit) to segment name,
# tried in this order; the first pattern that matches wins, other codes stay.
RFM_SEGMENT_RULES = (
    ("[4-5][4-5][3-5]", "the_best"),
    ("[4-5][1-3][3-5]", "valuable"),
    ("[4-5][1-3][1-2]", "almost_new_common"),
    ("[1-3][1-3][3-5]", "regular_common"),
    ("[1-3][1-3][1-2]", "elder_common"),
)
# ---------------------------------------------------------------------------


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_lit(d) -> Column:
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def not_in_null_safe(c, values: Iterable[str]) -> Column:
    """FLT1 with pandas `!=` semantics (D1): a NULL status is *kept*.

    Written as a conjunction of NOT(col <=> v) so it pushes to parquet.
    """
    c = col_of(c)
    cond = F.lit(True)
    for v in values:
        cond = cond & ~c.eqNullSafe(F.lit(v))
    return cond


def month_start(ts) -> Column:
    """FN1: calendar month of a timestamp as the DATE of its first day."""
    return F.trunc(F.to_date(col_of(ts)), "month")


def month_label(ts) -> Column:
    """FN3: 'yyyy-MM' text, for display only."""
    return F.date_format(col_of(ts), "yyyy-MM")


def weekday_name(ts) -> Column:
    """FN2: English weekday name ('Monday' ... 'Sunday')."""
    return F.date_format(col_of(ts), "EEEE")


def weeks_in_month(month) -> Column:
    """FN4: days of the month / 7."""
    return F.dayofmonth(F.last_day(col_of(month))) / F.lit(7.0)


def days_since(as_of, d) -> Column:
    """FN6: whole days from date ``d`` to the as-of date."""
    return F.datediff(date_lit(as_of), F.to_date(col_of(d)))


def within_days(d, as_of, days: int) -> Column:
    """FLT5: d >= as_of - days."""
    return F.to_date(col_of(d)) >= F.date_sub(date_lit(as_of), int(days))


def parse_id_set(text) -> Column:
    """FN8-FN9 (+ cast of FN10): '{1, 22, 3}' -> [1, 22, 3]; '{}' -> [NULL]."""
    parts = F.split(F.regexp_replace(col_of(text), "[{}]", ""), ", ")
    return F.transform(parts, lambda x: x.try_cast("bigint"))


def cut_equal_width(x, lo, hi, bins: int = 5) -> Column:
    """FN16: pandas ``cut(x, bins=n)`` labels 1..n.

    Right-closed equal-width bins on [lo, hi]; inner edge i is
    ``lo + i * ((hi - lo) / n)``; a constant column lands in the middle bin.
    ``lo``/``hi`` are columns (typically scalar subqueries).
    """
    x, lo, hi = col_of(x), col_of(lo), col_of(hi)
    step = (hi - lo) / F.lit(float(bins))
    expr = F.when(x.isNull(), F.lit(None).cast("int"))
    expr = expr.when(lo == hi, F.lit((bins + 1) // 2))
    for i in range(1, bins):
        expr = expr.when(x <= lo + F.lit(float(i)) * step, F.lit(i))
    return expr.otherwise(F.lit(bins))


def quantile_score(x, edges: Sequence[Column], ascending: bool) -> Column:
    """FN17: score by quantile edges q1 <= q2 <= ... (``x <= q_i`` tests).

    ascending=True: 1 for the lowest bucket (monetary); False: highest score for
    the lowest bucket (recency: fewer days is better).
    """
    x = col_of(x)
    n = len(edges) + 1
    expr = F.when(x.isNull(), F.lit(None).cast("int"))
    for i, e in enumerate(edges, start=1):
        expr = expr.when(x <= col_of(e), F.lit(i if ascending else n + 1 - i))
    return expr.otherwise(F.lit(n if ascending else 1))


def relabel(code, rules: Sequence[tuple[str, str]]) -> Column:
    """FN12: first regex that matches (search semantics) gives the label;
    unmatched codes stay unchanged (D12)."""
    code = col_of(code)
    expr = None
    for pattern, label in rules:
        cond = code.rlike(pattern)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return code if expr is None else expr.otherwise(code)


def half_even(c, scale: int) -> Column:
    """FN14: round half to even (pandas/numpy rounding, D7).

    The value is first rounded at 10 decimals so that last-bit noise of a
    floating sum cannot move an exact tie (x.xx5) to one side.
    """
    c = col_of(c)
    return F.bround(F.round(c, 10) if scale < 10 else c, scale)
