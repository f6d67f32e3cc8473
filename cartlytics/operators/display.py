"""Ordering, previews and concatenation for result tables (SRT1, SRT2, LIM1, SET1).

Spark results have no inherent order; these helpers give the deterministic
orders the reference shows (ties broken explicitly, D9/D10).  A global sort is
a range-partitioned shuffle (sampled bounds, no single partition); ``preview``
is a top-k (``TakeOrderedAndProject``): each task keeps its n best rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Order = Sequence[tuple[str, bool]]  # (column, ascending)


def _sort_cols(by: Order, tiebreak: Sequence[str] = ()) -> list[Column]:
    cols = [F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last() for c, asc in by]
    named = {c for c, _ in by}
    cols += [F.col(c).asc_nulls_last() for c in tiebreak if c not in named]
    return cols


def sorted_view(df: DataFrame, by: Order, tiebreak: Sequence[str] = ()) -> DataFrame:
    """SRT1/SRT2: multi-key sort; ``tiebreak`` columns make the order total."""
    return df.orderBy(*_sort_cols(by, tiebreak))


def preview(df: DataFrame, n: int = 5, by: Order = (), tiebreak: Sequence[str] = ()) -> DataFrame:
    """LIM1: first ``n`` rows under an explicit order (a top-k, not a full sort)."""
    return df.orderBy(*_sort_cols(by, tiebreak)).limit(n) if by or tiebreak else df.limit(n)


def union_all(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """SET1: UNION ALL by column name (pandas ``concat``)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out
