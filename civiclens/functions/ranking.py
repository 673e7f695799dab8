"""Top-k, shares and rounding shared by the ranking operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """``order`` must be a total order (metric desc, then key asc).

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each partition
    keeps k rows, one small merge; no global sort of the input.
    """
    return df.orderBy(*order).limit(k)


def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based rank over an already small (aggregated / top-k) frame."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def share_pct(count_col: str, digits: int = 2, partition: Sequence[str] = ()) -> Column:
    """count / sum(count) * 100, rounded half-even.

    Used on aggregated frames only (one row per group), where the total is a
    window over a few thousand rows at most.
    """
    w = Window.partitionBy(*partition) if partition else Window.partitionBy()
    return F.bround(F.col(count_col) / F.sum(count_col).over(w) * F.lit(100.0), digits)


def rnd(col, digits: int) -> Column:
    """pandas ``round`` = half-even (``bround``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.bround(c.cast("double"), digits)
