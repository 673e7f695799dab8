"""Left-closed, right-open binning with verbatim labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Backlog age bins (edges in days, labels as published).
AGE_EDGES = (0, 7, 14, 30, 60, 90, 180, 365, 730, math.inf)
AGE_LABELS = ("0-7 days", "8-14 days", "15-30 days", "31-60 days", "61-90 days",
              "91-180 days", "181-365 days", "1-2 years", "2+ years")

# Time-to-close bins.
CLOSE_EDGES = (0, 1, 3, 8, 31, 91, math.inf)
CLOSE_LABELS = ("0 days", "1-2 days", "3-7 days", "8-30 days", "31-90 days", "90+ days")


def _ladder(value: Column, edges: Sequence[float], outs: Sequence) -> Column:
    expr = None
    for lo, hi, out in zip(edges[:-1], edges[1:], outs):
        cond = value >= F.lit(lo)
        if not math.isinf(hi):
            cond = cond & (value < F.lit(hi))
        expr = F.when(cond, F.lit(out)) if expr is None else expr.when(cond, F.lit(out))
    return expr


def bin_label(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin [edge_i, edge_i+1) holding ``value``; null outside."""
    return _ladder(value, edges, labels)


def bin_ordinal(value: Column, edges: Sequence[float]) -> Column:
    """0-based index of the bin, used only to sort bins in label order."""
    return _ladder(value, edges, list(range(len(edges) - 1)))


def label_ordinal(label: Column, labels: Sequence[str]) -> Column:
    """Ordinal of an already computed label."""
    return F.array_position(F.array(*[F.lit(x) for x in labels]), label) - 1
