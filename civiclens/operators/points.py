"""Dashboard reads: capped point sets, plot domains, paging, facets, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def capped_points(points: DataFrame, allowed: DataFrame, cap: int = 12000, id_col: str = "request_id",
                  need_z: bool = False, only_cluster: int | None = None) -> DataFrame:
    """Points of the allowed top clusters ordered by id, at most ``cap`` (the
    cap is the feature: a plot shows that many points)."""
    p = points.join(allowed.select("top_cluster_id").distinct(), "top_cluster_id", "left_semi")
    if need_z:
        p = p.filter(F.col("z_2d").isNotNull())
    if only_cluster is not None:
        p = p.filter(F.col("top_cluster_id") == only_cluster)
    return p.orderBy(id_col).limit(cap)


def plot_domain(points: DataFrame, pad: float = 0.08) -> DataFrame:
    """min/max of x and y padded by 8 % of the range (range 0 -> 1)."""
    def axis(c):
        lo, hi = F.min(c), F.max(c)
        rng = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
        return [(lo - rng * pad).alias(f"{c}_min"), (hi + rng * pad).alias(f"{c}_max")]
    return points.agg(*axis("x_2d"), *axis("y_2d"))


def page(df: DataFrame, order: Sequence, page_no: int = 0, size: int = 10,
         filters: dict | None = None) -> DataFrame:
    """Column filters (substring, case-insensitive), sort, one page."""
    out = df
    for k, v in (filters or {}).items():
        out = out.filter(F.lower(F.col(k).cast("string")).contains(str(v).lower()))
    return out.orderBy(*order).offset(page_no * size).limit(size)


def facets(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values with counts per column (one pass: unpivot + count)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def minmax_scale(df: DataFrame, col: str, out: str = "scaled") -> DataFrame:
    """(v - min) / (max - min) over the whole (aggregated, small) frame; a
    constant column scales to 0."""
    w = Window.partitionBy()
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return df.withColumn(out, F.coalesce(F.try_divide(F.col(col) - lo, hi - lo), F.lit(0.0)))
