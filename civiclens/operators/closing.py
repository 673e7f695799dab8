"""Time to close: histogram by bin, percentiles, the joined product, overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclens.functions import columns as C
from civiclens.functions.binning import CLOSE_EDGES, CLOSE_LABELS, bin_label, bin_ordinal
from civiclens.functions.predicates import is_closed
from civiclens.functions.ranking import rnd, top_k
from civiclens.functions.timecalc import floor_days


def closed_with_days(df: DataFrame) -> DataFrame:
    """Solved rows with a closed date (``flt_closed``) and valid floor-day
    duration ``time_to_close_days >= 0`` (``prj_days_to_close``)."""
    return (df.filter(is_closed())
              .withColumn("time_to_close_days", floor_days(C.CLOSED, C.CREATED))
              .filter(F.col("time_to_close_days") >= 0))


def close_hist(df: DataFrame, group: str = C.LEVEL1) -> DataFrame:
    d = closed_with_days(df).filter(F.col(group).isNotNull())
    t = F.col("time_to_close_days")
    return (d.groupBy(group, bin_ordinal(t, CLOSE_EDGES).alias("_ord"),
                      bin_label(t, CLOSE_EDGES, CLOSE_LABELS).alias("time_bin"))
             .agg(F.count(F.lit(1)).alias("count"))
             .orderBy(group, "_ord").drop("_ord"))


def close_percentiles(df: DataFrame, group: str = C.LEVEL1) -> DataFrame:
    """count, median, p75, p90, mean (1 dp), min, max; one exact percentile
    aggregate computes all three quantiles."""
    d = closed_with_days(df).filter(F.col(group).isNotNull())
    t = F.col("time_to_close_days")
    s = d.groupBy(group).agg(
        F.count(t).alias("count"),
        F.percentile(t, F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias("_q"),
        F.avg(t).alias("_mean"), F.min(t).alias("min"), F.max(t).alias("max"))
    return (s.select(group, "count",
                     rnd(F.col("_q")[0], 1).alias("median"),
                     rnd(F.col("_q")[1], 1).alias("p75"),
                     rnd(F.col("_q")[2], 1).alias("p90"),
                     rnd("_mean", 1).alias("mean"), "min", "max")
             .orderBy(F.desc("count"), group))


def close_product(df: DataFrame, group: str = C.LEVEL1) -> DataFrame:
    """Histogram with the per-category percentiles (``jn_hist_percentiles``)
    from one scan: rows are counted per (category, day), and bins as well as
    exact percentiles (weighted by the counts) follow from that small frame."""
    t = F.col("time_to_close_days")
    days = (closed_with_days(df).filter(F.col(group).isNotNull())
            .groupBy(group, t).agg(F.count(F.lit(1)).alias("_n")))
    bins = (F.struct(bin_label(t, CLOSE_EDGES, CLOSE_LABELS).alias("time_bin"), F.col("_n")))
    s = days.groupBy(group).agg(
        F.sum("_n").alias("total_count"),
        F.percentile(t, F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)), F.col("_n")).alias("_q"),
        (F.sum(t * F.col("_n")) / F.sum("_n")).alias("_mean"), F.min(t).alias("min"), F.max(t).alias("max"),
        F.collect_list(bins).alias("_bins"))
    s = s.select(group, "total_count", rnd(F.col("_q")[0], 1).alias("median"), rnd(F.col("_q")[1], 1).alias("p75"),
                 rnd(F.col("_q")[2], 1).alias("p90"), rnd("_mean", 1).alias("mean"), "min", "max",
                 F.explode("_bins").alias("_b"))
    keys = [group, "_b.time_bin", "total_count", "median", "p75", "p90", "mean", "min", "max"]
    return (s.groupBy(*keys).agg(F.sum("_b._n").alias("bin_count"))
             .select(group, "time_bin", "bin_count", "total_count", "median", "p75", "p90", "mean", "min", "max"))


def close_overall(df: DataFrame) -> DataFrame:
    t = F.col("time_to_close_days")
    return closed_with_days(df).agg(
        F.count(t).alias("total_closed"),
        rnd(F.median(t), 1).alias("median_days"),
        rnd(F.percentile(t, F.lit(0.9)), 1).alias("p90_days"))


def close_gaps(df: DataFrame, k: int = 5, group: str = C.LEVEL1) -> DataFrame:
    """Categories with the largest p90 - median gap (rounded values)."""
    p = close_percentiles(df, group).withColumn("gap", rnd(F.col("p90") - F.col("median"), 1))
    return top_k(p.select(group, "median", "p90", "gap"), k, [F.desc("gap"), F.asc(group)])
