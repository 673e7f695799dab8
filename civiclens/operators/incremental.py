"""Products out of monthly cells instead of requests.

``cells`` counts the requests of each combination of month, category, district,
first-call flag, open or not, and whole days to close (null unless closed and
valid).  Their number is bounded by those columns' values, not by the requests,
and the cells of months add up, so a refreshed product reads the requests of
new months only.  Counts by day give the same exact percentiles as the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclens.functions import columns as C
from civiclens.functions.binning import CLOSE_EDGES, CLOSE_LABELS, bin_label, bin_ordinal
from civiclens.functions.predicates import is_closed, is_open
from civiclens.functions.ranking import rnd, top_k
from civiclens.functions.timecalc import floor_days
from civiclens.sources.monthly import MONTH

DAYS = "days"


def cells(requests: DataFrame) -> DataFrame:
    """The counts, in one pass with map-side partial aggregation."""
    days = floor_days(C.CLOSED, C.CREATED)
    return requests.groupBy(
        MONTH, C.LEVEL1, C.DISTRICT, C.FCR, F.col(C.CREATED).isNotNull().alias("dated"), is_open().alias("open"),
        F.when(is_closed() & (days >= 0), days).alias(DAYS)).agg(F.count(F.lit(1)).alias("n"))


def _quantiles(*at: float) -> Column:
    """Exact interpolated percentiles of the days, weighted by the counts."""
    return F.percentile(DAYS, F.array(*[F.lit(q) for q in at]), F.col("n"))


def _closed(state: DataFrame, group: str) -> DataFrame:
    return (state.filter(F.col(DAYS).isNotNull() & F.col(group).isNotNull())
            .groupBy(group, DAYS).agg(F.sum("n").alias("n")))


def close_percentiles(state: DataFrame, group: str = C.LEVEL1) -> DataFrame:
    s = _closed(state, group).groupBy(group).agg(
        F.sum("n").alias("count"), _quantiles(0.5, 0.75, 0.9).alias("_q"),
        (F.sum(F.col(DAYS) * F.col("n")) / F.sum("n")).alias("_mean"), F.min(DAYS).alias("min"), F.max(DAYS).alias("max"))
    return s.select(group, "count", *[rnd(F.col("_q")[i], 1).alias(n) for i, n in enumerate(("median", "p75", "p90"))],
                    rnd("_mean", 1).alias("mean"), "min", "max").orderBy(F.desc("count"), group)


def close_hist(state: DataFrame, group: str = C.LEVEL1) -> DataFrame:
    d = F.col(DAYS)
    return (_closed(state, group).groupBy(group, bin_ordinal(d, CLOSE_EDGES).alias("_ord"),
                                          bin_label(d, CLOSE_EDGES, CLOSE_LABELS).alias("time_bin"))
            .agg(F.sum("n").alias("count")).orderBy(group, "_ord").drop("_ord"))


def close_overall(state: DataFrame) -> DataFrame:
    days = state.filter(F.col(DAYS).isNotNull()).groupBy(DAYS).agg(F.sum("n").alias("n"))
    return (days.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_closed"), _quantiles(0.5, 0.9).alias("_q"))
            .select("total_closed", rnd(F.col("_q")[0], 1).alias("median_days"), rnd(F.col("_q")[1], 1).alias("p90_days")))


def worst_p90(state: DataFrame, min_requests: int = 10, group: str = C.LEVEL1) -> DataFrame:
    """Ten categories with the greatest p90 (rounded, as they are ranked)."""
    s = close_percentiles(state, group).filter(F.col("count") >= min_requests)
    return top_k(s.select(group, "p90", "median", "count"), 10, [F.desc("p90"), F.asc(group)])


def frequency_long(state: DataFrame, group: str = C.LEVEL1) -> DataFrame:
    return (state.filter(F.col("dated") & F.col(group).isNotNull()).groupBy(F.col(MONTH).alias("Time"), group)
            .agg(F.sum("n").alias("frequency")))


def fcr_rate(state: DataFrame, group: str = C.LEVEL1) -> DataFrame:
    flag = F.col(C.FCR)
    counts = state.filter(F.col(group).isNotNull() & flag.isNotNull()).groupBy(F.col(group).alias("category")).agg(
        *[F.coalesce(F.sum(F.when(flag == v, F.col("n"))), F.lit(0)).alias(f"fcr_{v.lower()}") for v in ("Yes", "No")])
    total = F.col("fcr_yes") + F.col("fcr_no")
    return (counts.select("*", total.alias("total_requests"),
                          rnd(F.try_divide(F.col("fcr_yes"), total) * 100.0, 2).alias("fcr_rate"))
            .orderBy("fcr_rate", "category"))


def geo_metrics(state: DataFrame, area: str = C.DISTRICT, digits: int = 6) -> DataFrame:
    per_day = state.filter(F.col(area).isNotNull()).groupBy(F.col(area).alias("electoral_district"), DAYS, "open").agg(
        F.sum("n").alias("n"))
    return (per_day.groupBy("electoral_district")
            .agg(F.sum("n").alias("volume"), F.coalesce(F.sum(F.when(F.col("open"), F.col("n"))), F.lit(0)).alias("unresolved"),
                 rnd(F.percentile(DAYS, F.lit(0.9), F.col("n")), digits).alias("slow_p90"))
            .orderBy(F.desc("volume"), "electoral_district"))
