"""Backlog age: histogram, per-category summaries, ranked lists, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiclens.functions import columns as C
from civiclens.functions.binning import AGE_EDGES, AGE_LABELS, bin_label, bin_ordinal
from civiclens.functions.predicates import is_open_or_unclosed, is_unresolved_strict
from civiclens.functions.ranking import rnd
from civiclens.functions.timecalc import floor_days, resolve_as_of


def unresolved_with_age(df: DataFrame, as_of=None) -> DataFrame:
    """Open-or-unclosed rows (T2c) with ``age_days = floor(as_of - created)``."""
    now = resolve_as_of(df, as_of)
    return (df.filter(is_open_or_unclosed())
              .withColumn("age_days", floor_days(now, C.CREATED)))


def backlog_hist(df: DataFrame, as_of=None, group: str = C.LEVEL1) -> DataFrame:
    """Age bin x category counts; only observed cells; rows outside every bin
    (negative or null age) and null categories are dropped (T3, T9)."""
    aged = unresolved_with_age(df, as_of).filter(F.col(group).isNotNull())
    binned = aged.select(group, bin_label(F.col("age_days"), AGE_EDGES, AGE_LABELS).alias("age_bin"),
                         bin_ordinal(F.col("age_days"), AGE_EDGES).alias("_ord"))
    return (binned.filter(F.col("age_bin").isNotNull())
                  .groupBy("_ord", "age_bin", group).agg(F.count(F.lit(1)).alias("count"))
                  .orderBy("_ord", F.desc("count"), group)
                  .select("age_bin", group, "count"))


def backlog_level1(df: DataFrame, as_of=None, group: str = C.LEVEL1,
                   over_days: int = 90) -> DataFrame:
    """Per category: count/mean/median/max of age, share over 90 days.
    Negative ages stay in (as in the reference)."""
    aged = unresolved_with_age(df, as_of).filter(F.col(group).isNotNull())
    a = F.col("age_days")
    s = aged.groupBy(group).agg(
        F.count(a).alias("total_unresolved"),
        F.avg(a).alias("_avg"),
        F.median(a).alias("_med"),
        F.max(a).alias("max_age_days"),
        F.count_if(a > over_days).alias("over_90_days"))
    return (s.select(group, "total_unresolved",
                     rnd("_avg", 1).alias("avg_age_days"),
                     rnd("_med", 1).alias("median_age_days"),
                     "max_age_days", "over_90_days",
                     rnd(F.try_divide(F.col("over_90_days"), F.col("total_unresolved")) * 100.0, 2)
                     .alias("pct_over_90_days"))
              .orderBy(F.desc("total_unresolved"), group))


def strict_with_age(df: DataFrame, as_of=None) -> DataFrame:
    """Rows with status exactly 'Unresolved' (T2a) and their floor-day age."""
    now = resolve_as_of(df, as_of)
    return df.filter(is_unresolved_strict()).withColumn("age_days", floor_days(now, C.CREATED))


def backlog_ranked(df: DataFrame, as_of=None, digits: int = 6) -> DataFrame:
    """(level 1, level 2) counts and mean age, ordered by the level-1 total
    (a window over the aggregated pairs, ``jn_total_lookup``), level 1,
    count desc.  Means are unrounded in the reference; ``digits`` keeps them
    stable across engines."""
    aged = strict_with_age(df, as_of).filter(F.col(C.LEVEL1).isNotNull() & F.col(C.LEVEL2).isNotNull())
    pairs = aged.groupBy(C.LEVEL1, C.LEVEL2).agg(
        F.count(C.REQUEST_ID).alias("unresolved_count"),
        rnd(F.avg("age_days"), digits).alias("avg_age_days"))
    total = F.sum("unresolved_count").over(Window.partitionBy(C.LEVEL1))
    return (pairs.withColumn("level1_total", total)
                 .orderBy(F.desc("level1_total"), C.LEVEL1, F.desc("unresolved_count"), C.LEVEL2))


def backlog_ranked_l1(df: DataFrame, as_of=None, digits: int = 6) -> DataFrame:
    aged = strict_with_age(df, as_of).filter(F.col(C.LEVEL1).isNotNull())
    return (aged.groupBy(C.LEVEL1)
                .agg(F.count(C.REQUEST_ID).alias("unresolved_count"),
                     rnd(F.avg("age_days"), digits).alias("avg_age_days"))
                .orderBy(F.desc("unresolved_count"), C.LEVEL1))


def backlog_rollup(df: DataFrame, as_of=None, digits: int = 6) -> DataFrame:
    """Both levels in one pass with ``rollup`` (level-2 rows + level-1 subtotals
    + grand total); ``grouping_id`` tells the levels apart."""
    aged = strict_with_age(df, as_of).filter(F.col(C.LEVEL1).isNotNull() & F.col(C.LEVEL2).isNotNull())
    return (aged.rollup(C.LEVEL1, C.LEVEL2)
                .agg(F.grouping_id().alias("grouping_level"),
                     F.count(C.REQUEST_ID).alias("unresolved_count"),
                     rnd(F.avg("age_days"), digits).alias("avg_age_days")))


def backlog_totals(df: DataFrame, as_of=None, digits: int = 6) -> DataFrame:
    aged = strict_with_age(df, as_of)
    return aged.agg(
        F.count(F.lit(1)).alias("total_unresolved"),
        F.count_distinct(C.LEVEL1).alias("n_level1"),
        F.count_distinct(C.LEVEL2).alias("n_level2"),
        rnd(F.avg("age_days"), digits).alias("avg_age_days"),
        F.max("age_days").alias("oldest_age_days"),
        F.min("age_days").alias("newest_age_days"))


def age_stats(df: DataFrame, as_of=None, digits: int = 6) -> DataFrame:
    """min / max / mean / median age of open-or-unclosed rows."""
    a = F.col("age_days")
    return unresolved_with_age(df, as_of).agg(
        F.min(a).alias("min_age_days"), F.max(a).alias("max_age_days"),
        rnd(F.avg(a), digits).alias("avg_age_days"),
        rnd(F.median(a), digits).alias("median_age_days"))


def status_counts(df: DataFrame) -> DataFrame:
    """value_counts of the status (nulls not counted), count desc."""
    return (df.filter(F.col(C.STATUS).isNotNull()).groupBy(C.STATUS)
              .agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), C.STATUS))
