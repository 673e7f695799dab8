"""Five top-10 rankings and their combined long form.

Each ranking is one scan with a map-side partial aggregate on a
low-cardinality key, then a TakeOrderedAndProject for the top k.  The
reference "now" is a scalar subquery (max of the creation date), evaluated
once and inlined; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiclens.functions import columns as C
from civiclens.functions.predicates import is_open, is_solved
from civiclens.functions.ranking import rnd, share_pct, top_k, with_rank
from civiclens.functions.timecalc import floor_days, minus_days, resolve_as_of

LAST_N_DAYS = 30
MIN_REQUESTS = 10
MIN_PREVIOUS = 5


def top_volume(df: DataFrame, days: int = LAST_N_DAYS, k: int = 10, as_of=None,
               group: str = C.LEVEL1) -> DataFrame:
    """Requests per category created in [as_of - days, as_of]; share of the
    grouped total (null categories excluded, T12); top k by volume, ties by
    category ascending (T8)."""
    now = resolve_as_of(df, as_of)
    recent = df.filter((F.col(C.CREATED) >= minus_days(now, days)) & F.col(group).isNotNull())
    counts = recent.groupBy(group).agg(F.count(F.lit(1)).alias("volume"))
    ranked = top_k(counts.withColumn("pct_of_total", share_pct("volume")), k,
                   [F.desc("volume"), F.asc(group)])
    return ranked.select(F.col(group).alias("category"), "volume", "pct_of_total")


def days_to_close(df: DataFrame) -> DataFrame:
    """Solved rows with a valid (non-null, >= 0) floor-day duration (T4, T5)."""
    return (df.filter(is_solved())
              .withColumn("days_to_close", floor_days(C.CLOSED, C.CREATED))
              .filter(F.col("days_to_close") >= 0))


def top_worst_p90(df: DataFrame, min_requests: int = MIN_REQUESTS, k: int = 10,
                  group: str = C.LEVEL1) -> DataFrame:
    """Exact interpolated p90 / median of days-to-close, rounded to 1 dp
    before ranking (T6, T7); categories with fewer closed rows dropped."""
    closed = days_to_close(df).filter(F.col(group).isNotNull())
    stats = (closed.groupBy(group)
             .agg(F.percentile("days_to_close", F.lit(0.9)).alias("p90"),
                  F.median("days_to_close").alias("med"),
                  F.count(F.lit(1)).alias("request_count"))
             .filter(F.col("request_count") >= min_requests)
             .select(F.col(group).alias("category"),
                     rnd("p90", 1).alias("p90_days"),
                     rnd("med", 1).alias("median_days"),
                     "request_count"))
    return top_k(stats, k, [F.desc("p90_days"), F.asc("category")])


def age_or_duration(df: DataFrame, now) -> DataFrame:
    """Open rows (null status counts, T1): now - created; solved rows:
    closed - created; null or negative results dropped."""
    age = F.when(is_open(), floor_days(now, C.CREATED)).otherwise(
        floor_days(C.CLOSED, C.CREATED))
    return df.withColumn("age_days", age).filter(F.col("age_days") >= 0)


def top_backlog_age(df: DataFrame, min_requests: int = MIN_REQUESTS, k: int = 10,
                    as_of=None, group: str = C.LEVEL1) -> DataFrame:
    """p90 and mean of age-or-duration per category plus the number of open
    rows (counted on all rows, before the validity filter); one scan."""
    now = resolve_as_of(df, as_of)
    age = F.when(is_open(), floor_days(now, C.CREATED)).otherwise(
        floor_days(C.CLOSED, C.CREATED))
    valid = F.when(age >= 0, age)
    stats = (df.filter(F.col(group).isNotNull())
             .groupBy(group)
             .agg(F.percentile(valid, F.lit(0.9)).alias("p90"),
                  F.avg(valid).alias("avg"),
                  F.count(valid).alias("total_count"),
                  F.count_if(is_open()).alias("open_count"))
             .filter(F.col("total_count") >= min_requests)
             .select(F.col(group).alias("category"),
                     rnd("p90", 1).alias("p90_age_days"),
                     rnd("avg", 1).alias("avg_age_days"),
                     "open_count", "total_count"))
    return top_k(stats, k, [F.desc("p90_age_days"), F.asc("category")])


def trending_counts(df: DataFrame, recent_days: int = LAST_N_DAYS,
                    previous_days: int = LAST_N_DAYS, as_of=None,
                    group: str = C.LEVEL1) -> DataFrame:
    """Recent and previous window counts per category in one scan.

    Equal to the full outer join of two separate counts with nulls as 0
    (``jn_trend_outer``) but reads the table once.  Only rows inside one of
    the two windows form groups, as in the join form.
    """
    now = resolve_as_of(df, as_of)
    recent_cut = minus_days(now, recent_days)
    prev_cut = recent_cut - F.make_dt_interval(F.lit(int(previous_days)))
    created = F.col(C.CREATED)
    in_recent = created >= recent_cut
    in_prev = (created >= prev_cut) & (created < recent_cut)
    return (df.filter(F.col(group).isNotNull() & (in_recent | in_prev))
              .groupBy(group)
              .agg(F.count_if(in_recent).alias("recent_volume"),
                   F.count_if(in_prev).alias("previous_volume")))


def growth_rate(recent: str = "recent_volume", previous: str = "previous_volume"):
    """(recent - previous) / previous * 100, 1 dp; previous 0 -> 100 or 0."""
    r, p = F.col(recent), F.col(previous)
    return F.when(p > 0, rnd((r - p) / p * F.lit(100.0), 1)).otherwise(
        F.when(r > 0, F.lit(100.0)).otherwise(F.lit(0.0)))


def top_trending(df: DataFrame, recent_days: int = LAST_N_DAYS,
                 previous_days: int = LAST_N_DAYS, k: int = 10, as_of=None,
                 min_previous: int = MIN_PREVIOUS, group: str = C.LEVEL1) -> DataFrame:
    """Top k by absolute change among categories with >= 5 previous rows."""
    t = trending_counts(df, recent_days, previous_days, as_of, group)
    t = (t.withColumn("absolute_change", F.col("recent_volume") - F.col("previous_volume"))
          .withColumn("growth_rate", growth_rate())
          .filter(F.col("previous_volume") >= min_previous))
    return top_k(t, k, [F.desc("absolute_change"), F.asc(group)]).select(
        F.col(group).alias("category"), "recent_volume", "previous_volume",
        "growth_rate", "absolute_change")


def mode_by_group(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Most common non-null ``value`` per ``group``: count desc, value asc."""
    counts = (df.filter(F.col(value).isNotNull())
                .groupBy(group, value).agg(F.count(F.lit(1)).alias("_n")))
    return _mode(counts, group, value, out)


def _mode(counts: DataFrame, group: str, value: str, out: str) -> DataFrame:
    # Highest count wins; among equal counts the smallest value: rank inside
    # each group (few values per group after aggregation).
    w = Window.partitionBy(group).orderBy(F.desc("_n"), F.asc(value))
    return (counts.withColumn("_r", F.row_number().over(w))
                  .filter(F.col("_r") == 1)
                  .select(group, F.col(value).alias(out)))


def top_geo_hotspots(df: DataFrame, days: int = LAST_N_DAYS, k: int = 10, as_of=None,
                     area: str = C.NEIGHBOURHOOD, group: str = C.LEVEL1) -> DataFrame:
    """Recent volume per neighbourhood, its share, and its most common
    category (rows with a null category do not vote); top k by volume."""
    now = resolve_as_of(df, as_of)
    recent = df.filter((F.col(C.CREATED) >= minus_days(now, days)) & F.col(area).isNotNull())
    pair = recent.groupBy(area, group).agg(F.count(F.lit(1)).alias("_n"))
    # Within an area's pairs: the total, and the category that comes first.
    voted = F.struct(F.when(F.col(group).isNotNull(), -F.col("_n")), F.col(group))
    vol = pair.groupBy(area).agg(F.sum("_n").alias("volume"),
                                 F.min(F.when(F.col(group).isNotNull(), voted)).alias("_first"))
    hot = vol.select(area, "volume", F.col("_first")[group].alias("top_category"),
                     share_pct("volume").alias("pct_of_total"))
    return top_k(hot, k, [F.desc("volume"), F.asc(area)]).select(
        F.col(area).alias("neighbourhood"), "volume", "pct_of_total",
        F.coalesce(F.col("top_category"), F.lit("N/A")).alias("top_category"))


# Ranking type names and metric names of the combined table.
RANKING_TYPES = ("Volume (Last 30 Days)", "Worst P90 Time-to-Close", "Backlog Age",
                 "Trending Up", "Geographic Hotspots")


def top_combined(df: DataFrame, k: int = 10, as_of=None) -> DataFrame:
    """The five rankings stacked into one long table (``set_union``)."""
    # Three scans: one aggregate of all rows gives the two age rankings, one of
    # the last two windows gives volume and trend, one the hotspots.  Every
    # ranking then runs over rows of one per category.
    now = resolve_as_of(df, as_of)
    d = lambda c: F.col(c).cast("double")

    def block(n: int, metrics, keep, order) -> Column:
        """One ranking's row of a category: metrics as (column, name) pairs."""
        cells = {}
        for place, (value, name) in zip(("primary", "secondary", "tertiary"), metrics, strict=True):
            cells[f"{place}_metric"], cells[f"{place}_metric_name"] = value, name
        return F.struct(F.lit(RANKING_TYPES[n]).alias("ranking_type"), F.col(C.LEVEL1).alias("category"),
                        keep.alias("keep"), order.cast("double").alias("order"),
                        *[v.alias(k) for k, v in cells.items()])

    def ranked(stats: DataFrame, *blocks: Column) -> DataFrame:
        rows = stats.select(F.explode(F.array(*blocks)).alias("r")).select("r.*").filter("keep")
        w = Window.partitionBy("ranking_type").orderBy(F.desc("order"), F.asc("category"))
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    duration = floor_days(C.CLOSED, C.CREATED)
    closed = F.when(is_solved() & (duration >= 0), duration)
    age = F.when(is_open(), floor_days(now, C.CREATED)).otherwise(duration)
    valid = F.when(age >= 0, age)
    ages = df.filter(F.col(C.LEVEL1).isNotNull()).groupBy(C.LEVEL1).agg(
        rnd(F.percentile(closed, F.lit(0.9)), 1).alias("p90_days"), rnd(F.median(closed), 1).alias("median_days"),
        F.count(closed).alias("request_count"), rnd(F.percentile(valid, F.lit(0.9)), 1).alias("p90_age_days"),
        rnd(F.avg(valid), 1).alias("avg_age_days"), F.count(valid).alias("total_count"),
        F.count_if(is_open()).alias("open_count"))
    by_age = ranked(
        ages,
        block(1, [(d("p90_days"), F.lit("p90_days")), (d("median_days"), F.lit("median_days")),
                  (d("request_count"), F.lit("request_count"))],
              F.col("request_count") >= MIN_REQUESTS, F.col("p90_days")),
        block(2, [(d("p90_age_days"), F.lit("p90_age_days")), (d("avg_age_days"), F.lit("avg_age_days")),
                  (d("open_count"), F.lit("open_count"))],
              F.col("total_count") >= MIN_REQUESTS, F.col("p90_age_days")))
    counts = trending_counts(df, as_of=now).select(
        "*", share_pct("recent_volume").alias("pct"), growth_rate().alias("growth"),
        (F.col("recent_volume") - F.col("previous_volume")).alias("change"))
    by_count = ranked(
        counts,
        block(0, [(d("recent_volume"), F.lit("volume")), (d("pct"), F.lit("pct_of_total")), (none_d, none_s)],
              F.col("recent_volume") > 0, F.col("recent_volume")),
        block(3, [(d("change"), F.lit("absolute_change")), (d("growth"), F.lit("growth_rate")),
                  (d("recent_volume"), F.lit("recent_volume"))],
              F.col("previous_volume") >= MIN_PREVIOUS, F.col("change")))
    hot = top_geo_hotspots(df, k=k, as_of=now)
    geo = with_rank(hot, [F.desc("volume"), F.asc("neighbourhood")]).select(
        F.lit(RANKING_TYPES[4]).alias("ranking_type"), F.col("rank"), F.col("neighbourhood").alias("category"),
        d("volume").alias("primary_metric"), F.lit("volume").alias("primary_metric_name"),
        d("pct_of_total").alias("secondary_metric"), F.lit("pct_of_total").alias("secondary_metric_name"),
        none_d.alias("tertiary_metric"), F.concat(F.lit("top_category: "), F.col("top_category"))
        .alias("tertiary_metric_name"))
    names = geo.columns
    out = by_age.select(*names).unionByName(by_count.select(*names)).unionByName(geo)
    return out.withColumn("rank", F.col("rank").cast("long"))
