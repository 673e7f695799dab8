"""Priority quadrant: volume vs time-to-close per group, with categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiclens.functions import columns as C
from civiclens.functions.predicates import is_open, is_solved
from civiclens.functions.ranking import rnd, top_k
from civiclens.functions.timecalc import floor_days, minus_days

# Quadrant names.
HIGH = "High Priority (Systemic)"
MEDIUM = "Medium Priority"
LOW = "Low Priority"
UNKNOWN = "Unknown"


def priority(df: DataFrame, group_by: str = C.LEVEL1, time_metric: str = "p90",
             bubble_metric: str = "recent_volume", last_n_days: int = 30,
             digits: int = 6) -> DataFrame:
    """One conditional aggregation per group (the reference loops per group).

    The "recent" cut-off is max(created) over rows whose group is not null
    (``prj_recent_flag``), evaluated once as a scalar subquery.
    """
    base = df.filter(F.col(group_by).isNotNull())
    now = base.select(F.max(C.CREATED)).scalar()
    d = floor_days(C.CLOSED, C.CREATED)
    valid = F.when(is_solved() & (d >= 0), d)
    q = 0.9 if time_metric == "p90" else 0.5
    recent = F.col(C.CREATED) >= minus_days(now, last_n_days)
    g = base.groupBy(group_by).agg(
        F.count(F.lit(1)).alias("request_count"),
        rnd(F.percentile(valid, F.lit(q)), digits).alias("time_to_close_days"),
        F.count_if(is_open()).alias("open_count"),
        F.count_if(recent).alias("recent_volume"),
        F.count(valid).alias("closed_count"))
    bubble = "recent_volume" if bubble_metric == "recent_volume" else "open_count"
    return (g.select(F.col(group_by).alias("group"), "request_count", "time_to_close_days",
                     "open_count", "recent_volume", F.col(bubble).alias("bubble_size"),
                     "closed_count")
             .orderBy(F.desc("request_count"), "group"))


def categorize(pq: DataFrame, volume_threshold: float | None = None,
               time_threshold: float | None = None) -> DataFrame:
    """Quadrant per group; thresholds default to the medians over the groups
    (null times skipped), compared with ``>=``.  The medians are windows over
    the aggregated frame (one row per group)."""
    w = Window.partitionBy()
    vt = F.lit(volume_threshold) if volume_threshold is not None else F.median("request_count").over(w)
    tt = F.lit(time_threshold) if time_threshold is not None else F.median("time_to_close_days").over(w)
    t = pq.withColumn("_vt", vt).withColumn("_tt", tt)
    hv = F.col("request_count") >= F.col("_vt")
    ht = F.col("time_to_close_days") >= F.col("_tt")
    cat = (F.when(F.col("time_to_close_days").isNull(), F.lit(UNKNOWN))
            .when(hv & ht, F.lit(HIGH)).when(hv | ht, F.lit(MEDIUM)).otherwise(F.lit(LOW)))
    return t.withColumn("priority_category", cat).drop("_vt", "_tt")


def priority_top(pq: DataFrame, by: str = "request_count", k: int = 10) -> DataFrame:
    cols = ["group", "request_count", "time_to_close_days", "open_count"]
    return top_k(pq.select(*cols).filter(F.col(by).isNotNull()), k, [F.desc(by), F.asc("group")])


def priority_distribution(cat: DataFrame) -> DataFrame:
    return cat.groupBy("priority_category").agg(F.count(F.lit(1)).alias("groups"))


def priority_totals(pq: DataFrame, digits: int = 6) -> DataFrame:
    t = F.col("time_to_close_days")
    return pq.agg(F.count(F.lit(1)).alias("groups"),
                  F.sum("request_count").alias("total_requests"),
                  F.sum("open_count").alias("total_open"),
                  rnd(F.median(t), digits).alias("median_time"),
                  rnd(F.avg(t), digits).alias("mean_time"),
                  F.max(t).alias("max_time"))
