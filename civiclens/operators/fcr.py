"""First-call resolution rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiclens.functions import columns as C
from civiclens.functions.ranking import rnd


def fcr_rate(df: DataFrame, group: str = C.LEVEL1, min_volume: int = 0) -> DataFrame:
    """Yes/No counts per category (rows with a null category or flag are
    dropped; other flag values form the group but count in neither side);
    rate = yes / (yes + no) * 100, 2 dp; ascending rate."""
    flag = F.col(C.FCR)
    clean = df.filter(F.col(group).isNotNull() & flag.isNotNull())
    r = (clean.groupBy(group)
              .agg(F.count_if(flag == "Yes").alias("fcr_yes"),
                   F.count_if(flag == "No").alias("fcr_no"))
              .withColumn("total_requests", F.col("fcr_yes") + F.col("fcr_no"))
              .withColumn("fcr_rate", rnd(F.try_divide(F.col("fcr_yes"), F.col("total_requests"))
                                          * 100.0, 2)))
    if min_volume > 0:
        r = r.filter(F.col("total_requests") >= min_volume)
    return (r.select(F.col(group).alias("category"), "fcr_yes", "fcr_no", "total_requests", "fcr_rate")
             .orderBy(F.asc("fcr_rate"), "category"))


def fcr_pivot(df: DataFrame, group: str = C.LEVEL1) -> DataFrame:
    """The same counts through ``pivot`` with the value list given up front
    (no extra job to discover the values); missing side = 0."""
    clean = df.filter(F.col(group).isNotNull() & F.col(C.FCR).isNotNull())
    return (clean.groupBy(group).pivot(C.FCR, ["Yes", "No"]).count().na.fill(0, ["Yes", "No"])
                 .select(F.col(group).alias("category"), F.col("Yes").alias("fcr_yes"),
                         F.col("No").alias("fcr_no")))


def fcr_overall(fcr: DataFrame, digits: int = 6) -> DataFrame:
    """Overall rate and the categories below it, from the per-category frame
    (a few rows): windows over the whole small frame."""
    w = Window.partitionBy()
    overall = F.sum("fcr_yes").over(w) / F.sum("total_requests").over(w) * 100.0
    t = fcr.withColumn("_overall", overall)
    below = F.col("fcr_rate") < F.col("_overall")
    return t.agg(
        rnd(F.first("_overall"), digits).alias("overall_fcr_rate"),
        F.count(F.lit(1)).alias("n_categories"),
        F.count_if(below).alias("n_below"),
        rnd(F.count_if(below) / F.count(F.lit(1)) * 100.0, 1).alias("pct_categories_below"),
        rnd(F.sum(F.when(below, F.col("total_requests")).otherwise(0)) / F.sum("total_requests")
            * 100.0, 1).alias("pct_requests_below"))
