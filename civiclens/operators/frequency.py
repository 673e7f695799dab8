"""Monthly frequency (long, wide, stats) and seasonality heatmap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiclens.functions import columns as C
from civiclens.functions.ranking import rnd, top_k
from civiclens.functions.timecalc import year_month

# Month-name headers of the heatmap.
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December")


def frequency_long(df: DataFrame, group: str = C.LEVEL1) -> DataFrame:
    """(month, category) -> count; rows with a null month or category dropped."""
    ym = year_month(C.CREATED)
    return (df.filter(F.col(C.CREATED).isNotNull() & F.col(group).isNotNull())
              .groupBy(ym.alias("Time"), F.col(group))
              .agg(F.count(F.lit(1)).alias("frequency")))


def frequency_pivot(df: DataFrame, group: str = C.LEVEL1,
                    values: Sequence[str] | None = None, other: str = "Other") -> DataFrame:
    """Month rows x category columns, missing cells 0, no calendar densify
    (a month without any row is absent, T14).

    ``values`` names the columns, and the fact table is scanned once; requests
    of all other categories are summed in the column ``other``, so every request
    is counted.  Without it Spark looks the categories up first, at most
    ``spark.sql.pivotMaxValues`` of them.
    """
    long = frequency_long(df, group)
    if values:
        named = F.col(group).isin(*[v for v in values if v != other])
        long = long.withColumn(group, F.when(named, F.col(group)).otherwise(F.lit(other)))
        values = [*[v for v in values if v != other], other]
    grouped = long.groupBy("Time")
    grouped = grouped.pivot(group, list(values)) if values else grouped.pivot(group)
    wide = grouped.agg(F.sum("frequency"))
    cats = [c for c in wide.columns if c != "Time"]
    return wide.na.fill(0, cats).orderBy("Time")


def frequency_stats(df: DataFrame, group: str = C.LEVEL1) -> DataFrame:
    """Per category over all listed months (zero cells included): mean (2 dp),
    min, max, sum.  Zero cells are derived from counts, not materialized:
    a category present in fewer months than exist has min 0."""
    long = frequency_long(df, group)
    n_months = long.select(F.count_distinct("Time")).scalar()
    s = long.groupBy(group).agg(
        F.sum("frequency").alias("total_requests"),
        F.max("frequency").alias("max_frequency"),
        F.min("frequency").alias("_min_present"),
        F.count(F.lit(1)).alias("_months_present"))
    return s.select(
        group,
        rnd(F.col("total_requests") / n_months, 2).alias("mean_frequency"),
        F.when(F.col("_months_present") < n_months, F.lit(0).cast("long"))
         .otherwise(F.col("_min_present")).alias("min_frequency"),
        "max_frequency", "total_requests")


def seasonality_long(df: DataFrame, digits: int = 6) -> DataFrame:
    """Mean over years of the (category, year, month) counts that exist (T13);
    category = level 1 falling back to the service type."""
    cat = F.coalesce(F.col(C.LEVEL1), F.col(C.SERVICE_TYPE))
    base = df.select(cat.alias("service_category"),
                     F.year(C.CREATED).alias("_y"), F.month(C.CREATED).alias("month"))
    base = base.filter(F.col("month").isNotNull() & F.col("service_category").isNotNull())
    cells = base.groupBy("service_category", "_y", "month").agg(F.count(F.lit(1)).alias("_n"))
    return cells.groupBy("service_category", "month").agg(
        rnd(F.avg("_n"), digits).alias("avg_requests"))


def seasonality(df: DataFrame, digits: int = 6) -> DataFrame:
    """Category rows x 12 month-name columns (all present, missing 0),
    ordered by the row total descending."""
    long = seasonality_long(df, digits)
    wide = (long.groupBy("service_category").pivot("month", list(range(1, 13)))
                .agg(F.first("avg_requests")).na.fill(0.0))
    named = wide.select("service_category",
                        *[F.col(str(m)).alias(MONTH_NAMES[m - 1]) for m in range(1, 13)])
    total = sum((F.col(n) for n in MONTH_NAMES), F.lit(0.0))
    return named.orderBy(F.desc(total), "service_category")


def seasonality_peaks(df: DataFrame, k: int = 15, digits: int = 6) -> DataFrame:
    """For the first ``k`` heatmap rows: peak and low month (earliest on ties),
    their values (1 dp) and peak/low ratio (2 dp; null when low is 0); rows
    whose peak is 0 are skipped."""
    wide = seasonality(df, digits)
    total = sum((F.col(n) for n in MONTH_NAMES), F.lit(0.0))
    top = top_k(wide.withColumn("_total", total), k,
                [F.desc("_total"), F.asc("service_category")])
    long = top.unpivot(["service_category"], list(MONTH_NAMES), "month_name", "v").withColumn(
        "_m", F.array_position(F.array(*[F.lit(n) for n in MONTH_NAMES]), F.col("month_name")))
    p = long.groupBy("service_category").agg(
        F.max_by("month_name", F.struct(F.col("v"), -F.col("_m"))).alias("peak_month"),
        F.max("v").alias("_peak"),
        F.min_by("month_name", F.struct(F.col("v"), F.col("_m"))).alias("low_month"),
        F.min("v").alias("_low"))
    return (p.filter(F.col("_peak") > 0)
             .select("service_category", "peak_month", rnd("_peak", 1).alias("peak_avg"),
                     "low_month", rnd("_low", 1).alias("low_avg"),
                     F.when(F.col("_low") > 0, rnd(F.col("_peak") / F.col("_low"), 2))
                      .alias("seasonality_ratio")))


def latest_share(df: DataFrame, group: str = C.LEVEL1) -> DataFrame:
    """Last listed month: per category value, share % (1 dp) and whether it
    is the top category (``agg_latest_share``)."""
    long = frequency_long(df, group)
    last = long.select(F.max("Time")).scalar()
    cur = long.filter(F.col("Time") == last)
    w = Window.partitionBy()
    share = F.col("frequency") / F.sum("frequency").over(w) * 100.0
    return cur.select(
        "Time", group, F.col("frequency").alias("value"),
        rnd(share, 1).alias("share_pct"),
        # the dashboard's whole-number share rounds half up
        F.floor(share + F.lit(0.5)).alias("share_pct_whole"),
        (F.row_number().over(Window.orderBy(F.desc("frequency"), F.asc(group))) == 1)
        .alias("is_top"))


def period_change(df: DataFrame, group: str = C.LEVEL1) -> DataFrame:
    """Each listed month vs the previous listed month per category, pct change
    1 dp (null when the previous value is 0 or absent) (``agg_period_change``).

    Months missing for a category count as 0 (the pivot's fill), so the
    previous listed month is taken over all months, not per category.
    """
    long = frequency_long(df, group)
    months = long.select("Time").distinct()
    months = months.withColumn("_prev", F.lag("Time").over(Window.orderBy("Time")))
    cur = long.join(months, "Time")
    prev = long.select(F.col("Time").alias("_prev"), F.col(group),
                       F.col("frequency").alias("previous_value"))
    j = cur.join(prev, ["_prev", group], "left").withColumn(
        "previous_value", F.when(F.col("_prev").isNotNull(),
                                 F.coalesce(F.col("previous_value"), F.lit(0).cast("long"))))
    return j.select("Time", group, F.col("frequency").alias("value"), "previous_value",
                    rnd(F.try_divide(F.col("frequency") - F.col("previous_value"),
                                     F.col("previous_value")) * 100.0, 1).alias("pct_change"))
