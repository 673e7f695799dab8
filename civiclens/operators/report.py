"""Report tables and bands over parsed metrics and product frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiclens.functions.ranking import rnd, top_k


def growth_reconcile(parsed: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """Per category: growth % (only values with unit '%', T20), increase
    ('increase' strings), recent volume ('recent' strings); derive the
    original volume; keep complete rows; top k by |growth|."""
    low = F.lower(F.col("metric"))
    has_cat = F.col("category").isNotNull() & F.col("value").isNotNull()
    g = parsed.filter(has_cat).groupBy("category").agg(
        F.max_by("value", F.when((F.col("metric_type") == "growth") & (F.col("unit") == "%"),
                                 F.col("_row"))).alias("growth"),
        F.max_by("value", F.when(low.contains("increase"), F.col("_row"))).alias("increase"),
        F.max_by("value", F.when(~low.contains("increase") & low.contains("recent"), F.col("_row")))
         .alias("recent_volume"))
    gr, inc, rec = F.col("growth"), F.col("increase"), F.col("recent_volume")
    orig = (F.when(rec.isNotNull() & inc.isNotNull(), rec - inc)
             .when(rec.isNotNull() & gr.isNotNull(),
                   F.when(gr != 0, rec / (F.lit(1.0) + gr / 100.0)).otherwise(rec))
             .when(inc.isNotNull() & gr.isNotNull(),
                   F.when(gr != 0, inc / (gr / 100.0)).otherwise(F.lit(0.0))))
    out = g.withColumn("original_value", rnd(orig, digits)).filter(
        F.col("original_value").isNotNull() & gr.isNotNull())
    return top_k(out.withColumn("abs_growth", F.abs(gr)), k,
                 [F.desc("abs_growth"), F.asc("category")]).drop("abs_growth")


def growth_bands(growth: DataFrame) -> DataFrame:
    """Largest |growth| band with the top two categories, and the gap band
    between the first and second (rows: category, growth)."""
    w = Window.orderBy(F.desc(F.abs("growth")), F.asc("category"))
    r = growth.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2)
    a = r.agg(F.max(F.when(F.col("_r") == 1, F.col("growth"))).alias("top_growth"),
              F.max(F.when(F.col("_r") == 1, F.col("category"))).alias("top_category"),
              F.max(F.when(F.col("_r") == 2, F.col("growth"))).alias("second_growth"),
              F.max(F.when(F.col("_r") == 2, F.col("category"))).alias("second_category"))
    t, s = F.abs(F.col("top_growth")), F.abs(F.col("second_growth"))
    band = (F.when(t > 75, "exceptional growth").when(t > 50, "substantial growth")
             .when(t > 20, "moderate growth").otherwise("notable changes"))
    gap = t - s
    gap_band = (F.when(F.col("second_growth").isNull(), F.lit(None))
                 .when(gap > 30, "significantly higher").when(gap > 15, "notably higher")
                 .otherwise("somewhat higher"))
    return a.select("*", band.alias("growth_band"), gap_band.alias("gap_band"))


def share_band(volumes: DataFrame) -> DataFrame:
    """Top category's share of the listed volumes: > 40 dominant, > 25
    substantial, else notable."""
    w = Window.partitionBy()
    r = volumes.withColumn("share", F.col("volume") / F.sum("volume").over(w) * 100.0)
    top = top_k(r, 1, [F.desc("volume"), F.asc("category")])
    return top.select("category", rnd("share", 6).alias("share"),
                      F.when(F.col("share") > 40, "a dominant share")
                       .when(F.col("share") > 25, "a substantial share")
                       .otherwise("a notable share").alias("share_band"))


def hot_and_big(growth: DataFrame, volumes: DataFrame, hot: float = 50, big: float = 300) -> DataFrame:
    g = growth.filter(F.abs("growth") > hot)
    return g.join(volumes.select("category", "volume"), "category", "left").select(
        "category", "growth", F.coalesce(F.col("volume") > big, F.lit(False)).alias("high_volume"))


def positive_growth(growth: DataFrame, min_count: int = 3) -> DataFrame:
    return growth.agg(F.count(F.lit(1)).alias("n_growth"),
                      F.count_if(F.col("growth") > 0).alias("n_positive")).withColumn(
        "broad_positive", (F.col("n_growth") >= min_count) & (F.col("n_positive") >= min_count))


def top15(df: DataFrame, metric: str, key: str, k: int = 15, digits: int = 2) -> DataFrame:
    """Top k rows by ``metric`` and each row's share of the shown total
    (the window runs over the k rows after the limit)."""
    t = top_k(df, k, [F.desc(metric), F.asc(key)])
    return t.withColumn("share_of_shown", rnd(F.col(metric) / F.sum(metric).over(Window.partitionBy())
                                              * 100.0, digits))


def last_periods(wide: DataFrame, time_col: str = "Time", k: int = 15, n_cols: int = 5) -> DataFrame:
    """Last k periods (a small report) with the first n category columns."""
    cats = [c for c in wide.columns if c != time_col][:n_cols]
    return top_k(wide, k, [F.desc(time_col)]).select(time_col, *cats)


def backlog_top15_by_l1(ranked: DataFrame, k: int = 15) -> DataFrame:
    """Top k (count desc, age desc) pairs, then summed by level 1: the
    report's figure is a sum over the shown rows, not the true total."""
    t = top_k(ranked, k, [F.desc("unresolved_count"), F.desc("avg_age_days"),
                          F.asc("service_level_1"), F.asc("service_level_2")])
    return t.groupBy("service_level_1").agg(F.sum("unresolved_count").alias("shown_unresolved"))


# The wording that replaces numbers in report text.
PCT_TOKEN = r"\d+\.?\d*%"
REQUEST_COUNT = r"\d+ requests?"


def _pct_band(p):
    v = F.regexp_replace(p, "%", "").cast("double")
    return (F.when(v > 50, F.lit("substantial growth")).when(v > 20, F.lit("moderate growth"))
             .otherwise(F.lit("notable growth")))


def qualitative(text_col: str = "text"):
    """Numbers replaced by words: every percentage by its own band, request
    counts by "significant volume", other digits removed, spaces collapsed.

    The value-dependent replacement splits the text at the percentages and
    interleaves the pieces with each match's band (array functions, no UDF).
    """
    t = F.col(text_col)
    pcts = F.regexp_extract_all(t, F.lit(PCT_TOKEN), 0)
    pieces = F.split(t, PCT_TOKEN, -1)
    tail = F.transform(pcts, lambda p, i: F.concat(_pct_band(p), F.element_at(pieces, i + 2)))
    out = F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))
    out = F.regexp_replace(out, REQUEST_COUNT, "significant volume")
    out = F.regexp_replace(out, r"\d+", "")
    out = F.trim(F.regexp_replace(F.trim(out), r"\s+", " "))
    return F.regexp_replace(out, r"[,\s]+\.", ".")


def qualitative_kept(col: str = "qualitative"):
    """The report keeps a rewritten sentence only when longer than 30 chars."""
    return F.length(F.col(col)) > 30
