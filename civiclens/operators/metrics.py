"""Metric strings ("12.5% growth in Parking") parsed with column expressions.

The parser runs over a table of strings, so it is a projection: no Python
per row.  The first matching rule wins, as in the sequential parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclens.functions.text import strip

# Extraction patterns, in priority order.
PCT = r"([+-]?\d+\.?\d*)\s*%"
REQUESTS = r"(\d+)\s*requests?"
INCREASE = r"(?i)([+-]?\d+)\s*(?:requests?|items?|units?)?\s*(?:increase|decrease)"
COUNT = r"(\d+)\s*(?:requests?|items?|units?|cases?)"
NUMBER = r"([+-]?\d+\.?\d*)"
# Keyword lists (type and trend), checked in this order.
TYPE_KEYWORDS = (
    ("growth", ("growth", "increase", "decrease", "change", "trend")),
    ("volume", ("requests", "volume", "total", "count")),
    ("percentage", ("%", "percent", "percentage")),
    ("time", ("time", "duration", "hours", "days", "minutes")),
)
TREND_KEYWORDS = (
    ("up", ("increase", "growth", "up", "rise", "higher", "+")),
    ("down", ("decrease", "decline", "down", "fall", "lower", "-")),
)
# Category patterns and the tail words removed from a match.
CATEGORY_PATTERNS = (
    r"in\s+([A-Z][a-zA-Z\s&,]+?)(?:\s|$|,|\.)",
    r"([A-Z][a-zA-Z\s&,]+?)\s+(?:with|shows|has|is)",
    r"([A-Z][a-zA-Z\s&,]+?)\s+(?:requests?|growth|increase)",
)
CATEGORY_TAIL = r"(?i)\s+(with|shows|has|is|requests?|growth|increase)"


def _num(text: Column, pattern: str) -> Column:
    hit = text.rlike(pattern)
    return F.when(hit, F.regexp_extract(text, pattern, 1).cast("double"))


def value_unit(text: Column) -> tuple[Column, Column]:
    pct, req, inc, cnt, num = (_num(text, p) for p in (PCT, REQUESTS, INCREASE, COUNT, NUMBER))
    value = F.coalesce(pct, req, inc, cnt, num)
    unit = (F.when(pct.isNotNull(), F.lit("%"))
             .when(req.isNotNull(), F.lit("requests"))
             .when(inc.isNotNull(), F.when(F.lower(text).contains("request"), F.lit("requests"))
                   .otherwise(F.lit("units")))
             .when(cnt.isNotNull(), F.lit("units")))
    return value, unit


def _any(text_lower: Column, words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text_lower.contains(w)
    return cond


def metric_type(text: Column) -> Column:
    low = F.lower(text)
    expr = None
    for name, words in TYPE_KEYWORDS:
        expr = (F.when(_any(low, words), F.lit(name)) if expr is None
                else expr.when(_any(low, words), F.lit(name)))
    return expr.otherwise(F.lit("unknown"))


def category(text: Column) -> Column:
    expr = None
    for p in CATEGORY_PATTERNS:
        raw = strip(F.regexp_extract(text, p, 1))
        c = F.regexp_replace(raw, CATEGORY_TAIL, "")
        ok = text.rlike(p) & (F.length(c) > 3)
        expr = F.when(ok, c) if expr is None else expr.when(ok, c)
    return expr


def trend(text: Column) -> Column:
    low = F.lower(text)
    expr = None
    for name, words in TREND_KEYWORDS:
        expr = (F.when(_any(low, words), F.lit(name)) if expr is None
                else expr.when(_any(low, words), F.lit(name)))
    return (expr.when(text.contains("+"), F.lit("up"))
                .when(text.contains("-") & ~text.startswith("-"), F.lit("down")))


def one_decimal(value: Column) -> Column:
    """Text with one decimal, rounded half to even on the exact binary value.

    ``20 * |value|`` is 16 and 4 times it, both exact; the error of their sum is
    exact as well, so the comparison with the odd integer that marks the half
    way point is exact.
    """
    a = F.abs(value)
    k = F.floor(a * 10)
    big, small = a * 16, a * 4
    total = big + small
    rest = total - big
    error = (big - (total - rest)) + (small - rest)
    past = (total - (k * 2 + 1)) + error
    tenths = k + F.when((past > 0) | ((past == 0) & (k % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def label(text: Column, mtype: Column, value: Column, unit: Column) -> Column:
    nz = value.isNotNull() & (value != 0)
    # What is taken out of the text of a metric of unknown type.
    other = F.initcap(strip(F.regexp_replace(
        F.regexp_replace(text, r"\d+\.?\d*\s*%?", ""),
        r"(?i)\b(in|with|shows|has|is|requests?|growth|increase|decrease)\b", "")))
    return (F.when(mtype == "growth", F.when(nz, F.concat(
        F.when(value < 0, "-").otherwise("+"), one_decimal(value), F.lit("% Growth")))
                   .otherwise(F.lit("Growth Rate")))
             .when(mtype == "volume", F.when(nz, F.concat_ws(" ", value.cast("long").cast("string"),
                                                           F.coalesce(unit, F.lit("Items"))))
                   .otherwise(F.lit("Volume")))
             .when(mtype == "percentage", F.when(nz, F.concat(
                 F.when(value < 0, "-").otherwise(""), one_decimal(value), F.lit("%")))
                   .otherwise(F.lit("Percentage")))
             .otherwise(F.when(other != "", other).otherwise(F.lit("Metric"))))


def parse(df: DataFrame, col: str = "metric") -> DataFrame:
    t = strip(col)
    v, u = value_unit(t)
    out = df.select("*", v.alias("value"), u.alias("unit"), metric_type(t).alias("metric_type"),
                    category(t).alias("category"), trend(t).alias("trend"))
    return out.withColumn("label", label(t, F.col("metric_type"), F.col("value"), F.col("unit")))


def grouped(parsed: DataFrame) -> DataFrame:
    """Each metric under its type and category, one row per metric, so a group
    of any size stays spread over rows."""
    return parsed.select(F.coalesce("metric_type", F.lit("unknown")).alias("metric_type"),
                         F.coalesce("category", F.lit("Other")).alias("category"), "metric", "value", "unit")


def group_by_type(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(F.coalesce("metric_type", F.lit("unknown")).alias("metric_type")).agg(
        F.count(F.lit(1)).alias("n_metrics"))


def group_by_category(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(F.coalesce("category", F.lit("Other")).alias("category")).agg(
        F.count(F.lit(1)).alias("n_metrics"))
