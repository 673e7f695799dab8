"""Registered metric-string and report-table queries.

Metric strings are produced from the trending counts of the request table
(three strings per category: growth %, increase, recent volume), so the
parser's work grows with the data's categories.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from civiclens.functions import columns as C
from civiclens.operators import backlog as B
from civiclens.operators import frequency as FQ
from civiclens.operators import metrics as M
from civiclens.operators import priority as P
from civiclens.operators import rankings as R
from civiclens.operators import report as RP
from civiclens.plans.oracle import NOW, with_requests
from civiclens.plans.registry import register
from civiclens.session import configure
from civiclens.sources.requests import fact_requests, latest_created
from civiclens.sources.tables import read_table


def metric_strings(spark, sf_dir, days=30):
    configure(spark)
    t = R.trending_counts(fact_requests(spark, sf_dir), days, days, as_of=latest_created(spark, sf_dir)).withColumn(
        "g", R.growth_rate())
    cat = F.initcap(F.lower(F.col(C.LEVEL1)))
    s1 = t.select(F.format_string("%s%% growth in %s", F.col("g").cast("string"), cat).alias("metric"),
                  F.lit(1).alias("_row"))
    s2 = t.select(F.format_string("%d requests increase in %s", F.col("recent_volume") - F.col("previous_volume"),
                                  cat).alias("metric"), F.lit(2).alias("_row"))
    s3 = t.select(F.format_string("%d recent requests in %s", F.col("recent_volume"), cat).alias("metric"),
                  F.lit(3).alias("_row"))
    return s1.unionByName(s2).unionByName(s3)


def parsed(spark, sf_dir, days=30):
    return M.parse(metric_strings(spark, sf_dir, days))


def _initcap(x):
    return (f"array_to_string(list_transform(string_split(lower({x}), ' '), "
            f"lambda w: upper(w[1:1]) || w[2:]), ' ')")


def _has(x, words):
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"


def _num(x, p):
    return f"CASE WHEN regexp_matches({x}, '{p}') THEN CAST(regexp_extract({x}, '{p}', 1) AS DOUBLE) END"


_P = {"pct": M.PCT, "req": M.REQUESTS, "inc": M.INCREASE, "cnt": M.COUNT, "num": M.NUMBER}


def _cat_sql(x):
    parts = []
    for p in M.CATEGORY_PATTERNS:
        c = f"regexp_replace(trim(regexp_extract({x}, '{p}', 1)), '{M.CATEGORY_TAIL}', '', 'g')"
        parts.append(f"WHEN regexp_matches({x}, '{p}') AND length({c}) > 3 THEN {c}")
    return "CASE " + " ".join(parts) + " END"


def _type_sql(x):
    return ("CASE " + " ".join(f"WHEN {_has(x, ws)} THEN '{n}'" for n, ws in M.TYPE_KEYWORDS)
            + " ELSE 'unknown' END")


def _trend_sql(x):
    return ("CASE " + " ".join(f"WHEN {_has(x, ws)} THEN '{n}'" for n, ws in M.TREND_KEYWORDS)
            + f" WHEN contains({x}, '+') THEN 'up' WHEN contains({x}, '-') AND NOT starts_with({x}, '-') "
            "THEN 'down' END")


_MS = with_requests(f"""
w AS (SELECT service_level_1 AS c,
             count(*) FILTER (WHERE date_created >= {NOW} - INTERVAL 30 DAY) AS r,
             count(*) FILTER (WHERE date_created >= {NOW} - INTERVAL 60 DAY
                               AND date_created < {NOW} - INTERVAL 30 DAY) AS p
      FROM requests WHERE service_level_1 IS NOT NULL AND date_created >= {NOW} - INTERVAL 60 DAY GROUP BY 1),
t AS (SELECT {_initcap('c')} AS cat, r, p,
             CASE WHEN p > 0 THEN round_even((r - p) / p * 100.0, 1) WHEN r > 0 THEN 100.0 ELSE 0.0 END AS g FROM w),
ms AS (SELECT CAST(g AS VARCHAR) || '% growth in ' || cat AS metric, 1 AS _row FROM t
       UNION ALL SELECT CAST(r - p AS VARCHAR) || ' requests increase in ' || cat, 2 FROM t
       UNION ALL SELECT CAST(r AS VARCHAR) || ' recent requests in ' || cat, 3 FROM t),
pm0 AS (SELECT metric, _row, {_num('metric', _P['pct'])} AS pct, {_num('metric', _P['req'])} AS req,
               {_num('metric', _P['inc'])} AS inc, {_num('metric', _P['cnt'])} AS cnt,
               {_num('metric', _P['num'])} AS num FROM ms),
pm AS (SELECT metric, _row, coalesce(pct, req, inc, cnt, num) AS value,
              CASE WHEN pct IS NOT NULL THEN '%' WHEN req IS NOT NULL THEN 'requests'
                   WHEN inc IS NOT NULL THEN CASE WHEN contains(lower(metric), 'request') THEN 'requests'
                                                  ELSE 'units' END
                   WHEN cnt IS NOT NULL THEN 'units' END AS unit,
              {_type_sql('metric')} AS metric_type, {_cat_sql('metric')} AS category,
              {_trend_sql('metric')} AS trend FROM pm0)""")


@register("met_parse", _MS + """
SELECT metric, value, unit, metric_type, category, trend,
       CASE WHEN metric_type = 'growth' THEN CASE WHEN value <> 0 THEN printf('%+.1f%% Growth', value) ELSE 'Growth Rate' END
            WHEN metric_type = 'volume' THEN CASE WHEN value <> 0 THEN CAST(CAST(value AS BIGINT) AS VARCHAR) || ' ' || coalesce(unit, 'Items') ELSE 'Volume' END
            WHEN metric_type = 'percentage' THEN CASE WHEN value <> 0 THEN printf('%.1f%%', value) ELSE 'Percentage' END
            ELSE 'Metric' END AS label
FROM pm""")
def q_met_parse(spark, sf_dir):
    """value/unit, type, category, trend and label of every metric string
    (``met_value``, ``met_type``, ``met_category``, ``met_trend``, ``met_label``)."""
    return parsed(spark, sf_dir).drop("_row")


@register("met_group", _MS + """
SELECT coalesce(metric_type, 'unknown') AS metric_type, count(*) AS n_metrics FROM pm GROUP BY 1""")
def q_met_group(spark, sf_dir):
    return M.group_by_type(parsed(spark, sf_dir))


@register("met_group_category", _MS + """
SELECT coalesce(category, 'Other') AS category, count(*) AS n_metrics FROM pm GROUP BY 1""")
def q_met_group_category(spark, sf_dir):
    return M.group_by_category(parsed(spark, sf_dir))


_RECON = _MS + """,
cm AS (SELECT category,
              max_by(value, CASE WHEN metric_type = 'growth' AND unit = '%' THEN _row END) AS growth,
              max_by(value, CASE WHEN contains(lower(metric), 'increase') THEN _row END) AS increase,
              max_by(value, CASE WHEN NOT contains(lower(metric), 'increase') AND contains(lower(metric), 'recent')
                                 THEN _row END) AS recent_volume
       FROM pm WHERE category IS NOT NULL AND value IS NOT NULL GROUP BY 1),
rc AS (SELECT *, round_even(CASE WHEN recent_volume IS NOT NULL AND increase IS NOT NULL THEN recent_volume - increase
                                 WHEN recent_volume IS NOT NULL AND growth IS NOT NULL
                                   THEN CASE WHEN growth <> 0 THEN recent_volume / (1.0 + growth / 100.0) ELSE recent_volume END
                                 WHEN increase IS NOT NULL AND growth IS NOT NULL
                                   THEN CASE WHEN growth <> 0 THEN increase / (growth / 100.0) ELSE 0.0 END END, 6)
                 AS original_value FROM cm),
gr AS (SELECT * FROM rc WHERE original_value IS NOT NULL AND growth IS NOT NULL
       ORDER BY abs(growth) DESC, category LIMIT 10)"""


@register("rep_growth_reconcile", _RECON + " SELECT * FROM gr")
def q_growth_reconcile(spark, sf_dir):
    return RP.growth_reconcile(parsed(spark, sf_dir))


@register("rep_growth_band", _RECON + """,
r2 AS (SELECT *, row_number() OVER (ORDER BY abs(growth) DESC, category) AS rk FROM gr),
a AS (SELECT max(growth) FILTER (WHERE rk = 1) AS top_growth, max(category) FILTER (WHERE rk = 1) AS top_category,
             max(growth) FILTER (WHERE rk = 2) AS second_growth, max(category) FILTER (WHERE rk = 2) AS second_category
      FROM r2 WHERE rk <= 2)
SELECT *, CASE WHEN abs(top_growth) > 75 THEN 'exceptional growth' WHEN abs(top_growth) > 50 THEN 'substantial growth'
               WHEN abs(top_growth) > 20 THEN 'moderate growth' ELSE 'notable changes' END AS growth_band,
          CASE WHEN second_growth IS NULL THEN NULL
               WHEN abs(top_growth) - abs(second_growth) > 30 THEN 'significantly higher'
               WHEN abs(top_growth) - abs(second_growth) > 15 THEN 'notably higher' ELSE 'somewhat higher' END AS gap_band
FROM a""")
def q_growth_band(spark, sf_dir):
    """``rep_growth_band`` and ``rep_growth_gap`` over the reconciled growth."""
    return RP.growth_bands(RP.growth_reconcile(parsed(spark, sf_dir)))


_VOL = _RECON + """,
vol AS (SELECT category, max_by(value, _row) AS volume FROM pm
        WHERE metric_type = 'volume' AND category IS NOT NULL AND value IS NOT NULL GROUP BY 1)"""


def _volumes(p):
    return (p.filter((F.col("metric_type") == "volume") & F.col("category").isNotNull()
                     & F.col("value").isNotNull())
             .groupBy("category").agg(F.max_by("value", "_row").alias("volume")))


@register("rep_share_band", _VOL + """,
sh AS (SELECT category, volume / sum(volume) OVER () * 100.0 AS share FROM vol)
SELECT category, round_even(share, 6) AS share,
       CASE WHEN share > 40 THEN 'a dominant share' WHEN share > 25 THEN 'a substantial share'
            ELSE 'a notable share' END AS share_band
FROM sh ORDER BY share DESC, category LIMIT 1""")
def q_share_band(spark, sf_dir):
    return RP.share_band(_volumes(parsed(spark, sf_dir)))


# Sentences on the last day against the day before: there growth passes 50 %.
_DAY_VOL = _VOL.replace("INTERVAL 30 DAY", "INTERVAL 1 DAY").replace("INTERVAL 60 DAY", "INTERVAL 2 DAY")


@register("rep_hot_and_big", _DAY_VOL + """
SELECT g.category, g.growth, coalesce(v.volume > 300, false) AS high_volume
FROM gr g LEFT JOIN vol v ON g.category = v.category WHERE abs(g.growth) > 50""")
def q_hot_and_big(spark, sf_dir):
    p = parsed(spark, sf_dir, days=1)
    return RP.hot_and_big(RP.growth_reconcile(p), _volumes(p))


@register("rep_positive_growth", _RECON + """
SELECT count(*) AS n_growth, count(*) FILTER (WHERE growth > 0) AS n_positive,
       count(*) >= 3 AND count(*) FILTER (WHERE growth > 0) >= 3 AS broad_positive FROM gr""")
def q_positive_growth(spark, sf_dir):
    return RP.positive_growth(RP.growth_reconcile(parsed(spark, sf_dir)))


@register("rep_top15", with_requests() + """,
pq AS (SELECT electoral_district AS "group", count(*) AS request_count FROM requests
       WHERE electoral_district IS NOT NULL GROUP BY 1),
t AS (SELECT * FROM pq ORDER BY request_count DESC, "group" LIMIT 15)
SELECT *, round_even(request_count / sum(request_count) OVER () * 100.0, 2) AS share_of_shown FROM t""")
def q_top15(spark, sf_dir):
    configure(spark)
    pq = (fact_requests(spark, sf_dir).filter(F.col(C.DISTRICT).isNotNull()).groupBy(F.col(C.DISTRICT).alias("group"))
          .agg(F.count(F.lit(1)).alias("request_count")))
    return RP.top15(pq, "request_count", "group")


@register("rep_backlog_l1", with_requests(f"""
s AS (SELECT *, CAST(floor((epoch_us({NOW}) - epoch_us(date_created)) / 86400000000.0) AS BIGINT) AS age
      FROM requests WHERE status_type = 'Unresolved'),
p AS (SELECT service_level_1, service_level_2, count(service_request_id) AS unresolved_count,
             round_even(avg(age), 6) AS avg_age_days
      FROM s WHERE service_level_1 IS NOT NULL AND service_level_2 IS NOT NULL GROUP BY 1, 2),
t AS (SELECT * FROM p ORDER BY unresolved_count DESC, avg_age_days DESC, service_level_1, service_level_2 LIMIT 15)""") + """
SELECT service_level_1, CAST(sum(unresolved_count) AS BIGINT) AS shown_unresolved FROM t GROUP BY 1""")
def q_backlog_l1(spark, sf_dir):
    configure(spark)
    return RP.backlog_top15_by_l1(B.backlog_ranked(fact_requests(spark, sf_dir),
                                                   as_of=latest_created(spark, sf_dir)))


@register("rep_last15", with_requests("""
lg AS (SELECT strftime(date_created, '%Y-%m') AS "Time", service_level_1, count(*) AS frequency
       FROM requests WHERE date_created IS NOT NULL AND service_level_1 IS NOT NULL GROUP BY 1, 2)""") + """
SELECT "Time",
       coalesce(CAST(sum(frequency) FILTER (service_level_1 = 'ECONOMY') AS BIGINT), 0) AS "ECONOMY",
       coalesce(CAST(sum(frequency) FILTER (service_level_1 = 'LARGE') AS BIGINT), 0) AS "LARGE",
       coalesce(CAST(sum(frequency) FILTER (service_level_1 = 'MEDIUM') AS BIGINT), 0) AS "MEDIUM",
       coalesce(CAST(sum(frequency) FILTER (service_level_1 = 'PROMO') AS BIGINT), 0) AS "PROMO",
       coalesce(CAST(sum(frequency) FILTER (service_level_1 = 'SMALL') AS BIGINT), 0) AS "SMALL",
       coalesce(CAST(sum(frequency) FILTER (service_level_1 NOT IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL'))
                AS BIGINT), 0) AS "Other"
FROM lg GROUP BY "Time" ORDER BY "Time" DESC LIMIT 15""")
def q_last15(spark, sf_dir):
    """Last 15 months of the frequency pivot: the first five category columns,
    and all other categories in one."""
    configure(spark)
    names = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")
    return RP.last_periods(FQ.frequency_pivot(fact_requests(spark, sf_dir), values=names), n_cols=len(names) + 1)


_BAND = ("CASE WHEN CAST(replace(pcts[i], '%', '') AS DOUBLE) > 50 THEN 'substantial growth' "
         "WHEN CAST(replace(pcts[i], '%', '') AS DOUBLE) > 20 THEN 'moderate growth' ELSE 'notable growth' END")


@register("rep_qualitative", """
WITH p AS (SELECT doc_id, regexp_extract_all(text, '\\d+\\.?\\d*%') AS pcts,
                  string_split_regex(text, '\\d+\\.?\\d*%') AS pieces FROM documents),
j AS (SELECT doc_id, pieces[1] || array_to_string(list_transform(generate_series(1, len(pcts)),
                                                   lambda i: """ + _BAND + """ || pieces[i + 1]), '') AS s FROM p),
r AS (SELECT doc_id, regexp_replace(regexp_replace(s, '\\d+ requests?', 'significant volume', 'g'),
                                    '\\d+', '', 'g') AS s FROM j)
SELECT doc_id, regexp_replace(trim(regexp_replace(trim(s), '\\s+', ' ', 'g')), '[,\\s]+\\.', '.', 'g')
       AS qualitative FROM r""")
def q_qualitative(spark, sf_dir):
    """Numbers turned into words in every document (whole texts)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select("doc_id", RP.qualitative("text").alias("qualitative"))


@register("met_grouped", _MS + """
SELECT coalesce(metric_type, 'unknown') AS metric_type, coalesce(category, 'Other') AS category, metric, value, unit
FROM pm""")
def q_met_grouped(spark, sf_dir):
    """The metrics themselves under their type and category."""
    return M.grouped(parsed(spark, sf_dir))


@register("agg_priority_top_volume", with_requests(f"""
pb AS (SELECT * FROM requests WHERE service_level_1 IS NOT NULL)""") + """
SELECT service_level_1 AS "group", count(*) AS request_count FROM pb GROUP BY 1
ORDER BY request_count DESC, "group" LIMIT 10""")
def q_priority_top_volume(spark, sf_dir):
    configure(spark)
    return P.priority_top(P.priority(fact_requests(spark, sf_dir)), "request_count").select("group", "request_count")


@register("met_value", _MS + " SELECT metric, value, unit FROM pm")
def q_met_value(spark, sf_dir):
    return parsed(spark, sf_dir).select("metric", "value", "unit")


@register("met_type", _MS + " SELECT metric, metric_type FROM pm")
def q_met_type(spark, sf_dir):
    return parsed(spark, sf_dir).select("metric", "metric_type")


@register("met_category", _MS + " SELECT metric, category FROM pm")
def q_met_category(spark, sf_dir):
    return parsed(spark, sf_dir).select("metric", "category")


@register("met_trend", _MS + " SELECT metric, trend FROM pm")
def q_met_trend(spark, sf_dir):
    return parsed(spark, sf_dir).select("metric", "trend")


@register("met_label", _MS + """
SELECT metric, CASE WHEN metric_type = 'growth' THEN CASE WHEN value <> 0 THEN printf('%+.1f%% Growth', value) ELSE 'Growth Rate' END
            WHEN metric_type = 'volume' THEN CASE WHEN value <> 0 THEN CAST(CAST(value AS BIGINT) AS VARCHAR) || ' ' || coalesce(unit, 'Items') ELSE 'Volume' END
            WHEN metric_type = 'percentage' THEN CASE WHEN value <> 0 THEN printf('%.1f%%', value) ELSE 'Percentage' END
            ELSE 'Metric' END AS label FROM pm""")
def q_met_label(spark, sf_dir):
    return parsed(spark, sf_dir).select("metric", "label")


@register("rep_growth_gap", _RECON + """,
r2 AS (SELECT *, row_number() OVER (ORDER BY abs(growth) DESC, category) AS rk FROM gr),
a AS (SELECT max(growth) FILTER (WHERE rk = 1) AS top_growth, max(category) FILTER (WHERE rk = 1) AS top_category,
             max(growth) FILTER (WHERE rk = 2) AS second_growth, max(category) FILTER (WHERE rk = 2) AS second_category
      FROM r2 WHERE rk <= 2)
SELECT top_category, second_category, abs(top_growth) - abs(second_growth) AS gap,
       CASE WHEN second_growth IS NULL THEN NULL
            WHEN abs(top_growth) - abs(second_growth) > 30 THEN 'significantly higher'
            WHEN abs(top_growth) - abs(second_growth) > 15 THEN 'notably higher' ELSE 'somewhat higher' END AS gap_band
FROM a""")
def q_growth_gap(spark, sf_dir):
    b = RP.growth_bands(RP.growth_reconcile(parsed(spark, sf_dir)))
    return b.select("top_category", "second_category",
                    (F.abs("top_growth") - F.abs("second_growth")).alias("gap"), "gap_band")
