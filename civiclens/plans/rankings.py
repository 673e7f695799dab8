"""Registered ranking queries (top-10 family) with their oracles."""

from __future__ import annotations

from civiclens.operators import rankings as R
from civiclens.plans.oracle import NOW, OPEN, SOLVED, days, with_requests
from civiclens.plans.registry import register
from civiclens.session import configure
from civiclens.sources.requests import fact_requests, latest_created


def _req(spark, sf_dir):
    configure(spark)
    return fact_requests(spark, sf_dir)


@register("top_volume", with_requests(f"""
g AS (SELECT service_level_1 AS category, count(*) AS volume FROM requests
      WHERE date_created >= {NOW} - INTERVAL 30 DAY AND service_level_1 IS NOT NULL
      GROUP BY 1)""") + """
SELECT category, volume, round_even(volume / sum(volume) OVER () * 100.0, 2) AS pct_of_total
FROM g ORDER BY volume DESC, category LIMIT 10""")
def q_top_volume(spark, sf_dir):
    return R.top_volume(_req(spark, sf_dir), as_of=latest_created(spark, sf_dir))


_CLOSED_DAYS = f"""
c AS (SELECT *, {days('date_closed', 'date_created')} AS d FROM requests WHERE {SOLVED}),
v AS (SELECT * FROM c WHERE d >= 0 AND service_level_1 IS NOT NULL)"""


@register("top_worst_p90", with_requests(_CLOSED_DAYS, """
s AS (SELECT service_level_1 AS category,
             round_even(quantile_cont(d, 0.9), 1) AS p90_days,
             round_even(median(d), 1) AS median_days,
             count(*) AS request_count
      FROM v GROUP BY 1 HAVING count(*) >= 10)""") + """
SELECT * FROM s ORDER BY p90_days DESC, category LIMIT 10""")
def q_top_worst_p90(spark, sf_dir):
    return R.top_worst_p90(_req(spark, sf_dir))


_AGE = f"""
a AS (SELECT *, CASE WHEN {OPEN} THEN {days(NOW, 'date_created')}
                     ELSE {days('date_closed', 'date_created')} END AS age FROM requests
      WHERE service_level_1 IS NOT NULL)"""


@register("top_backlog_age", with_requests(_AGE, f"""
s AS (SELECT service_level_1 AS category,
             round_even(quantile_cont(age, 0.9) FILTER (WHERE age >= 0), 1) AS p90_age_days,
             round_even(avg(age) FILTER (WHERE age >= 0), 1) AS avg_age_days,
             count(*) FILTER (WHERE {OPEN}) AS open_count,
             count(*) FILTER (WHERE age >= 0) AS total_count
      FROM a GROUP BY 1 HAVING count(*) FILTER (WHERE age >= 0) >= 10)""") + """
SELECT * FROM s ORDER BY p90_age_days DESC, category LIMIT 10""")
def q_top_backlog_age(spark, sf_dir):
    return R.top_backlog_age(_req(spark, sf_dir), as_of=latest_created(spark, sf_dir))


_TREND = f"""
w AS (SELECT service_level_1 AS category,
             count(*) FILTER (WHERE date_created >= {NOW} - INTERVAL 30 DAY) AS recent_volume,
             count(*) FILTER (WHERE date_created >= {NOW} - INTERVAL 60 DAY
                               AND date_created < {NOW} - INTERVAL 30 DAY) AS previous_volume
      FROM requests
      WHERE service_level_1 IS NOT NULL AND date_created >= {NOW} - INTERVAL 60 DAY
      GROUP BY 1),
t AS (SELECT category, recent_volume, previous_volume,
             CASE WHEN previous_volume > 0
                  THEN round_even((recent_volume - previous_volume) / previous_volume * 100.0, 1)
                  WHEN recent_volume > 0 THEN 100.0 ELSE 0.0 END AS growth_rate,
             recent_volume - previous_volume AS absolute_change
      FROM w)"""


@register("top_trending", with_requests(_TREND) + """
SELECT * FROM t WHERE previous_volume >= 5 ORDER BY absolute_change DESC, category LIMIT 10""")
def q_top_trending(spark, sf_dir):
    return R.top_trending(_req(spark, sf_dir), as_of=latest_created(spark, sf_dir))


@register("jn_trend_outer", with_requests(f"""
r AS (SELECT service_level_1 AS category, count(*) AS recent_volume FROM requests
      WHERE date_created >= {NOW} - INTERVAL 30 DAY AND service_level_1 IS NOT NULL GROUP BY 1),
p AS (SELECT service_level_1 AS category, count(*) AS previous_volume FROM requests
      WHERE date_created >= {NOW} - INTERVAL 60 DAY AND date_created < {NOW} - INTERVAL 30 DAY
        AND service_level_1 IS NOT NULL GROUP BY 1)""") + """
SELECT coalesce(r.category, p.category) AS category,
       coalesce(recent_volume, 0) AS recent_volume, coalesce(previous_volume, 0) AS previous_volume
FROM r FULL OUTER JOIN p ON r.category = p.category""")
def q_jn_trend_outer(spark, sf_dir):
    """Single-pass conditional counts; the oracle is the two-count outer join."""
    return R.trending_counts(_req(spark, sf_dir), as_of=latest_created(spark, sf_dir)).withColumnRenamed(
        "service_level_1", "category")


_HOT = f"""
rc AS (SELECT neighbourhood, service_level_1 FROM requests
       WHERE date_created >= {NOW} - INTERVAL 30 DAY AND neighbourhood IS NOT NULL),
vol AS (SELECT neighbourhood, count(*) AS volume FROM rc GROUP BY 1),
pc AS (SELECT neighbourhood, service_level_1, count(*) AS n FROM rc
       WHERE service_level_1 IS NOT NULL GROUP BY 1, 2),
tc AS (SELECT neighbourhood, service_level_1 AS top_category FROM (
         SELECT *, row_number() OVER (PARTITION BY neighbourhood
                                      ORDER BY n DESC, service_level_1) AS rk FROM pc) WHERE rk = 1),
hot AS (SELECT v.neighbourhood, v.volume,
               round_even(v.volume / sum(v.volume) OVER () * 100.0, 2) AS pct_of_total,
               coalesce(tc.top_category, 'N/A') AS top_category
        FROM vol v LEFT JOIN tc ON v.neighbourhood = tc.neighbourhood)"""


@register("top_geo_hotspots", with_requests(_HOT) + """
SELECT * FROM hot ORDER BY volume DESC, neighbourhood LIMIT 10""")
def q_top_geo_hotspots(spark, sf_dir):
    return R.top_geo_hotspots(_req(spark, sf_dir), as_of=latest_created(spark, sf_dir))


_COMBINED = with_requests(
    """g0 AS (SELECT service_level_1 AS category, count(*) AS volume FROM requests
      WHERE date_created >= """ + NOW + """ - INTERVAL 30 DAY AND service_level_1 IS NOT NULL
      GROUP BY 1),
topvol AS (SELECT category, volume, round_even(volume / sum(volume) OVER () * 100.0, 2) AS pct
        FROM g0 ORDER BY volume DESC, category LIMIT 10)""",
    _CLOSED_DAYS,
    """p90 AS (SELECT service_level_1 AS category, round_even(quantile_cont(d, 0.9), 1) AS p90_days,
               round_even(median(d), 1) AS median_days, count(*) AS request_count
        FROM v GROUP BY 1 HAVING count(*) >= 10 ORDER BY p90_days DESC, category LIMIT 10)""",
    _AGE,
    f"""back AS (SELECT service_level_1 AS category,
             round_even(quantile_cont(age, 0.9) FILTER (WHERE age >= 0), 1) AS p90_age_days,
             round_even(avg(age) FILTER (WHERE age >= 0), 1) AS avg_age_days,
             count(*) FILTER (WHERE {OPEN}) AS open_count
      FROM a GROUP BY 1 HAVING count(*) FILTER (WHERE age >= 0) >= 10
      ORDER BY p90_age_days DESC, category LIMIT 10)""",
    _TREND,
    """tr AS (SELECT * FROM t WHERE previous_volume >= 5 ORDER BY absolute_change DESC, category LIMIT 10)""",
    _HOT,
    """geo AS (SELECT * FROM hot ORDER BY volume DESC, neighbourhood LIMIT 10)""")


@register("top_combined", _COMBINED + """
SELECT 'Volume (Last 30 Days)' AS ranking_type,
       row_number() OVER (ORDER BY volume DESC, category) AS rank, category,
       CAST(volume AS DOUBLE) AS primary_metric, 'volume' AS primary_metric_name,
       CAST(pct AS DOUBLE) AS secondary_metric, 'pct_of_total' AS secondary_metric_name,
       CAST(NULL AS DOUBLE) AS tertiary_metric, CAST(NULL AS VARCHAR) AS tertiary_metric_name FROM topvol
UNION ALL
SELECT 'Worst P90 Time-to-Close', row_number() OVER (ORDER BY p90_days DESC, category), category,
       p90_days, 'p90_days', median_days, 'median_days', CAST(request_count AS DOUBLE), 'request_count'
FROM p90
UNION ALL
SELECT 'Backlog Age', row_number() OVER (ORDER BY p90_age_days DESC, category), category,
       p90_age_days, 'p90_age_days', avg_age_days, 'avg_age_days', CAST(open_count AS DOUBLE), 'open_count'
FROM back
UNION ALL
SELECT 'Trending Up', row_number() OVER (ORDER BY absolute_change DESC, category), category,
       CAST(absolute_change AS DOUBLE), 'absolute_change', growth_rate, 'growth_rate',
       CAST(recent_volume AS DOUBLE), 'recent_volume'
FROM tr
UNION ALL
SELECT 'Geographic Hotspots', row_number() OVER (ORDER BY volume DESC, neighbourhood), neighbourhood,
       CAST(volume AS DOUBLE), 'volume', pct_of_total, 'pct_of_total', CAST(NULL AS DOUBLE),
       'top_category: ' || top_category
FROM geo""")
def q_top_combined(spark, sf_dir):
    """No shared cache: with a literal as-of, the volume, trending and
    hotspot rankings each read only the newest months (pushed-down bound),
    and the two all-rows rankings read two or three columns; caching would
    force every row of the table into memory."""
    return R.top_combined(_req(spark, sf_dir), as_of=latest_created(spark, sf_dir))
