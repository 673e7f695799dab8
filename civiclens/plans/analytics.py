"""Registered backlog / closing / FCR / frequency / geo / priority queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiclens.functions import columns as C
from civiclens.operators import backlog as B
from civiclens.operators import closing as CL
from civiclens.operators import fcr as FC
from civiclens.operators import frequency as FQ
from civiclens.operators import geo as G
from civiclens.operators import priority as P
from civiclens.plans.oracle import NOW, OPEN, SOLVED, days, with_requests
from civiclens.plans.registry import register
from civiclens.session import configure
from civiclens.sources.requests import fact_requests, latest_created
from civiclens.sources.tables import read_table


def _req(spark, sf_dir):
    configure(spark)
    return fact_requests(spark, sf_dir)


# ---------------------------------------------------------------- backlog
_UNRES = f"""
u AS (SELECT *, {days(NOW, 'date_created')} AS age FROM requests
      WHERE {OPEN} OR date_closed IS NULL)"""

_AGE_BIN = """CASE WHEN age >= 0 AND age < 7 THEN 0 WHEN age >= 7 AND age < 14 THEN 1
  WHEN age >= 14 AND age < 30 THEN 2 WHEN age >= 30 AND age < 60 THEN 3
  WHEN age >= 60 AND age < 90 THEN 4 WHEN age >= 90 AND age < 180 THEN 5
  WHEN age >= 180 AND age < 365 THEN 6 WHEN age >= 365 AND age < 730 THEN 7
  WHEN age >= 730 THEN 8 END"""


@register("agg_backlog_hist", with_requests(_UNRES, f"""
b AS (SELECT {_AGE_BIN} AS o, service_level_1 FROM u WHERE service_level_1 IS NOT NULL)""") + """
SELECT ['0-7 days', '8-14 days', '15-30 days', '31-60 days', '61-90 days', '91-180 days',
        '181-365 days', '1-2 years', '2+ years'][o + 1] AS age_bin, service_level_1, count(*) AS count
FROM b WHERE o IS NOT NULL GROUP BY o, service_level_1""")
def q_backlog_hist(spark, sf_dir):
    return B.backlog_hist(_req(spark, sf_dir), as_of=latest_created(spark, sf_dir))


@register("agg_backlog_level1", with_requests(_UNRES) + """
SELECT service_level_1, count(age) AS total_unresolved,
       round_even(avg(age), 1) AS avg_age_days, round_even(median(age), 1) AS median_age_days,
       max(age) AS max_age_days, count(*) FILTER (WHERE age > 90) AS over_90_days,
       round_even(count(*) FILTER (WHERE age > 90) / count(age) * 100.0, 2) AS pct_over_90_days
FROM u WHERE service_level_1 IS NOT NULL GROUP BY 1""")
def q_backlog_level1(spark, sf_dir):
    return B.backlog_level1(_req(spark, sf_dir), as_of=latest_created(spark, sf_dir))


_STRICT = f"""
s AS (SELECT *, {days(NOW, 'date_created')} AS age FROM requests WHERE status_type = 'Unresolved')"""


@register("agg_backlog_ranked", with_requests(_STRICT, """
p AS (SELECT service_level_1, service_level_2, count(service_request_id) AS unresolved_count,
             round_even(avg(age), 6) AS avg_age_days
      FROM s WHERE service_level_1 IS NOT NULL AND service_level_2 IS NOT NULL GROUP BY 1, 2)""") + """
SELECT *, CAST(sum(unresolved_count) OVER (PARTITION BY service_level_1) AS BIGINT) AS level1_total FROM p""")
def q_backlog_ranked(spark, sf_dir):
    return B.backlog_ranked(_req(spark, sf_dir), as_of=latest_created(spark, sf_dir))


@register("jn_total_lookup", with_requests(_STRICT, """
p AS (SELECT service_level_1, service_level_2, count(service_request_id) AS unresolved_count
      FROM s WHERE service_level_1 IS NOT NULL AND service_level_2 IS NOT NULL GROUP BY 1, 2),
t AS (SELECT service_level_1, CAST(sum(unresolved_count) AS BIGINT) AS level1_total FROM p GROUP BY 1)""") + """
SELECT p.service_level_1, p.service_level_2, p.unresolved_count, t.level1_total
FROM p JOIN t ON p.service_level_1 = t.service_level_1""")
def q_total_lookup(spark, sf_dir):
    """Group total mapped back onto the pairs by a partitioned window; the
    oracle uses the reference's join form."""
    return B.backlog_ranked(_req(spark, sf_dir), as_of=latest_created(spark, sf_dir)).select(
        C.LEVEL1, C.LEVEL2, "unresolved_count", "level1_total")


@register("agg_backlog_ranked_l1", with_requests(_STRICT) + """
SELECT service_level_1, count(service_request_id) AS unresolved_count,
       round_even(avg(age), 6) AS avg_age_days
FROM s WHERE service_level_1 IS NOT NULL GROUP BY 1""")
def q_backlog_ranked_l1(spark, sf_dir):
    return B.backlog_ranked_l1(_req(spark, sf_dir), as_of=latest_created(spark, sf_dir))


@register("agg_backlog_rollup", with_requests(_STRICT) + """
SELECT service_level_1, service_level_2, CAST(grouping(service_level_1, service_level_2) AS BIGINT) AS grouping_level,
       count(service_request_id) AS unresolved_count, round_even(avg(age), 6) AS avg_age_days
FROM s WHERE service_level_1 IS NOT NULL AND service_level_2 IS NOT NULL
GROUP BY ROLLUP (service_level_1, service_level_2)""")
def q_backlog_rollup(spark, sf_dir):
    return B.backlog_rollup(_req(spark, sf_dir), as_of=latest_created(spark, sf_dir))


@register("agg_backlog_totals", with_requests(_STRICT) + """
SELECT count(*) AS total_unresolved, count(DISTINCT service_level_1) AS n_level1,
       count(DISTINCT service_level_2) AS n_level2, round_even(avg(age), 6) AS avg_age_days,
       max(age) AS oldest_age_days, min(age) AS newest_age_days FROM s""")
def q_backlog_totals(spark, sf_dir):
    return B.backlog_totals(_req(spark, sf_dir), as_of=latest_created(spark, sf_dir))


@register("agg_age_stats", with_requests(_UNRES) + """
SELECT min(age) AS min_age_days, max(age) AS max_age_days, round_even(avg(age), 6) AS avg_age_days,
       round_even(median(age), 6) AS median_age_days FROM u""")
def q_age_stats(spark, sf_dir):
    return B.age_stats(_req(spark, sf_dir), as_of=latest_created(spark, sf_dir))


@register("agg_status_counts", with_requests() + """
SELECT status_type, count(*) AS count FROM requests WHERE status_type IS NOT NULL GROUP BY 1""")
def q_status_counts(spark, sf_dir):
    return B.status_counts(_req(spark, sf_dir))


# ---------------------------------------------------------------- closing
_CLOSED = f"""
cl AS (SELECT *, {days('date_closed', 'date_created')} AS t FROM requests
       WHERE status_type = 'Solved' AND date_closed IS NOT NULL),
v AS (SELECT * FROM cl WHERE t >= 0 AND service_level_1 IS NOT NULL)"""
_CLOSE_BIN = """CASE WHEN t < 1 THEN '0 days' WHEN t < 3 THEN '1-2 days' WHEN t < 8 THEN '3-7 days'
  WHEN t < 31 THEN '8-30 days' WHEN t < 91 THEN '31-90 days' ELSE '90+ days' END"""
_PCT = """
pc AS (SELECT service_level_1, count(t) AS count, round_even(quantile_cont(t, 0.5), 1) AS median,
              round_even(quantile_cont(t, 0.75), 1) AS p75, round_even(quantile_cont(t, 0.9), 1) AS p90,
              round_even(avg(t), 1) AS mean, min(t) AS min, max(t) AS max
       FROM v GROUP BY 1)"""


@register("agg_close_hist", with_requests(_CLOSED) + f"""
SELECT service_level_1, {_CLOSE_BIN} AS time_bin, count(*) AS count FROM v GROUP BY 1, 2""")
def q_close_hist(spark, sf_dir):
    return CL.close_hist(_req(spark, sf_dir))


@register("agg_close_percentiles", with_requests(_CLOSED, _PCT) + "SELECT * FROM pc")
def q_close_percentiles(spark, sf_dir):
    return CL.close_percentiles(_req(spark, sf_dir))


@register("agg_close_product", with_requests(_CLOSED, _PCT, f"""
h AS (SELECT service_level_1, {_CLOSE_BIN} AS time_bin, count(*) AS bin_count FROM v GROUP BY 1, 2)""") + """
SELECT h.service_level_1, h.time_bin, h.bin_count, pc.count AS total_count, pc.median, pc.p75, pc.p90,
       pc.mean, pc.min, pc.max
FROM h LEFT JOIN pc ON h.service_level_1 = pc.service_level_1""")
def q_close_product(spark, sf_dir):
    return CL.close_product(_req(spark, sf_dir))


@register("jn_hist_percentiles", with_requests(_CLOSED, _PCT, f"""
h AS (SELECT service_level_1, {_CLOSE_BIN} AS time_bin, count(*) AS bin_count FROM v GROUP BY 1, 2)""") + """
SELECT h.service_level_1, h.time_bin, h.bin_count, pc.count AS total_count, pc.median, pc.p75, pc.p90,
       pc.mean, pc.min, pc.max
FROM h LEFT JOIN pc ON h.service_level_1 = pc.service_level_1""")
def q_hist_percentiles(spark, sf_dir):
    """The same product built from the closed rows and their durations."""
    return CL.close_product(CL.closed_with_days(_req(spark, sf_dir)))


@register("agg_close_overall", with_requests(_CLOSED) + """
SELECT count(t) AS total_closed, round_even(median(t), 1) AS median_days,
       round_even(quantile_cont(t, 0.9), 1) AS p90_days FROM cl WHERE t >= 0""")
def q_close_overall(spark, sf_dir):
    return CL.close_overall(_req(spark, sf_dir))


@register("agg_close_gaps", with_requests(_CLOSED, _PCT) + """
SELECT service_level_1, median, p90, round_even(p90 - median, 1) AS gap FROM pc
ORDER BY gap DESC, service_level_1 LIMIT 5""")
def q_close_gaps(spark, sf_dir):
    return CL.close_gaps(_req(spark, sf_dir))


@register("flt_closed", with_requests() + """
SELECT service_request_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, service_level_1
FROM requests WHERE status_type = 'Solved' AND date_closed IS NOT NULL""")
def q_flt_closed(spark, sf_dir):
    from civiclens.functions.predicates import is_closed
    return _req(spark, sf_dir).filter(is_closed()).select(
        C.REQUEST_ID, *C.ROW_ORDER, C.LEVEL1)


@register("prj_days_to_close", with_requests(_CLOSED) + """
SELECT service_request_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, t AS time_to_close_days
FROM cl WHERE t >= 0""")
def q_days_to_close(spark, sf_dir):
    return CL.closed_with_days(_req(spark, sf_dir)).select(
        C.REQUEST_ID, *C.ROW_ORDER, "time_to_close_days")


# ---------------------------------------------------------------- FCR
_FCR = """
f AS (SELECT service_level_1 AS category,
             count(*) FILTER (WHERE first_call_resolution = 'Yes') AS fcr_yes,
             count(*) FILTER (WHERE first_call_resolution = 'No') AS fcr_no
      FROM requests WHERE service_level_1 IS NOT NULL AND first_call_resolution IS NOT NULL GROUP BY 1),
fr AS (SELECT category, fcr_yes, fcr_no, fcr_yes + fcr_no AS total_requests,
              round_even(CASE WHEN fcr_yes + fcr_no > 0 THEN fcr_yes / (fcr_yes + fcr_no) END * 100.0, 2)
              AS fcr_rate FROM f)"""


@register("agg_fcr", with_requests(_FCR) + "SELECT * FROM fr")
def q_fcr(spark, sf_dir):
    return FC.fcr_rate(_req(spark, sf_dir))


@register("agg_fcr_pivot", with_requests() + """
SELECT service_level_1 AS category,
       count(*) FILTER (WHERE first_call_resolution = 'Yes') AS fcr_yes,
       count(*) FILTER (WHERE first_call_resolution = 'No') AS fcr_no
FROM requests WHERE service_level_1 IS NOT NULL AND first_call_resolution IS NOT NULL GROUP BY 1""")
def q_fcr_pivot(spark, sf_dir):
    return FC.fcr_pivot(_req(spark, sf_dir))


@register("agg_fcr_overall", with_requests(_FCR, """
o AS (SELECT sum(fcr_yes) / sum(total_requests) * 100.0 AS ov FROM fr)""") + """
SELECT round_even(max(o.ov), 6) AS overall_fcr_rate, count(*) AS n_categories,
       count(*) FILTER (WHERE fcr_rate < o.ov) AS n_below,
       round_even(count(*) FILTER (WHERE fcr_rate < o.ov) / count(*) * 100.0, 1) AS pct_categories_below,
       round_even(sum(CASE WHEN fcr_rate < o.ov THEN total_requests ELSE 0 END) / sum(total_requests) * 100.0, 1)
         AS pct_requests_below
FROM fr, o""")
def q_fcr_overall(spark, sf_dir):
    return FC.fcr_overall(FC.fcr_rate(_req(spark, sf_dir)))


# ---------------------------------------------------------------- frequency
_LONG = """
lg AS (SELECT strftime(date_created, '%Y-%m') AS "Time", service_level_1, count(*) AS frequency
       FROM requests WHERE date_created IS NOT NULL AND service_level_1 IS NOT NULL GROUP BY 1, 2)"""


# The level-1 categories of the test tables, as pivot columns.
PIVOT_VALUES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
PIVOT_SQL = ", ".join(
    f"""coalesce(CAST(sum(frequency) FILTER (service_level_1 = '{v}') AS BIGINT), 0) AS "{v}\"""" for v in PIVOT_VALUES)
PIVOT_SQL += f""", coalesce(CAST(sum(frequency) FILTER (service_level_1 NOT IN {PIVOT_VALUES}) AS BIGINT), 0) AS "Other\""""


@register("agg_frequency_long", with_requests(_LONG) + "SELECT * FROM lg")
def q_frequency_long(spark, sf_dir):
    return FQ.frequency_long(_req(spark, sf_dir))


@register("agg_frequency_pivot", with_requests(_LONG) + """
SELECT "Time", """ + PIVOT_SQL + ' FROM lg GROUP BY "Time"')
def q_frequency_pivot(spark, sf_dir):
    return FQ.frequency_pivot(_req(spark, sf_dir), values=PIVOT_VALUES)


@register("agg_frequency_stats", with_requests(_LONG, """
m AS (SELECT count(DISTINCT "Time") AS n FROM lg)""") + """
SELECT service_level_1, round_even(sum(frequency) / max(m.n), 2) AS mean_frequency,
       CASE WHEN count(*) < max(m.n) THEN 0 ELSE min(frequency) END AS min_frequency,
       max(frequency) AS max_frequency, CAST(sum(frequency) AS BIGINT) AS total_requests
FROM lg, m GROUP BY 1""")
def q_frequency_stats(spark, sf_dir):
    return FQ.frequency_stats(_req(spark, sf_dir))


_SEAS = """
sc AS (SELECT coalesce(service_level_1, service_type) AS service_category,
              year(date_created) AS y, month(date_created) AS month, count(*) AS n
       FROM requests WHERE date_created IS NOT NULL AND coalesce(service_level_1, service_type) IS NOT NULL
       GROUP BY 1, 2, 3),
sl AS (SELECT service_category, month, round_even(avg(n), 6) AS avg_requests FROM sc GROUP BY 1, 2),
sw AS (SELECT service_category,
   coalesce(max(avg_requests) FILTER (WHERE month = 1), 0.0) AS "January",
   coalesce(max(avg_requests) FILTER (WHERE month = 2), 0.0) AS "February",
   coalesce(max(avg_requests) FILTER (WHERE month = 3), 0.0) AS "March",
   coalesce(max(avg_requests) FILTER (WHERE month = 4), 0.0) AS "April",
   coalesce(max(avg_requests) FILTER (WHERE month = 5), 0.0) AS "May",
   coalesce(max(avg_requests) FILTER (WHERE month = 6), 0.0) AS "June",
   coalesce(max(avg_requests) FILTER (WHERE month = 7), 0.0) AS "July",
   coalesce(max(avg_requests) FILTER (WHERE month = 8), 0.0) AS "August",
   coalesce(max(avg_requests) FILTER (WHERE month = 9), 0.0) AS "September",
   coalesce(max(avg_requests) FILTER (WHERE month = 10), 0.0) AS "October",
   coalesce(max(avg_requests) FILTER (WHERE month = 11), 0.0) AS "November",
   coalesce(max(avg_requests) FILTER (WHERE month = 12), 0.0) AS "December"
   FROM sl GROUP BY 1)"""


@register("agg_seasonality", with_requests(_SEAS) + "SELECT * FROM sw")
def q_seasonality(spark, sf_dir):
    return FQ.seasonality(_req(spark, sf_dir))


@register("agg_seasonality_peaks", with_requests(_SEAS, """
tot AS (SELECT *, "January" + "February" + "March" + "April" + "May" + "June" + "July" + "August"
                  + "September" + "October" + "November" + "December" AS total FROM sw),
top15 AS (SELECT * FROM tot ORDER BY total DESC, service_category LIMIT 15),
lo AS (UNPIVOT top15 ON "January", "February", "March", "April", "May", "June", "July", "August",
       "September", "October", "November", "December" INTO NAME month_name VALUE v),
lm AS (SELECT service_category, month_name, v,
              list_position(['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August',
                             'September', 'October', 'November', 'December'], month_name) AS m FROM lo),
agg AS (SELECT service_category, arg_max(month_name, (v, -m)) AS peak_month, max(v) AS pk,
               arg_min(month_name, (v, m)) AS low_month, min(v) AS lw FROM lm GROUP BY 1)""") + """
SELECT service_category, peak_month, round_even(pk, 1) AS peak_avg, low_month, round_even(lw, 1) AS low_avg,
       CASE WHEN lw > 0 THEN round_even(pk / lw, 2) END AS seasonality_ratio
FROM agg WHERE pk > 0""")
def q_seasonality_peaks(spark, sf_dir):
    return FQ.seasonality_peaks(_req(spark, sf_dir))


@register("agg_latest_share", with_requests(_LONG) + """
SELECT "Time", service_level_1, frequency AS value,
       round_even(frequency / sum(frequency) OVER () * 100.0, 1) AS share_pct,
       CAST(floor(frequency / sum(frequency) OVER () * 100.0 + 0.5) AS BIGINT) AS share_pct_whole,
       row_number() OVER (ORDER BY frequency DESC, service_level_1) = 1 AS is_top
FROM lg WHERE "Time" = (SELECT max("Time") FROM lg)""")
def q_latest_share(spark, sf_dir):
    return FQ.latest_share(_req(spark, sf_dir))


@register("agg_period_change", with_requests(_LONG, """
ms AS (SELECT "Time", lag("Time") OVER (ORDER BY "Time") AS prev FROM (SELECT DISTINCT "Time" FROM lg))""") + """
SELECT c."Time", c.service_level_1, c.frequency AS value,
       CASE WHEN ms.prev IS NOT NULL THEN coalesce(p.frequency, 0) END AS previous_value,
       round_even(CASE WHEN ms.prev IS NOT NULL AND coalesce(p.frequency, 0) <> 0
                       THEN (c.frequency - coalesce(p.frequency, 0)) / coalesce(p.frequency, 0) END * 100.0, 1)
         AS pct_change
FROM lg c JOIN ms ON c."Time" = ms."Time"
LEFT JOIN lg p ON p."Time" = ms.prev AND p.service_level_1 = c.service_level_1""")
def q_period_change(spark, sf_dir):
    return FQ.period_change(_req(spark, sf_dir))


# ---------------------------------------------------------------- geo
_GEO = f"""
gm AS (SELECT electoral_district, count(*) AS volume, count(*) FILTER (WHERE {OPEN}) AS unresolved,
              round_even(quantile_cont(CASE WHEN {SOLVED} AND {days('date_closed', 'date_created')} >= 0
                                       THEN {days('date_closed', 'date_created')} END, 0.9), 6) AS slow_p90
       FROM requests WHERE electoral_district IS NOT NULL GROUP BY 1)"""


@register("agg_geo_metrics", with_requests(_GEO) + "SELECT * FROM gm")
def q_geo_metrics(spark, sf_dir):
    return G.geo_metrics(_req(spark, sf_dir))


def _stats_sql(c):
    return (f"round_even(avg({c}), 6) AS mean_{c}, round_even(median({c}), 6) AS median_{c}, "
            f"max({c}) AS max_{c}, min({c}) AS min_{c}")


@register("agg_geo_summary", with_requests(_GEO) + f"""
SELECT count(*) AS n_districts, {_stats_sql('volume')}, {_stats_sql('unresolved')}, {_stats_sql('slow_p90')},
       arg_min(electoral_district, (-volume, electoral_district)) AS busiest_district,
       arg_min(electoral_district, (volume, electoral_district)) AS quietest_district
FROM gm""")
def q_geo_summary(spark, sf_dir):
    return G.geo_summary(G.geo_metrics(_req(spark, sf_dir)))


@register("agg_geo_top_unresolved", with_requests(_GEO) + """
SELECT *, round_even((volume - unresolved) / volume * 100.0, 1) AS resolution_rate FROM gm
ORDER BY unresolved DESC, electoral_district LIMIT 5""")
def q_geo_top_unresolved(spark, sf_dir):
    return G.geo_top5(G.geo_metrics(_req(spark, sf_dir)), "unresolved")


@register("jn_geo_enrich", with_requests(_GEO, """
feat AS (SELECT n_nationkey AS feature_idx,
                CASE WHEN n_regionkey = 0 THEN '' ELSE n_name END AS k1,
                CASE WHEN n_regionkey = 1 THEN NULL ELSE n_name END AS k2 FROM nation)""") + """
SELECT CAST(f.feature_idx AS BIGINT) AS feature_idx, coalesce(nullif(f.k1, ''), nullif(f.k2, '')) AS district,
       CAST(g.volume AS INTEGER) AS volume, CAST(g.unresolved AS INTEGER) AS unresolved,
       CAST(g.slow_p90 AS DOUBLE) AS slow_p90,
       coalesce(nullif(f.k1, ''), nullif(f.k2, '')) IS NOT NULL AS has_district,
       g.volume IS NOT NULL AS updated
FROM feat f LEFT JOIN gm g ON g.electoral_district = coalesce(nullif(f.k1, ''), nullif(f.k2, ''))""")
def q_geo_enrich(spark, sf_dir):
    """Features derived from the nation table: the district sits under one of
    two property names, sometimes blank, so the lookup order matters."""
    req = _req(spark, sf_dir)
    nation = read_table(spark, sf_dir, "nation")
    props = F.map_from_arrays(
        F.array(F.lit("Electoral District"), F.lit("electoral_district")),
        F.array(F.when(F.col("n_regionkey") == 0, F.lit("")).otherwise(F.col("n_name")),
                F.when(F.col("n_regionkey") == 1, F.lit(None)).otherwise(F.col("n_name"))))
    features = nation.select(F.col("n_nationkey").cast("long").alias("feature_idx"),
                             props.alias("properties"), F.lit(None).cast("string").alias("geometry"))
    out = G.enrich_features(features, G.geo_metrics(req))
    return out.drop("properties", "geometry")


# ---------------------------------------------------------------- priority
_PRIO = f"""
pb AS (SELECT * FROM requests WHERE service_level_1 IS NOT NULL),
pq AS (SELECT service_level_1 AS "group", count(*) AS request_count,
              round_even(quantile_cont(CASE WHEN {SOLVED} AND {days('date_closed', 'date_created')} >= 0
                                       THEN {days('date_closed', 'date_created')} END, 0.9), 6) AS time_to_close_days,
              count(*) FILTER (WHERE {OPEN}) AS open_count,
              count(*) FILTER (WHERE date_created >= (SELECT max(date_created) FROM pb) - INTERVAL 30 DAY)
                AS recent_volume,
              count(CASE WHEN {SOLVED} AND {days('date_closed', 'date_created')} >= 0 THEN 1 END) AS closed_count
       FROM pb GROUP BY 1)"""


@register("agg_priority", with_requests(_PRIO) + """
SELECT "group", request_count, time_to_close_days, open_count, recent_volume,
       recent_volume AS bubble_size, closed_count FROM pq""")
def q_priority(spark, sf_dir):
    return P.priority(_req(spark, sf_dir))


@register("agg_priority_category", with_requests(_PRIO, """
th AS (SELECT median(request_count) AS vt, median(time_to_close_days) AS tt FROM pq)""") + """
SELECT "group", request_count, time_to_close_days, open_count, recent_volume,
       recent_volume AS bubble_size, closed_count,
       CASE WHEN time_to_close_days IS NULL THEN 'Unknown'
            WHEN request_count >= vt AND time_to_close_days >= tt THEN 'High Priority (Systemic)'
            WHEN request_count >= vt OR time_to_close_days >= tt THEN 'Medium Priority'
            ELSE 'Low Priority' END AS priority_category
FROM pq, th""")
def q_priority_category(spark, sf_dir):
    return P.categorize(P.priority(_req(spark, sf_dir)))


@register("agg_priority_top_time", with_requests(_PRIO) + """
SELECT "group", request_count, time_to_close_days, open_count FROM pq
WHERE time_to_close_days IS NOT NULL ORDER BY time_to_close_days DESC, "group" LIMIT 10""")
def q_priority_top_time(spark, sf_dir):
    return P.priority_top(P.priority(_req(spark, sf_dir)), "time_to_close_days")


@register("agg_priority_summary", with_requests(_PRIO) + """
SELECT count(*) AS groups, CAST(sum(request_count) AS BIGINT) AS total_requests,
       CAST(sum(open_count) AS BIGINT) AS total_open,
       round_even(median(time_to_close_days), 6) AS median_time,
       round_even(avg(time_to_close_days), 6) AS mean_time, max(time_to_close_days) AS max_time FROM pq""")
def q_priority_summary(spark, sf_dir):
    return P.priority_totals(P.priority(_req(spark, sf_dir)))


@register("agg_priority_by_district", with_requests(f"""
pb AS (SELECT * FROM requests WHERE electoral_district IS NOT NULL)""") + f"""
SELECT electoral_district AS "group", count(*) AS request_count,
       round_even(median(CASE WHEN {SOLVED} AND {days('date_closed', 'date_created')} >= 0
                         THEN {days('date_closed', 'date_created')} END), 6) AS time_to_close_days,
       count(*) FILTER (WHERE {OPEN}) AS open_count,
       count(*) FILTER (WHERE date_created >= (SELECT max(date_created) FROM pb) - INTERVAL 7 DAY) AS recent_volume,
       count(*) FILTER (WHERE {OPEN}) AS bubble_size,
       count(CASE WHEN {SOLVED} AND {days('date_closed', 'date_created')} >= 0 THEN 1 END) AS closed_count
FROM pb GROUP BY 1""")
def q_priority_by_district(spark, sf_dir):
    """The parameters at work: district grouping, median, open-count bubbles, 7 days."""
    return P.priority(_req(spark, sf_dir), group_by=C.DISTRICT, time_metric="median",
                      bubble_metric="open_count", last_n_days=7)


@register("agg_geo_top_volume", with_requests(_GEO) + """
SELECT *, round_even((volume - unresolved) / volume * 100.0, 1) AS resolution_rate FROM gm
ORDER BY volume DESC, electoral_district LIMIT 5""")
def q_geo_top_volume(spark, sf_dir):
    return G.geo_top5(G.geo_metrics(_req(spark, sf_dir)), "volume")


@register("agg_geo_top_p90", with_requests(_GEO) + """
SELECT *, round_even((volume - unresolved) / volume * 100.0, 1) AS resolution_rate FROM gm
WHERE slow_p90 IS NOT NULL ORDER BY slow_p90 DESC, electoral_district LIMIT 5""")
def q_geo_top_p90(spark, sf_dir):
    return G.geo_top5(G.geo_metrics(_req(spark, sf_dir)), "slow_p90")


@register("agg_priority_distribution", with_requests(_PRIO, """
th AS (SELECT median(request_count) AS vt, median(time_to_close_days) AS tt FROM pq),
pc AS (SELECT CASE WHEN time_to_close_days IS NULL THEN 'Unknown'
            WHEN request_count >= vt AND time_to_close_days >= tt THEN 'High Priority (Systemic)'
            WHEN request_count >= vt OR time_to_close_days >= tt THEN 'Medium Priority'
            ELSE 'Low Priority' END AS priority_category FROM pq, th)""") + """
SELECT priority_category, count(*) AS groups FROM pc GROUP BY 1""")
def q_priority_distribution(spark, sf_dir):
    return P.priority_distribution(P.categorize(P.priority(_req(spark, sf_dir))))


@register("agg_fcr_min_volume", with_requests(_FCR) + "SELECT * FROM fr WHERE total_requests >= 6700")
def q_fcr_min_volume(spark, sf_dir):
    """The ``min_volume`` parameter at work (categories below it dropped)."""
    return FC.fcr_rate(_req(spark, sf_dir), min_volume=6700)
