"""Registered projections, joins, set operations and dashboard reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiclens.functions import columns as C
from civiclens.functions.binning import CLOSE_EDGES, CLOSE_LABELS, bin_label
from civiclens.functions.predicates import is_open
from civiclens.functions.timecalc import floor_days, minus_days, resolve_as_of, year_month
from civiclens.operators import geo as G
from civiclens.operators import paging as PG
from civiclens.operators import points as PT
from civiclens.operators import priority as P
from civiclens.operators import rankings as R
from civiclens.plans.oracle import NOW, OPEN, SOLVED, days, with_requests

_PRIO_CTE = f"""
pb AS (SELECT * FROM requests WHERE service_level_1 IS NOT NULL),
pq AS (SELECT service_level_1 AS "group", count(*) AS request_count,
              round_even(quantile_cont(CASE WHEN {SOLVED} AND {days('date_closed', 'date_created')} >= 0
                                       THEN {days('date_closed', 'date_created')} END, 0.9), 6) AS time_to_close_days
       FROM pb GROUP BY 1)"""
_UNRES_CTE = f"""
u AS (SELECT *, {days(NOW, 'date_created')} AS age FROM requests
      WHERE {OPEN} OR date_closed IS NULL)"""
from civiclens.plans import analytics  # noqa: F401 - its oracle of the geographic product
from civiclens.plans.registry import ORACLES, register
from civiclens.plans.vectors import points as vpoints
from civiclens.session import configure
from civiclens.sources.requests import fact_requests, latest_created
from civiclens.sources.tables import read_table

KEYS = list(C.ROW_ORDER)
_K = "service_request_id, l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _req(spark, sf_dir):
    configure(spark)
    return fact_requests(spark, sf_dir)


@register("prj_age_days", with_requests() + f"SELECT {_K}, {days(NOW, 'date_created')} AS age_days FROM requests")
def q_age_days(spark, sf_dir):
    r = _req(spark, sf_dir)
    now = resolve_as_of(r, latest_created(spark, sf_dir))
    return r.select(C.REQUEST_ID, *KEYS, floor_days(now, C.CREATED).alias("age_days"))


@register("prj_age_or_duration", with_requests() + f"""
SELECT * FROM (SELECT {_K}, CASE WHEN {OPEN} THEN {days(NOW, 'date_created')}
                               ELSE {days('date_closed', 'date_created')} END AS age_days FROM requests)
WHERE age_days >= 0""")
def q_age_or_duration(spark, sf_dir):
    r = _req(spark, sf_dir)
    return R.age_or_duration(r, resolve_as_of(r, latest_created(spark, sf_dir))).select(
        C.REQUEST_ID, *KEYS, "age_days")


@register("prj_recent_flag", with_requests() + f"""
SELECT {_K}, date_created >= (SELECT max(date_created) FROM requests WHERE service_level_1 IS NOT NULL)
                             - INTERVAL 30 DAY AS is_recent
FROM requests WHERE service_level_1 IS NOT NULL""")
def q_recent_flag(spark, sf_dir):
    r = _req(spark, sf_dir).filter(F.col(C.LEVEL1).isNotNull())
    now = r.select(F.max(C.CREATED)).scalar()
    return r.select(C.REQUEST_ID, *KEYS, (F.col(C.CREATED) >= minus_days(now, 30)).alias("is_recent"))


@register("prj_bin", with_requests() + f"""
SELECT {_K}, t, CASE WHEN t >= 0 AND t < 1 THEN '0 days' WHEN t >= 1 AND t < 3 THEN '1-2 days'
                     WHEN t >= 3 AND t < 8 THEN '3-7 days' WHEN t >= 8 AND t < 31 THEN '8-30 days'
                     WHEN t >= 31 AND t < 91 THEN '31-90 days' WHEN t >= 91 THEN '90+ days' END AS time_bin
FROM (SELECT *, {days('date_closed', 'date_created')} AS t FROM requests)""")
def q_bin(spark, sf_dir):
    r = _req(spark, sf_dir).withColumn("t", floor_days(C.CLOSED, C.CREATED))
    return r.select(C.REQUEST_ID, *KEYS, "t", bin_label(F.col("t"), CLOSE_EDGES, CLOSE_LABELS).alias("time_bin"))


@register("prj_year_month", with_requests() + f"SELECT {_K}, strftime(date_created, '%Y-%m') AS year_month FROM requests")
def q_year_month(spark, sf_dir):
    return _req(spark, sf_dir).select(C.REQUEST_ID, *KEYS, year_month(C.CREATED).alias("year_month"))


@register("prj_category_fallback", with_requests() + f"""
SELECT {_K}, coalesce(service_level_1, service_type) AS service_category, year(date_created) AS year,
       month(date_created) AS month FROM requests
WHERE date_created IS NOT NULL AND coalesce(service_level_1, service_type) IS NOT NULL""")
def q_category_fallback(spark, sf_dir):
    r = _req(spark, sf_dir).select(C.REQUEST_ID, *KEYS,
                                   F.coalesce(C.LEVEL1, C.SERVICE_TYPE).alias("service_category"),
                                   F.year(C.CREATED).cast("long").alias("year"),
                                   F.month(C.CREATED).cast("long").alias("month"))
    return r.dropna(subset=["month", "service_category"])


@register("flt_time_range", with_requests() + f"""
SELECT {_K} FROM requests WHERE date_created >= {NOW} - INTERVAL 90 DAY""")
def q_time_range(spark, sf_dir):
    r = _req(spark, sf_dir)
    now = resolve_as_of(r, latest_created(spark, sf_dir))
    return r.filter(F.col(C.CREATED) >= minus_days(now, 90)).select(C.REQUEST_ID, *KEYS)


_GEO = f"""
gm AS (SELECT electoral_district, count(*) AS volume FROM requests WHERE electoral_district IS NOT NULL GROUP BY 1)"""


@register("prj_minmax", with_requests(_GEO) + """
SELECT electoral_district, volume,
       coalesce((volume - min(volume) OVER ()) / nullif(max(volume) OVER () - min(volume) OVER (), 0), 0.0) AS scaled
FROM gm""")
def q_minmax(spark, sf_dir):
    g = G.geo_metrics(_req(spark, sf_dir)).select("electoral_district", "volume")
    return PT.minmax_scale(g, "volume")


@register("jn_open_left", with_requests(f"""
a AS (SELECT DISTINCT service_level_1 FROM requests WHERE service_level_1 IS NOT NULL),
o AS (SELECT service_level_1, count(*) AS open_count FROM requests WHERE {OPEN} AND service_level_1 IS NOT NULL
      GROUP BY 1)""") + """
SELECT a.service_level_1, coalesce(o.open_count, 0) AS open_count FROM a LEFT JOIN o
ON a.service_level_1 = o.service_level_1""")
def q_open_left(spark, sf_dir):
    """Open counts per category as one conditional aggregate (the
    reference's left join + fill, in a single pass)."""
    r = _req(spark, sf_dir).filter(F.col(C.LEVEL1).isNotNull())
    return r.groupBy(C.LEVEL1).agg(F.count_if(is_open()).alias("open_count"))


@register("jn_hotspot_inner", with_requests(f"""
rc AS (SELECT neighbourhood, service_level_1 FROM requests
       WHERE date_created >= {NOW} - INTERVAL 30 DAY AND neighbourhood IS NOT NULL),
vol AS (SELECT neighbourhood, count(*) AS volume FROM rc GROUP BY 1),
pc AS (SELECT neighbourhood, service_level_1, count(*) AS n FROM rc WHERE service_level_1 IS NOT NULL GROUP BY 1, 2),
tc AS (SELECT neighbourhood, service_level_1 AS top_category FROM (
         SELECT *, row_number() OVER (PARTITION BY neighbourhood ORDER BY n DESC, service_level_1) AS rk FROM pc)
       WHERE rk = 1)""") + """
SELECT v.neighbourhood, v.volume, t.top_category FROM vol v JOIN tc t ON v.neighbourhood = t.neighbourhood""")
def q_hotspot_inner(spark, sf_dir):
    r = _req(spark, sf_dir)
    now = resolve_as_of(r, latest_created(spark, sf_dir))
    rc = r.filter((F.col(C.CREATED) >= minus_days(now, 30)) & F.col(C.NEIGHBOURHOOD).isNotNull())
    vol = rc.groupBy(C.NEIGHBOURHOOD).agg(F.count(F.lit(1)).alias("volume"))
    top = R.mode_by_group(rc, C.NEIGHBOURHOOD, C.LEVEL1, "top_category")
    return vol.join(top, C.NEIGHBOURHOOD, "inner")


@register("set_union", with_requests() + """
SELECT 'status' AS source, status_type AS value FROM requests WHERE status_type IS NOT NULL
UNION ALL SELECT 'fcr', first_call_resolution FROM requests WHERE first_call_resolution IS NOT NULL""")
def q_set_union(spark, sf_dir):
    r = _req(spark, sf_dir)
    a = r.filter(F.col(C.STATUS).isNotNull()).select(F.lit("status").alias("source"), F.col(C.STATUS).alias("value"))
    b = r.filter(F.col(C.FCR).isNotNull()).select(F.lit("fcr").alias("source"), F.col(C.FCR).alias("value"))
    return a.unionByName(b)


@register("set_distinct", with_requests() + """
SELECT DISTINCT service_level_1, service_level_2 FROM requests""")
def q_set_distinct(spark, sf_dir):
    return _req(spark, sf_dir).select(C.LEVEL1, C.LEVEL2).distinct()


def projected(spark, sf_dir):
    """request_2d stand-in: PCA-free coordinates taken from two embedding
    dimensions (z only for even ids), so SQL can reproduce them."""
    pts = vpoints(spark, sf_dir)
    return pts.select(F.col("id").alias("request_id"), "top_cluster_id", "sub_cluster_id",
                      F.col("embedding")[0].cast("double").alias("x_2d"),
                      F.col("embedding")[1].cast("double").alias("y_2d"),
                      F.when(F.pmod("id", F.lit(2)) == 0, F.col("embedding")[2].cast("double")).alias("z_2d"))


_PRJ = """
WITH pr AS (SELECT vec_id AS request_id, label AS top_cluster_id, CAST(vec_id % 3 AS INTEGER) AS sub_cluster_id,
                   CAST(embedding[1] AS DOUBLE) AS x_2d, CAST(embedding[2] AS DOUBLE) AS y_2d,
                   CASE WHEN vec_id % 2 = 0 THEN CAST(embedding[3] AS DOUBLE) END AS z_2d FROM embeddings)"""


@register("pts_capped", _PRJ + """
SELECT * FROM pr WHERE top_cluster_id IN (0, 1, 2, 3, 4) AND z_2d IS NOT NULL ORDER BY request_id LIMIT 2500""")
def q_pts_capped(spark, sf_dir):
    allowed = spark.createDataFrame([(i,) for i in range(5)], "top_cluster_id int")
    return PT.capped_points(projected(spark, sf_dir), allowed, cap=2500, need_z=True)


@register("pts_domain", _PRJ + """
SELECT min(x_2d) - (CASE WHEN max(x_2d) - min(x_2d) = 0 THEN 1.0 ELSE max(x_2d) - min(x_2d) END) * 0.08 AS x_2d_min,
       max(x_2d) + (CASE WHEN max(x_2d) - min(x_2d) = 0 THEN 1.0 ELSE max(x_2d) - min(x_2d) END) * 0.08 AS x_2d_max,
       min(y_2d) - (CASE WHEN max(y_2d) - min(y_2d) = 0 THEN 1.0 ELSE max(y_2d) - min(y_2d) END) * 0.08 AS y_2d_min,
       max(y_2d) + (CASE WHEN max(y_2d) - min(y_2d) = 0 THEN 1.0 ELSE max(y_2d) - min(y_2d) END) * 0.08 AS y_2d_max
FROM pr""")
def q_pts_domain(spark, sf_dir):
    return PT.plot_domain(projected(spark, sf_dir))


@register("tbl_page", with_requests() + f"""
SELECT {_K}, service_type FROM requests WHERE contains(lower(service_type), 'brand#1')
ORDER BY service_type DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10 OFFSET 20""")
def q_tbl_page(spark, sf_dir):
    r = _req(spark, sf_dir).select(C.REQUEST_ID, *KEYS, C.SERVICE_TYPE)
    return PT.page(r, [F.desc(C.SERVICE_TYPE), *[F.asc(k) for k in KEYS]], page_no=2, size=10,
                   filters={C.SERVICE_TYPE: "Brand#1"})


@register("tbl_page_seek", with_requests() + f"""
SELECT {_K}, service_type FROM requests
ORDER BY service_type DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey
LIMIT 100 OFFSET (SELECT count(*) // 200 * 100 FROM requests)""")
def q_tbl_page_seek(spark, sf_dir):
    """The page of 100 rows in the middle of all, from a stored order."""
    r = _req(spark, sf_dir).select(C.REQUEST_ID, *KEYS, C.SERVICE_TYPE)
    order = [F.desc(C.SERVICE_TYPE), *[F.asc(k) for k in KEYS]]
    path = PG.new_folder(spark)
    PG.store_pages(r, order, path)
    return PG.read_page(spark, path, r.schema, order, PG.total_rows(spark, path) // 200, size=100)


@register("tbl_facets", with_requests() + """
SELECT 'status_type' AS "column", status_type AS value, count(*) AS count FROM requests GROUP BY 2
UNION ALL SELECT 'first_call_resolution', first_call_resolution, count(*) FROM requests GROUP BY 2
UNION ALL SELECT 'service_level_1', service_level_1, count(*) FROM requests GROUP BY 2""")
def q_tbl_facets(spark, sf_dir):
    return PT.facets(_req(spark, sf_dir), [C.STATUS, C.FCR, C.LEVEL1])


@register("agg_kpi_rollups", with_requests(_PRIO_CTE, _UNRES_CTE, """
pc AS (SELECT pq.*, CASE WHEN time_to_close_days IS NULL THEN 'Unknown'
            WHEN request_count >= vt AND time_to_close_days >= tt THEN 'High Priority (Systemic)'
            WHEN request_count >= vt OR time_to_close_days >= tt THEN 'Medium Priority'
            ELSE 'Low Priority' END AS priority_category
       FROM pq, (SELECT median(request_count) AS vt, median(time_to_close_days) AS tt FROM pq)),
bl AS (SELECT service_level_1, count(age) AS total_unresolved FROM u WHERE service_level_1 IS NOT NULL GROUP BY 1),
geo AS (SELECT electoral_district AS d, count(*) AS volume,
               quantile_cont(CASE WHEN coalesce(status_type = 'Solved', false)
                                   AND floor((epoch_us(date_closed) - epoch_us(date_created)) / 86400000000.0) >= 0
                              THEN floor((epoch_us(date_closed) - epoch_us(date_created)) / 86400000000.0) END, 0.9) AS p90
        FROM requests WHERE electoral_district IS NOT NULL GROUP BY 1)""") + """
SELECT (SELECT count(*) FILTER (WHERE contains(priority_category, 'High')) FROM pc) AS high_priority_count,
       (SELECT CAST(sum(request_count) AS BIGINT) FROM pc) AS total_requests,
       (SELECT CAST(floor(avg(time_to_close_days) + 0.5) AS BIGINT) FROM pc) AS avg_time_to_close,
       (SELECT CAST(sum(total_unresolved) AS BIGINT) FROM bl) AS backlog_total_unresolved,
       (SELECT arg_min(service_level_1, (-total_unresolved, service_level_1)) FROM bl) AS backlog_top_category,
       (SELECT max(total_unresolved) FROM bl) AS backlog_top_value,
       (SELECT arg_min(d, (-volume, d)) FROM geo) AS highest_volume_district,
       (SELECT max(volume) FROM geo) AS highest_volume,
       (SELECT arg_min(d, (-p90, d)) FROM geo WHERE p90 IS NOT NULL) AS slowest_p90_district,
       (SELECT round_even(max(p90), 6) FROM geo) AS slowest_p90,
       (SELECT count(*) FROM geo) AS total_districts""")
def q_kpi(spark, sf_dir):
    """Dashboard KPI tiles from three products.  Each product is one row per
    group; each tile set is a 1-row aggregate; the three 1-row frames are
    joined on a constant key."""
    from civiclens.operators import backlog as B
    r = _req(spark, sf_dir)
    pc = P.categorize(P.priority(r))
    a = pc.agg(F.count_if(F.col("priority_category").contains("High")).alias("high_priority_count"),
               F.sum("request_count").alias("total_requests"),
               F.floor(F.avg("time_to_close_days") + F.lit(0.5)).alias("avg_time_to_close"))
    bl = B.backlog_level1(r, as_of=latest_created(spark, sf_dir))
    b = bl.agg(F.sum("total_unresolved").alias("backlog_total_unresolved"),
               F.min_by(C.LEVEL1, F.struct(-F.col("total_unresolved"), F.col(C.LEVEL1)))
               .alias("backlog_top_category"),
               F.max("total_unresolved").alias("backlog_top_value"))
    g = G.geo_metrics(r)
    k = F.col("electoral_district")
    c = g.agg(F.min_by(k, F.struct(-F.col("volume"), k)).alias("highest_volume_district"),
              F.max("volume").alias("highest_volume"),
              F.min_by(k, F.when(F.col("slow_p90").isNotNull(), F.struct(-F.col("slow_p90"), k)))
              .alias("slowest_p90_district"),
              F.max("slow_p90").alias("slowest_p90"),
              F.count(F.lit(1)).alias("total_districts"))
    one = F.lit(1)
    return (a.withColumn("_k", one).join(b.withColumn("_k", one), "_k")
             .join(c.withColumn("_k", one), "_k").drop("_k"))


_GEO_SQL = ORACLES["agg_geo_metrics"]


@register("sink_csv", _GEO_SQL)
def q_sink_csv(spark, sf_dir):
    """A product written as one CSV (small product) and read back."""
    import os
    from civiclens.sources import files
    prod = G.geo_metrics(_req(spark, sf_dir))
    path = files.scratch_path(spark, "products/geo_" + os.path.basename(sf_dir.rstrip("/")))
    files.write_csv(prod, path, single_file=True)
    return files.read_csv(spark, path, "electoral_district string, volume long, unresolved long, slow_p90 double")


@register("sink_geojson", f"""
SELECT n_nationkey::BIGINT AS feature_idx, n_name AS district, g.volume, g.unresolved, g.slow_p90,
       n_regionkey::DOUBLE AS x, n_nationkey::DOUBLE AS y
FROM nation LEFT JOIN ({_GEO_SQL}) g ON n_name = g.electoral_district""")
def q_sink_geojson(spark, sf_dir):
    """Enriched district features written as line-delimited GeoJSON and read
    back with the GeoJSON source (``src_geojson``)."""
    import os
    from civiclens.sources import files
    r = _req(spark, sf_dir)
    nation = read_table(spark, sf_dir, "nation")
    feats = nation.select(F.col("n_nationkey").cast("long").alias("feature_idx"),
                          F.create_map(F.lit("Electoral District"), F.col("n_name")).alias("properties"),
                          F.to_json(F.struct(F.lit("Point").alias("type"),
                                             F.array(F.col("n_regionkey").cast("double"),
                                                     F.col("n_nationkey").cast("double")).alias("coordinates")))
                          .alias("geometry"))
    path = files.scratch_path(spark, "geo/" + os.path.basename(sf_dir.rstrip("/")))
    G.write_geojson_lines(G.enrich_features(feats, G.geo_metrics(r)), path)
    back = files.read_geojson(spark, path, line_delimited=True)
    prop = F.col("properties")
    at = [F.get_json_object("geometry", f"$.coordinates[{i}]").cast("double") for i in (0, 1)]
    return back.select("feature_idx", prop["Electoral District"].alias("district"),
                       prop["volume"].cast("long").alias("volume"), prop["unresolved"].cast("long").alias("unresolved"),
                       prop["slow_p90"].cast("double").alias("slow_p90"), at[0].alias("x"), at[1].alias("y"))


@register("src_geojson", """
SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS feature_idx, n_name AS district,
       n_regionkey::DOUBLE AS x, n_nationkey::DOUBLE AS y FROM nation""")
def q_src_geojson(spark, sf_dir):
    """A FeatureCollection document built from the district table (one
    feature per district, a bounded set) is written and read back with the
    multi-line GeoJSON reader, then exploded into features."""
    import os
    from civiclens.sources import files
    nation = read_table(spark, sf_dir, "nation")
    def feature(r):
        return F.struct(F.lit("Feature").alias("type"),
                        F.create_map(F.lit("electoral_district"), r["n_name"]).alias("properties"),
                        F.struct(F.lit("Point").alias("type"),
                                 F.array(r["n_regionkey"].cast("double"),
                                         r["n_nationkey"].cast("double")).alias("coordinates")).alias("geometry"))
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey")))
    doc = nation.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"),
                                        F.transform(rows, feature).alias("features"))).alias("value"))
    path = files.scratch_path(spark, "geo_doc/" + os.path.basename(sf_dir.rstrip("/")))
    doc.write.mode("overwrite").text(path)
    at = [F.get_json_object("geometry", f"$.coordinates[{i}]").cast("double") for i in (0, 1)]
    return files.read_geojson(spark, path).select(
        "feature_idx", G.district_of().alias("district"), at[0].alias("x"), at[1].alias("y"))
