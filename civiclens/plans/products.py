"""Registered catalog / profile queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from civiclens.operators import products as PR
from civiclens.operators import vectors as V
from civiclens.plans.oracle import with_requests
from civiclens.plans import analytics, labels, rankings, vectors  # noqa: F401 - their oracles of the products
from civiclens.plans.registry import ORACLES, register
from civiclens.session import configure
from civiclens.sources import files
from civiclens.sources.requests import fact_requests


@register("cat_slice", f"SELECT * FROM ({ORACLES['top_combined']}) WHERE ranking_type = 'Trending Up'")
def q_cat_slice(spark, sf_dir):
    """A catalogued slice: one ranking out of the combined table."""
    configure(spark)
    return PR.load(spark, sf_dir, "top10_trending_up")


@register("cat_load", with_requests("""
f AS (SELECT service_level_1 AS category,
             count(*) FILTER (WHERE first_call_resolution = 'Yes') AS fcr_yes,
             count(*) FILTER (WHERE first_call_resolution = 'No') AS fcr_no
      FROM requests WHERE service_level_1 IS NOT NULL AND first_call_resolution IS NOT NULL GROUP BY 1)""") + """
SELECT * FROM (SELECT category, fcr_yes, fcr_no, fcr_yes + fcr_no AS total_requests,
                      round_even(fcr_yes / (fcr_yes + fcr_no) * 100.0, 2) AS fcr_rate FROM f)
WHERE fcr_rate >= 40""")
def q_cat_load(spark, sf_dir):
    """A catalogued product loaded through the registry, then a predicate."""
    configure(spark)
    return PR.load(spark, sf_dir, "fcr_by_category").filter("fcr_rate >= 40")


@register("sum_profile", with_requests("""
lg AS (SELECT strftime(date_created, '%Y-%m') AS "Time", count(*) AS n FROM requests
       WHERE date_created IS NOT NULL AND service_level_1 IS NOT NULL GROUP BY 1)""") + """
SELECT (SELECT count(*) FROM lg) AS row_count, "Time" AS last_period FROM lg ORDER BY "Time" DESC LIMIT 5""")
def q_sum_profile(spark, sf_dir):
    """Profile of the monthly time series: its row count and last 5 periods."""
    configure(spark)
    df = PR.load(spark, sf_dir, "frequency_over_time")
    prof = PR.profile(df, ["Time"], max_rows=5, from_end=True)
    return prof.select("row_count", F.get_json_object("row_json", "$.Time").alias("last_period"))


# The oracle of each catalogued product, and the number of its columns.
_PRODUCT_SQL = {
    "backlog_distribution": ("agg_backlog_hist", 3), "backlog_level1_summary": ("agg_backlog_level1", 7),
    "backlog_ranked_list": ("agg_backlog_ranked", 5), "fcr_by_category": ("agg_fcr", 5),
    "frequency_over_time": ("agg_frequency_pivot", 7), "geographic_hot_spots": ("agg_geo_metrics", 4),
    "priority_quadrant": ("agg_priority_category", 8), "seasonality_heatmap": ("agg_seasonality", 13),
    "time_to_close": ("agg_close_product", 10), "top10": ("top_combined", 9),
}
_SLICES = {"top10_volume_30d": "Volume (Last 30 Days)", "top10_worst_p90_time": "Worst P90 Time-to-Close",
           "top10_backlog_age": "Backlog Age", "top10_trending_up": "Trending Up",
           "top10_geographic_hotspots": "Geographic Hotspots"}


def _rows_sql(pid):
    if pid in _SLICES:
        return f"(SELECT count(*) FROM ({ORACLES['top_combined']}) WHERE ranking_type = '{_SLICES[pid]}')"
    return f"(SELECT count(*) FROM ({ORACLES[_PRODUCT_SQL[pid][0]]}))"


@register("sum_all", " UNION ALL ".join(
    f"SELECT '{p}' AS product_id, 'ok' AS status, {_rows_sql(p)} AS rows, {_PRODUCT_SQL.get(p, (0, 9))[1]} AS columns"
    for p in [*_PRODUCT_SQL, *_SLICES]))
def q_sum_all(spark, sf_dir):
    """Every catalogued product profiled over the request table and the
    profiles kept as a table: (product, status, rows, columns); a product that
    fails is reported as failed instead of stopping the run."""
    configure(spark)
    return _profiles(spark, sf_dir).select("product_id", "status", F.col("row_count").alias("rows"),
                                           F.size("columns").alias("columns"))


def _profiles(spark, sf_dir, strict=False):
    root = files.scratch_path(spark, f"profiles/{uuid.uuid4().hex}")
    PR.write_profiles(fact_requests(spark, sf_dir), root, strict=strict)
    return PR.read_profiles(spark, root)


@register("sum_rows", " UNION ALL ".join(f"""
SELECT '{p}' AS product_id, CAST(row_number() OVER (ORDER BY {key} {way} NULLS {nulls}) AS INTEGER) AS place, {key} AS shown
FROM ({ORACLES[sql]}) QUALIFY place <= 50""" for p, sql, key, way, nulls in (
    ("frequency_over_time", "agg_frequency_pivot", '"Time"', "DESC", "LAST"),
    ("seasonality_heatmap", "agg_seasonality", "service_category", "DESC", "LAST"),
    ("fcr_by_category", "agg_fcr", "category", "ASC", "FIRST"),
    ("geographic_hot_spots", "agg_geo_metrics", "electoral_district", "ASC", "FIRST"))))
def q_sum_rows(spark, sf_dir):
    """The rows that the kept profiles of four products show, in their order.
    They have no status beside them, so a product that fails stops the query."""
    configure(spark)
    keys = {"frequency_over_time": "Time", "seasonality_heatmap": "service_category", "fcr_by_category": "category",
            "geographic_hot_spots": "electoral_district"}
    rows = _profiles(spark, sf_dir, strict=True).filter(F.col("product_id").isin(*keys)).select(
        "product_id", F.posexplode("rows").alias("place", "row"))
    shown = F.coalesce(*[F.when(F.col("product_id") == p, F.get_json_object("row", f"$.{k}")) for p, k in keys.items()])
    return rows.select("product_id", (F.col("place") + 1).alias("place"), shown.alias("shown"))


@register("jn_cluster_labels", f"""
SELECT a.*, nullif(trim(p.label), '') AS parent_label, nullif(trim(c.label), '') AS child_label,
       coalesce(s.size, 0) AS record_count
FROM ({ORACLES['sim_assign']}) a
LEFT JOIN ({ORACLES['lbl_table']}) p ON p.level = 1 AND p.cluster_id = a.parent_cluster_id
LEFT JOIN ({ORACLES['lbl_table']}) c ON c.level = 2 AND c.cluster_id = a.child_cluster_id
 AND c.parent_cluster_id = a.parent_cluster_id
LEFT JOIN (SELECT label AS top, vec_id % 3 AS sub, count(*) AS size FROM embeddings GROUP BY 1, 2) s
 ON s.top = a.parent_cluster_id AND s.sub = a.child_cluster_id""")
def q_cluster_labels(spark, sf_dir):
    """Assigned (parent, child) pairs with their labels and record counts."""
    from civiclens.operators import labels as L
    from civiclens.plans.labels import cluster_rows, members_base
    from civiclens.plans.vectors import pair_sizes, points, sub_centroids, top_centroids
    pts = points(spark, sf_dir)
    a = V.assign(pts.withColumnRenamed("id", "query_id"), top_centroids(pts), sub_centroids(pts), pair_sizes(pts))
    lt = L.label_table(cluster_rows(spark, sf_dir), L.memberships(members_base(spark, sf_dir)))
    return V.with_labels(a, lt.select("level", "parent_cluster_id", "cluster_id", "label"), pair_sizes(pts))


@register("cat_many", " UNION ALL ".join(
    f"SELECT '{p}' AS product_id, {_rows_sql(p)} AS rows" for p in ("geographic_hot_spots", "fcr_by_category")))
def q_cat_many(spark, sf_dir):
    """Three products loaded at once over the request table (an
    unknown id is skipped); their row counts stacked."""
    configure(spark)
    prods = PR.load_many(spark, sf_dir, ["geographic_hot_spots", "no_such_product", "fcr_by_category"])
    frames = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(pid).alias("product_id"), "rows")
              for pid, df in prods.items()]
    return frames[0].unionByName(frames[1])


@register("sim_assign_text")
def q_assign_text(spark, sf_dir):
    """The prediction path for a batch of texts: every conversation turn is
    encoded, assigned to a parent and child cluster with the non-empty
    fallback, and given the cluster labels and record count.  The clusters'
    centroids are means of their members' texts by the same encoder.  The
    members are joined to their texts once, for both levels and the labels."""
    from civiclens.operators import labels as L
    from civiclens.plans.labels import cluster_rows, members_base
    from civiclens.plans.vectors import pair_sizes, sub_centroids, top_centroids
    from civiclens.sources.tables import read_table
    conv = read_table(spark, sf_dir, "conversations")
    q = V.hashing_encoder(conv.select((F.col("conv_id") * F.lit(1 << 32) + F.col("turn")).alias("query_id"), "text"),
                          "text", dim=384)
    members = V.staged(members_base(spark, sf_dir))
    pts = V.hashing_encoder(members.select("id", "top_cluster_id", "sub_cluster_id", "description"), "description", dim=384)
    a = V.assign(q, top_centroids(pts), sub_centroids(pts), pair_sizes(pts))
    lt = L.label_table(cluster_rows(spark, sf_dir), L.memberships(members))
    return V.low_confidence(V.with_labels(a, lt.select("level", "parent_cluster_id", "cluster_id", "label"),
                                          pair_sizes(pts)))
