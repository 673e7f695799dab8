"""Registered streaming queries (each runs to completion, then reads its sink)."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiclens.functions import columns as C
from civiclens.operators import ingest as I
from civiclens.plans.ingest import landed_raw
from civiclens.plans.oracle import CLEAN_CTE, RAW_CTE, with_requests
from civiclens.plans.registry import register
from civiclens.session import configure
from civiclens.streaming import jobs


@register("str_volume", """
WITH wm AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM events),
win AS (SELECT date_trunc('day', ts) - k * INTERVAL 1 DAY AS window_start, event_type
        FROM events, range(0, 7) r(k))
SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, event_type, count(*) AS count
FROM win, wm WHERE window_start + INTERVAL 7 DAY <= wm.w GROUP BY 1, 2, 3""")
def q_str_volume(spark, sf_dir):
    configure(spark)
    return jobs.run_volume(spark, sf_dir, days=7)


@register("str_ingest", with_requests(RAW_CTE, CLEAN_CTE) + "SELECT * EXCLUDE (id) FROM loaded")
def q_str_ingest(spark, sf_dir):
    configure(spark)
    out = jobs.run_ingest(spark, landed_raw(spark, sf_dir), columns=[*C.ROW_ORDER, *I.CLEAN_COLUMNS])
    for c in ("created_at", "resolved_at"):
        out = out.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return out


@register("str_embed", """
SELECT doc_id, 64 AS dims FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def q_str_embed(spark, sf_dir):
    configure(spark)
    return jobs.run_embed(spark, sf_dir).select("doc_id", F.size("embedding").alias("dims"))
