"""Registered source / ingest / sampling / reduce queries."""

from __future__ import annotations

import os
import threading

from pyspark.sql import functions as F

from civiclens.functions import columns as C
from civiclens.functions.predicates import is_open, is_open_or_unclosed, is_unresolved_strict
from civiclens.functions.timecalc import parse_date
from civiclens.operators import ingest as I
from civiclens.operators import sampling as S
from civiclens.plans.oracle import (CLEAN_CTE, DESCRIPTION_SQL, LOCATION_SQL, OPEN, RAW_CTE,
                                    parse_date_sql, with_requests)
from civiclens.plans.registry import register
from civiclens.session import checkpoint_dir, configure
from civiclens.sources import files
from civiclens.sources.raw import raw_requests
from civiclens.sources.requests import fact_requests, fingerprint
from civiclens.sources.tables import path_exists

KEYS = list(C.ROW_ORDER)


def _req(spark, sf_dir):
    configure(spark)
    return fact_requests(spark, sf_dir)


def _raw(spark, sf_dir):
    configure(spark)
    return raw_requests(spark, sf_dir)


def as_ts(df, cols=("created_at", "resolved_at")):
    """Registered outputs present DATE columns as timestamps (midnight) so
    both engines hand back the same value type."""
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


STAGE_VERSION = 3  # bump when the raw rendering or the cleaning changes
_STAGE_LOCK = threading.RLock()  # re-entrant: "loaded" builds on "raw"


def _stage_path(spark, sf_dir, name):
    return os.path.join(checkpoint_dir(spark), "civiclens", "staged",
                        f"{name}-{STAGE_VERSION}-{fingerprint(spark, sf_dir)}")


def _once(spark, sf_dir, name, build):
    """A staged table is written once, as Parquet under the shared folder, and
    read back by every later query with its own column pruning and filters.
    Keyed by the base files' fingerprint: changed files give a new table."""
    path = _stage_path(spark, sf_dir, name)
    with _STAGE_LOCK:
        if not path_exists(spark, os.path.join(path, "_SUCCESS")):
            build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def staged_raw(spark, sf_dir):
    """Raw rows as they would land in storage: derived by Spark from the
    tables, then written once (Parquet in the shared folder).
    Without the stage Catalyst pushes the cleaning filter into the joins and
    evaluates the rendering and parsing chain twice per row."""
    return _once(spark, sf_dir, "raw", lambda: _raw(spark, sf_dir))


def landed_raw(spark, sf_dir):
    """The folder the raw rows have landed in, for a file stream."""
    staged_raw(spark, sf_dir)
    return _stage_path(spark, sf_dir, "raw")


def cleaned(spark, sf_dir):
    return as_ts(I.clean(staged_raw(spark, sf_dir), keep=KEYS))


def loaded(spark, sf_dir):
    """The ``requests`` table: raw -> clean -> first-wins de-dupe, with a
    serial-like integer id; written once, since sampling and reduction read
    it several times (count, rank, semi join)."""
    def build():
        first = I.dedupe_first(cleaned(spark, sf_dir), "service_request_id", KEYS)
        return first.withColumn("id", F.col("l_orderkey") * F.lit(1 << 32) + F.col("l_linenumber"))
    return _once(spark, sf_dir, "loaded", build)


_REQ_COLS = ("service_request_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, service_type, "
             "service_level_1, service_level_2, date_created, date_closed, status_type, "
             "first_call_resolution, electoral_district, neighbourhood")


@register("src_table", with_requests() + f"SELECT {_REQ_COLS} FROM requests")
def q_src_table(spark, sf_dir):
    return _req(spark, sf_dir)


def filtered(df, filters: dict):
    """Equality filters ANDed; Catalyst pushes them into the scans."""
    out = df
    for k, v in (filters or {}).items():
        out = out.filter(F.col(k) == F.lit(v))
    return out


@register("src_filtered", with_requests() + f"""
SELECT {_REQ_COLS} FROM requests WHERE status_type = 'Solved' AND electoral_district = 'NATION_7'""")
def q_src_filtered(spark, sf_dir):
    return filtered(_req(spark, sf_dir), {C.STATUS: "Solved", C.DISTRICT: "NATION_7"})


@register("src_raw_by_type", with_requests(RAW_CTE) + """
SELECT * FROM raw WHERE "Service Type" = 'SMALL Brand#4'""")
def q_src_raw_by_type(spark, sf_dir):
    return filtered(_raw(spark, sf_dir), {"`Service Type`": "SMALL Brand#4"})


@register("src_cached", with_requests() + f"SELECT {_REQ_COLS} FROM requests")
def q_src_cached(spark, sf_dir):
    """Snapshot of the request table, reused while younger than 24 h."""
    root = files.scratch_path(spark, "snapshots/" + os.path.basename(sf_dir.rstrip("/")))
    return files.cached_snapshot(spark, lambda: _req(spark, sf_dir), root)


@register("src_csv", with_requests(RAW_CTE) + """
SELECT * REPLACE (nullif("Reference Number", '') AS "Reference Number", nullif("Service Type", '') AS "Service Type")
FROM raw""")
def q_src_csv(spark, sf_dir):
    """Raw rows written as CSV (the source format, compressed) and read back
    with an explicit schema; an empty value is a missing one there."""
    raw = _raw(spark, sf_dir)
    path = files.scratch_path(spark, "raw_csv/" + os.path.basename(sf_dir.rstrip("/")))
    files.write_csv(raw, path, compressed=True)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields)
    return files.read_csv(spark, path, schema)


@register("ing_required_columns", with_requests(RAW_CTE) + """
SELECT 'Service Request ID' AS "column", true AS present, count("Service Request ID") AS non_null_rows FROM raw UNION ALL SELECT 'Reference Number' AS "column", true AS present, count("Reference Number") AS non_null_rows FROM raw UNION ALL SELECT 'Service Type' AS "column", true AS present, count("Service Type") AS non_null_rows FROM raw UNION ALL SELECT 'Date Created' AS "column", true AS present, count("Date Created") AS non_null_rows FROM raw UNION ALL SELECT 'Date Closed' AS "column", true AS present, count("Date Closed") AS non_null_rows FROM raw UNION ALL SELECT 'Electoral District' AS "column", true AS present, count("Electoral District") AS non_null_rows FROM raw UNION ALL SELECT 'Neighbourhood' AS "column", true AS present, count("Neighbourhood") AS non_null_rows FROM raw""")
def q_required_columns(spark, sf_dir):
    """Required-column check of the raw rows: presence and filled rows per
    column (``require_columns`` raises on a missing one)."""
    raw = I.require_columns(_raw(spark, sf_dir))
    return I.column_report(raw)


@register("ing_required_rows", with_requests(RAW_CTE) + """
SELECT count(*) AS initial_count,
       count(*) FILTER (WHERE "Service Request ID" IS NOT NULL AND "Service Type" IS NOT NULL
                          AND "Date Created" IS NOT NULL) AS filtered_count
FROM raw""")
def q_required_rows(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    ok = F.col("`Service Request ID`").isNotNull() & F.col("`Service Type`").isNotNull() & \
        F.col("`Date Created`").isNotNull()
    return raw.agg(F.count(F.lit(1)).alias("initial_count"), F.count_if(ok).alias("filtered_count"))


@register("ing_parse_date", with_requests(RAW_CTE) + f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "Date Created" AS raw_created,
       CAST({parse_date_sql('"Date Created"')} AS TIMESTAMP) AS created_at,
       CAST({parse_date_sql('"Date Closed"')} AS TIMESTAMP) AS resolved_at
FROM raw""")
def q_parse_date(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return as_ts(raw.select(*KEYS, F.col("`Date Created`").alias("raw_created"),
                            parse_date(F.col("`Date Created`")).alias("created_at"),
                            parse_date(F.col("`Date Closed`")).alias("resolved_at")))


@register("ing_description", with_requests(RAW_CTE) + f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {DESCRIPTION_SQL} AS description,
       {LOCATION_SQL} AS location FROM raw""")
def q_description(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return raw.select(*KEYS, I.description().alias("description"), I.location().alias("location"))


@register("ing_clean", with_requests(RAW_CTE, CLEAN_CTE) + "SELECT * FROM clean")
def q_clean(spark, sf_dir):
    return cleaned(spark, sf_dir)


_COUNTS_SQL = with_requests(RAW_CTE) + f"""
SELECT count(*) AS total,
       count(*) FILTER (WHERE "Service Request ID" <> '' AND "Service Type" <> ''
                          AND {parse_date_sql('"Date Created"')} IS NOT NULL) AS accepted,
       count(*) FILTER (WHERE NOT coalesce("Service Request ID" <> '' AND "Service Type" <> '', false)) AS skipped_missing,
       count(*) FILTER (WHERE "Service Request ID" <> '' AND "Service Type" <> ''
                          AND {parse_date_sql('"Date Created"')} IS NULL) AS skipped_date
FROM raw"""


@register("ing_counts", _COUNTS_SQL)
def q_clean_counts(spark, sf_dir):
    """Raw rows accepted by the cleaning and skipped, by reason."""
    return I.clean_counts(_raw(spark, sf_dir))


def _one_row(spark, counts):
    """Counts that a writing job observed, as a frame of one row."""
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))


@register("ing_load", _COUNTS_SQL)
def q_load(spark, sf_dir):
    """The cleaned rows written, with the counts of the same pass."""
    path = files.scratch_path(spark, "cleaned/" + os.path.basename(sf_dir.rstrip("/")))
    return _one_row(spark, I.load_clean(staged_raw(spark, sf_dir), path, KEYS))


@register("ing_load_required", with_requests(RAW_CTE) + """
SELECT count(*) AS total, count(*) FILTER (WHERE "Service Request ID" IS NULL OR "Service Type" IS NULL
                                              OR "Date Created" IS NULL) AS dropped FROM raw""")
def q_load_required(spark, sf_dir):
    """Rows with all required values written, with the dropped ones counted."""
    path = files.scratch_path(spark, "required/" + os.path.basename(sf_dir.rstrip("/")))
    return _one_row(spark, I.load_required(staged_raw(spark, sf_dir), path))


@register("ing_dedupe", with_requests(RAW_CTE, CLEAN_CTE) + """
SELECT * EXCLUDE (id) FROM loaded
WHERE service_request_id NOT IN (SELECT service_request_id FROM clean WHERE created_at < DATE '1996-01-01')""")
def q_dedupe(spark, sf_dir):
    """First-wins insert of the cleaned batch into a table that already
    holds the requests created before 1996 (those keys are skipped)."""
    batch = cleaned(spark, sf_dir)
    existing = batch.filter(F.col("created_at") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return I.dedupe_first(batch, "service_request_id", KEYS, existing=existing)


@register("set_except_existing", with_requests(RAW_CTE, CLEAN_CTE) + """
SELECT DISTINCT service_request_id FROM clean
WHERE service_request_id NOT IN (SELECT service_request_id FROM clean WHERE created_at < DATE '1996-01-01')""")
def q_except_existing(spark, sf_dir):
    batch = cleaned(spark, sf_dir)
    existing = batch.filter(F.col("created_at") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return batch.select("service_request_id").distinct().join(
        existing.select("service_request_id"), "service_request_id", "left_anti")


@register("smp_percent", with_requests(RAW_CTE, CLEAN_CTE, """
ranked AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '42'), id) AS rn FROM loaded)""") + """
SELECT * EXCLUDE (rn) FROM ranked WHERE rn <= (SELECT floor(count(*) * 50.0 / 100.0) FROM loaded)""")
def q_smp_percent(spark, sf_dir):
    return S.sample_percent(loaded(spark, sf_dir), 50, "id", seed=42)


@register("smp_every_nth", with_requests(RAW_CTE, CLEAN_CTE) + "SELECT * FROM loaded WHERE id % 6 = 0")
def q_every_nth(spark, sf_dir):
    return S.every_nth(loaded(spark, sf_dir), "id", 6)


def _reduce_sql(where: str, order: str) -> str:
    return with_requests(RAW_CTE, CLEAN_CTE, f"""
ranked AS (SELECT id, created_at, row_number() OVER (ORDER BY {order}) AS rn FROM loaded {where})""") + """
SELECT id, created_at FROM ranked WHERE rn <= (SELECT floor(count(*) * 50.0 / 100.0) FROM loaded)"""


@register("red_oldest", _reduce_sql("WHERE created_at IS NOT NULL", "created_at ASC, id ASC"))
def q_red_oldest(spark, sf_dir):
    return S.reduce_ids(loaded(spark, sf_dir), "oldest", 50)


@register("red_newest", _reduce_sql("WHERE created_at IS NOT NULL", "created_at DESC, id ASC"))
def q_red_newest(spark, sf_dir):
    return S.reduce_ids(loaded(spark, sf_dir), "newest", 50)


@register("red_random", _reduce_sql("", "md5(CAST(id AS VARCHAR) || '42'), id"))
def q_red_random(spark, sf_dir):
    return S.reduce_ids(loaded(spark, sf_dir), "random", 50)


@register("red_keep", with_requests(RAW_CTE, CLEAN_CTE, """
ranked AS (SELECT id, row_number() OVER (ORDER BY created_at ASC, id ASC) AS rn FROM loaded
           WHERE created_at IS NOT NULL),
gone AS (SELECT id FROM ranked WHERE rn <= (SELECT floor(count(*) * 50.0 / 100.0) FROM loaded))""") + """
SELECT * FROM loaded WHERE id NOT IN (SELECT id FROM gone)""")
def q_red_keep(spark, sf_dir):
    ld = loaded(spark, sf_dir)
    return S.reduce_keep(ld, S.reduce_ids(ld, "oldest", 50))


@register("red_preview", with_requests(RAW_CTE, CLEAN_CTE, """
ranked AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id ASC) AS rn FROM loaded
           WHERE created_at IS NOT NULL),
gone AS (SELECT id FROM ranked WHERE rn <= (SELECT floor(count(*) * 50.0 / 100.0) FROM loaded))""") + """
SELECT id, service_type, created_at, (SELECT count(*) FROM gone) AS would_delete
FROM loaded WHERE id IN (SELECT id FROM gone) ORDER BY created_at, id LIMIT 10""")
def q_red_preview(spark, sf_dir):
    ld = loaded(spark, sf_dir)
    return S.reduce_preview(ld, S.reduce_ids(ld, "newest", 50))


@register("st_table_stats", with_requests(RAW_CTE, CLEAN_CTE) + """
SELECT count(*) AS total, min(created_at) AS min_date, max(created_at) AS max_date FROM loaded""")
def q_table_stats(spark, sf_dir):
    return I.request_stats(loaded(spark, sf_dir))


@register("flt_unresolved_strict", with_requests() + """
SELECT service_request_id, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM requests
WHERE status_type = 'Unresolved'""")
def q_flt_strict(spark, sf_dir):
    return _req(spark, sf_dir).filter(is_unresolved_strict()).select(C.REQUEST_ID, *KEYS)


@register("flt_open", with_requests() + f"""
SELECT service_request_id, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM requests WHERE {OPEN}""")
def q_flt_open(spark, sf_dir):
    return _req(spark, sf_dir).filter(is_open()).select(C.REQUEST_ID, *KEYS)


@register("flt_open_or_unclosed", with_requests() + f"""
SELECT service_request_id, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM requests
WHERE {OPEN} OR date_closed IS NULL""")
def q_flt_open_or_unclosed(spark, sf_dir):
    return _req(spark, sf_dir).filter(is_open_or_unclosed()).select(C.REQUEST_ID, *KEYS)


@register("ing_location", with_requests(RAW_CTE) + f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {LOCATION_SQL} AS location FROM raw""")
def q_location(spark, sf_dir):
    return _raw(spark, sf_dir).select(*KEYS, I.location().alias("location"))
