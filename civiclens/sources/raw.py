"""Raw request rows as the source system delivers them (strings, messy).

Derived from the same line-item mapping as ``requests``; the values are
rendered as text in the five accepted date layouts plus blanks and garbage,
with missing ids / types, blank levels and padded text, so the ingest rules
have work to do.  ``oracle.RAW_CTE`` is the SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclens.sources.requests import fact_requests, requests

# Raw column headers.
RAW_COLUMNS = ("Service Request ID", "Reference Number", "Service Type", "Date Created",
               "Date Closed", "Electoral District", "Neighbourhood", "Service Level 1",
               "Service Level 2", "Service Level 3", "Service Level 4", "Service Level 5",
               "Status Type", "First call resolution")


def render_date(ts, layout_no) -> F.Column:
    """Text of a timestamp in layout 1..7 (7 = garbage, 6 = ISO between tab,
    spaces and a line end)."""
    y = F.year(ts).cast("string")
    m = F.month(ts).cast("string")
    d = F.dayofmonth(ts).cast("string")
    iso = F.date_format(ts, "yyyy-MM-dd")
    hms = F.date_format(ts, "HH:mm:ss")
    return (F.when(ts.isNull(), F.lit(None).cast("string"))
            .when(layout_no == 1, iso)
            .when(layout_no == 2, F.concat_ws("/", m, d, y))
            .when(layout_no == 3, F.concat_ws("/", d, m, y))
            .when(layout_no == 4, F.concat_ws(" ", iso, hms))
            .when(layout_no == 5, F.concat(F.concat_ws("/", m, d, y), F.lit(" "), hms))
            .when(layout_no == 6, F.concat(F.lit("\t  "), iso, F.lit(" \r\n")))
            .otherwise(F.lit("not a date")))


def raw_requests(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Batch: rendered from the materialized request table.  Streaming: from
    arriving line items joined to the (static) dimension tables."""
    r = requests(spark, sf_dir, lineitem) if lineitem is not None else fact_requests(spark, sf_dir)
    ln = F.col("l_linenumber")
    sid = F.when((ln == 7) & (F.col("status_type") == "Unresolved"), F.lit(None)).otherwise(
        F.col("service_request_id"))
    stype = (F.when((ln == 6) & (F.col("electoral_district") == "NATION_0"), F.lit(None))
              .when((ln == 5) & (F.col("electoral_district") == "NATION_1"), F.lit(""))
              .otherwise(F.col("service_type")))
    closed_layout = ((ln + F.lit(2)) % F.lit(7)) + F.lit(1)
    return r.select(
        *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        sid.alias("Service Request ID"),
        F.when(ln == 3, F.lit(None)).when(ln == 4, F.lit(""))
         .otherwise(F.concat(F.lit(" REF"), F.col("l_orderkey").cast("string"), F.lit("\n")))
         .alias("Reference Number"),
        stype.alias("Service Type"),
        render_date(F.col("date_created"), ln).alias("Date Created"),
        render_date(F.col("date_closed"), closed_layout).alias("Date Closed"),
        F.col("electoral_district").alias("Electoral District"),
        F.col("neighbourhood").alias("Neighbourhood"),
        F.col("service_level_1").alias("Service Level 1"),
        F.when(ln == 2, F.lit("   ")).otherwise(F.col("service_level_2")).alias("Service Level 2"),
        F.when(ln <= 3, F.concat(F.lit(" "), F.col("status_type"), F.lit(" ")))
         .alias("Service Level 3"),
        F.lit(None).cast("string").alias("Service Level 4"),
        F.when(ln == 1, F.col("electoral_district")).alias("Service Level 5"),
        F.col("status_type").alias("Status Type"),
        F.col("first_call_resolution").alias("First call resolution"),
    )
