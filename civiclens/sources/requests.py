"""The request fact table, derived from the TPC-H-style test tables.

The test data holds no service requests, so one deterministic mapping turns a
line item (with its order, part, customer and nation) into a request row.  The
same mapping is written as SQL in ``civiclens.plans.oracle.REQUESTS_CTE``.

| request column        | derived from                                         |
| --------------------- | ---------------------------------------------------- |
| service_request_id    | "<l_orderkey>-<l_linenumber>"  (not unique)          |
| service_level_1 / 2   | p_type / p_brand                                     |
| service_type          | "<p_type> <p_brand>"                                 |
| date_created          | o_orderdate                                          |
| date_closed           | l_shipdate when l_linestatus = 'F'                   |
| status_type           | o_orderstatus F/O/P -> Solved/Unresolved/In Progress,|
|                       | null when P and l_returnflag = 'N'                   |
| first_call_resolution | l_returnflag A/R -> Yes/No, N -> null                |
| electoral_district    | n_name (customer nation)                             |
| neighbourhood         | "<n_name>/<c_mktsegment>", null for BUILDING         |

Join order: orders are joined to their customers before meeting line items, so
the lineitem-sized side is shuffled once by order key and once by part key; the
25-row nation table is broadcast after the last shuffle.  Part and customer are left
to AQE, which turns a join into a broadcast only after measuring the side at
run time.  At cluster scale this frame is meant to be written once
(``materialize``) and read back, partitioned by month of creation.
"""

from __future__ import annotations

import hashlib
import os
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclens.functions import columns as C
from civiclens.sources.tables import path_exists, read_table, storage, table_path


LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_returnflag", "l_linestatus", "l_shipdate"]


def joined(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """What a request row is made of, in few bytes: keys, dates, the short names,
    one number for the line and the first-call flag and one for the nation and the
    status.  These are the rows that are shuffled, and what a line item does not
    need goes before the first join.  What the lines of an order share stands
    together, so that it compresses as one piece.  ``request_columns`` makes the
    longer texts afterwards."""
    li = lineitem if lineitem is not None else read_table(spark, sf_dir, "lineitem", LINEITEM_COLUMNS)
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_brand"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])

    # 0 to 3: null, A, R, others but N; 4: N; then 8 for a line without a number
    flag = (F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2)
            .when(F.col("l_returnflag") == "N", 4).when(F.col("l_returnflag").isNotNull(), 3).otherwise(0))
    number = F.coalesce(F.col("l_linenumber").cast("long"), F.lit(0))
    no_number = F.when(F.col("l_linenumber").isNull(), 8).otherwise(0)
    lines = li.select("l_orderkey", "l_partkey", "l_suppkey", (number * 16 + no_number + flag).alias("line"),
                      F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias(C.CLOSED))
    status = (F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
              .when(F.col("o_orderstatus") == "P", 3).otherwise(0))
    custs = cust.filter(F.col("c_nationkey").isNotNull()).select(
        "c_custkey", F.col("c_nationkey").cast("long").alias("nation"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    ords = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias(C.CREATED),
                         status.cast("tinyint").alias("status")).join(
        custs, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", C.CREATED, (F.col("nation") * 4 + F.col("status")).alias("nation_status"), "segment")
    rows = lines.join(ords, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", C.CREATED, "nation_status", "segment",
                       "l_partkey", "l_suppkey", "line", C.CLOSED, "p_type", "p_brand")


def request_columns(rows: DataFrame, nation: DataFrame) -> DataFrame:
    """The request columns of ``joined`` rows; the 25 names are looked up here."""
    line = F.col("line")
    flag, status = line.bitwiseAND(7), F.col("nation_status").bitwiseAND(3)
    number = F.when(line.bitwiseAND(8) == 0, F.shiftright(line, 4)).cast("int")
    named = rows.join(F.broadcast(nation.select(F.col("n_nationkey").cast("long"), "n_name")),
                      F.shiftright("nation_status", 2) == F.col("n_nationkey"))
    return named.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), number.cast("string")).alias(C.REQUEST_ID),
        "l_orderkey", number.alias("l_linenumber"), "l_partkey", "l_suppkey",
        F.concat_ws(" ", "p_type", "p_brand").alias(C.SERVICE_TYPE),
        F.col("p_type").alias(C.LEVEL1),
        F.col("p_brand").alias(C.LEVEL2),
        C.CREATED,
        C.CLOSED,
        F.when(status == 1, F.lit("Solved")).when(status == 2, F.lit("Unresolved"))
         .when((status == 3) & (flag > 0) & (flag < 4), F.lit("In Progress")).alias(C.STATUS),
        F.when(flag == 1, F.lit("Yes")).when(flag == 2, F.lit("No")).alias(C.FCR),
        F.col("n_name").alias(C.DISTRICT),
        F.when(F.col("segment").isNotNull(), F.concat_ws("/", "n_name", "segment")).alias(C.NEIGHBOURHOOD),
    )


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])


def requests(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """``lineitem`` may be a streaming frame: the dimension joins are then
    stream-static joins and the result is a streaming request frame."""
    return request_columns(joined(spark, sf_dir, lineitem), _nation(spark, sf_dir))


def materialize(df: DataFrame, path: str, finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Write the fact table once, partitioned by creation month.

    The ``rebalance`` hint lets AQE size the write: a month holding a third
    of all rows is split over several tasks (skewed rebalance partitions are
    split), small months are coalesced, so file sizes follow the data rather
    than a fixed salt.  Within a file the rows share one month, so Parquet
    min/max statistics on ``date_created`` let time-window filters skip row
    groups.  ``finish`` runs after the shuffle, whose rows stay as short as
    ``df`` has them; the folder's name is made there as well.
    """
    month = F.trunc(F.col(C.CREATED).cast("date"), "month").alias("_month")
    dealt = df.select(month, *df.columns).hint("rebalance", "_month")
    (finish(dealt).drop("_month").withColumn("created_month", F.date_format(C.CREATED, "yyyy-MM"))
       .write.mode("overwrite").option("compression", "zstd").partitionBy("created_month").parquet(path))


# Bump when the derivation in ``requests`` changes, so a table written by an
# older version in a persistent shared folder is not reused.
FACT_VERSION = 3
_BASE_TABLES = ("lineitem", "orders", "part", "customer", "nation")


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Derivation version plus size and modification time of each base file
    (Hadoop FileSystem, so it works on any shared storage)."""
    fs, folder = storage(spark, sf_dir)
    parts = [str(FACT_VERSION), fs.makeQualified(folder).toString()]
    for t in _BASE_TABLES:
        fs, p = storage(spark, table_path(sf_dir, t))
        total, newest = 0, 0
        for st in fs.listStatus(p):
            total += st.getLen()
            newest = max(newest, st.getModificationTime())
        parts.append(f"{t}:{total}:{newest}")
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def fact_path(spark: SparkSession, sf_dir: str) -> str:
    from civiclens.session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), "civiclens", "facts", fingerprint(spark, sf_dir))


def latest_created(spark: SparkSession, sf_dir: str):
    """max(date_created) read from the newest month folder only.

    Month folders are listed from storage metadata (one entry per month);
    only the newest non-empty month is scanned.  The value comes back as a
    Python datetime so callers can use it as a literal: unlike a scalar
    subquery, a literal bound reaches the Parquet scan and skips row groups
    of older months.
    """
    fact_requests(spark, sf_dir)
    root = fact_path(spark, sf_dir)
    fs, p = storage(spark, root)
    months = sorted((st.getPath().getName()[len("created_month="):] for st in fs.listStatus(p)
                     if st.getPath().getName().startswith("created_month=")
                     and "__HIVE_DEFAULT_PARTITION__" not in st.getPath().getName()), reverse=True)
    for m in months:
        v = spark.read.parquet(os.path.join(root, f"created_month={m}")).agg(
            F.max(C.CREATED)).first()[0]
        if v is not None:
            return v
    return None


def fact_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request table as the reference stores it: derived from the base
    tables once, written under the shared checkpoint folder, and read back by
    every query (no five-table join per query).  Keyed by a fingerprint of
    the derivation version and the base files."""
    path = fact_path(spark, sf_dir)
    key = (spark.sparkContext.applicationId, path)
    with _WRITE_LOCK:  # one writer per driver process, even with threaded callers
        if key not in _READERS:
            if not path_exists(spark, os.path.join(path, "_SUCCESS")):
                materialize(joined(spark, sf_dir), path, lambda rows: request_columns(rows, _nation(spark, sf_dir)))
            # one reader per application: its file index (the listing of the
            # month folders) is built once and shared by every later query
            _READERS[key] = spark.read.parquet(path).drop("created_month")
    return _READERS[key]


_WRITE_LOCK = threading.Lock()
_READERS: dict = {}
