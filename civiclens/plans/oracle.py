"""DuckDB SQL used as the independent oracle for each registered query.

``REQUESTS_CTE`` is the SQL twin of ``civiclens.sources.requests.requests``;
every request-based oracle starts with it.  Conventions (SURVEY 7.4): counts
BIGINT, metrics DOUBLE rounded with ``round_even`` where Spark uses ``bround``,
floor-day durations as ``floor(epoch_us diff / 86400000000.0)``.
"""

REQUESTS_CTE = """
requests AS (
  SELECT
    CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS service_request_id,
    l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
    p.p_type || ' ' || p.p_brand AS service_type,
    p.p_type AS service_level_1,
    p.p_brand AS service_level_2,
    o.o_orderdate AS date_created,
    CASE WHEN l.l_linestatus = 'F' THEN l.l_shipdate END AS date_closed,
    CASE WHEN o.o_orderstatus = 'F' THEN 'Solved'
         WHEN o.o_orderstatus = 'O' THEN 'Unresolved'
         WHEN o.o_orderstatus = 'P' AND l.l_returnflag <> 'N' THEN 'In Progress' END AS status_type,
    CASE WHEN l.l_returnflag = 'A' THEN 'Yes'
         WHEN l.l_returnflag = 'R' THEN 'No' END AS first_call_resolution,
    n.n_name AS electoral_district,
    CASE WHEN c.c_mktsegment <> 'BUILDING' THEN n.n_name || '/' || c.c_mktsegment END AS neighbourhood
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""


def days(end: str, start: str) -> str:
    """Floor of elapsed 24h periods, as SQL text."""
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / 86400000000.0) AS BIGINT)"


def with_requests(*ctes: str) -> str:
    """``WITH requests AS (...), <ctes>`` prefix."""
    parts = [REQUESTS_CTE.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n"


NOW = "(SELECT max(date_created) FROM requests)"
OPEN = "status_type IS DISTINCT FROM 'Solved'"
SOLVED = "coalesce(status_type = 'Solved', false)"


def _render(ts: str, layout: str) -> str:
    y, m, d = f"CAST(year({ts}) AS VARCHAR)", f"CAST(month({ts}) AS VARCHAR)", f"CAST(day({ts}) AS VARCHAR)"
    iso, hms = f"strftime({ts}, '%Y-%m-%d')", f"strftime({ts}, '%H:%M:%S')"
    return f"""CASE WHEN {ts} IS NULL THEN NULL
      WHEN {layout} = 1 THEN {iso}
      WHEN {layout} = 2 THEN {m} || '/' || {d} || '/' || {y}
      WHEN {layout} = 3 THEN {d} || '/' || {m} || '/' || {y}
      WHEN {layout} = 4 THEN {iso} || ' ' || {hms}
      WHEN {layout} = 5 THEN {m} || '/' || {d} || '/' || {y} || ' ' || {hms}
      WHEN {layout} = 6 THEN chr(9) || '  ' || {iso} || ' ' || chr(13) || chr(10)
      ELSE 'not a date' END"""


RAW_CTE = f"""
raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_linenumber = 7 AND status_type = 'Unresolved' THEN NULL ELSE service_request_id END
      AS "Service Request ID",
    CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN ''
         ELSE ' REF' || CAST(l_orderkey AS VARCHAR) || chr(10) END AS "Reference Number",
    CASE WHEN l_linenumber = 6 AND electoral_district = 'NATION_0' THEN NULL
         WHEN l_linenumber = 5 AND electoral_district = 'NATION_1' THEN ''
         ELSE service_type END AS "Service Type",
    {_render('date_created', 'l_linenumber')} AS "Date Created",
    {_render('date_closed', '(((l_linenumber + 2) % 7) + 1)')} AS "Date Closed",
    electoral_district AS "Electoral District",
    neighbourhood AS "Neighbourhood",
    service_level_1 AS "Service Level 1",
    CASE WHEN l_linenumber = 2 THEN '   ' ELSE service_level_2 END AS "Service Level 2",
    CASE WHEN l_linenumber <= 3 THEN ' ' || status_type || ' ' END AS "Service Level 3",
    CAST(NULL AS VARCHAR) AS "Service Level 4",
    CASE WHEN l_linenumber = 1 THEN electoral_district END AS "Service Level 5",
    status_type AS "Status Type",
    first_call_resolution AS "First call resolution"
  FROM requests)"""


def strip_sql(x: str) -> str:
    """Text without ASCII white space at its ends (all that the raw rows hold)."""
    return f"trim({x}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def parse_date_sql(col: str) -> str:
    s = strip_sql(f"CAST({col} AS VARCHAR)")
    fmts = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M:%S"]
    tries = ", ".join(f"try_strptime({s}, '{f}')" for f in fmts)
    return f"CAST(coalesce({tries}) AS DATE)"


def _present(c: str) -> str:
    return f"nullif({strip_sql(c)}, '')"


DESCRIPTION_SQL = ("nullif(concat_ws(' > ', " + ", ".join(
    _present(f'"Service Level {i}"') for i in range(1, 6)) + "), '')")
LOCATION_SQL = ("nullif(concat_ws(', ', " + strip_sql('"Electoral District"') + ", "
                + strip_sql('"Neighbourhood"') + "), '')")

CLEAN_CTE = f"""
clean AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    {strip_sql('"Service Request ID"')} AS service_request_id,
    CASE WHEN "Reference Number" IS NULL OR "Reference Number" = '' THEN NULL
         ELSE {strip_sql('"Reference Number"')} END AS ref_number,
    {strip_sql('"Service Type"')} AS service_type,
    {DESCRIPTION_SQL} AS description,
    CAST({parse_date_sql('"Date Created"')} AS TIMESTAMP) AS created_at,
    CAST({parse_date_sql('"Date Closed"')} AS TIMESTAMP) AS resolved_at,
    {LOCATION_SQL} AS location
  FROM raw
  WHERE "Service Request ID" IS NOT NULL AND "Service Request ID" <> ''
    AND "Service Type" IS NOT NULL AND "Service Type" <> ''
    AND {parse_date_sql('"Date Created"')} IS NOT NULL),
loaded AS (
  SELECT * EXCLUDE (rk), l_orderkey * 4294967296 + l_linenumber AS id FROM (
    SELECT *, row_number() OVER (PARTITION BY service_request_id
                                 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rk
    FROM clean) WHERE rk = 1)"""
