"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Comparison mirrors the driver's gate: same column names, same row count, and
equal multisets of rows (columns sorted by name, floats compared after
rounding to 9 significant digits).
"""

from __future__ import annotations

import math
import os
import sys

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from civiclens.sources.tables import TABLES, table_path  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


# Spark simple type names -> DuckDB type names (for the schema check).
_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def schema_diff(sdf, con, sql: str) -> dict:
    s = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
         for f in sdf.schema.fields}
    d = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {k: (s.get(k), d.get(k)) for k in set(s) | set(d) if s.get(k) != d.get(k)}


def compare(spark, name: str, builder, sql: str | None, sf_dir: str, con=None):
    sdf = builder(spark, sf_dir)
    spdf = sdf.toPandas()
    if sql is None:
        return True, f"rows-only {len(spdf)}"
    con = con or duck(sf_dir)
    types = schema_diff(sdf, con, sql)
    if types:
        return False, f"column types differ: {types}"
    opdf = con.execute(sql).df()
    sc, sr = rows_of(spdf)
    oc, orr = rows_of(opdf)
    if sc != oc:
        return False, f"columns differ: spark={sc} oracle={oc}"
    if len(sr) != len(orr):
        return False, f"row count spark={len(sr)} oracle={len(orr)}"
    if sr != orr:
        diff = [(a, b) for a, b in zip(sr, orr) if a != b][:3]
        return False, f"values differ ({len(sr)} rows), e.g. {diff}"
    return True, f"{len(sr)} rows"


def main(argv):
    from civiclens.session import get_spark
    import __spark_entry__ as E
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, orc = E.queries(), E.oracle_sql()
    names = argv or sorted(qs)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, n, qs[n], orc.get(n), sf_dir, con)
        except Exception as e:  # report and continue
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {n}: {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
