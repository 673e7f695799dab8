"""Invariants of the published products (FIXTURES.md §3) checked on ours,
plus the catalog smoke test (load one, load several, unknown id)."""

import pytest
from pyspark.sql import functions as F

from civiclens.operators import closing as CL
from civiclens.operators import frequency as FQ
from civiclens.operators import priority as P
from civiclens.operators import products as PR
from civiclens.sources.requests import requests

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def req(spark):
    return requests(spark, SF).cache()


def test_bin_counts_add_up_to_totals_and_closed_counts(req):
    prod = CL.close_product(req).toPandas()
    per_cat = prod.groupby("service_level_1")["bin_count"].sum()
    totals = prod.groupby("service_level_1")["total_count"].first()
    assert (per_cat == totals).all()
    pq = P.priority(req).toPandas().set_index("group")["closed_count"]
    assert (pq.loc[totals.index] == totals).all()


def test_frequency_cells_add_up_to_rows(req):
    wide = FQ.frequency_pivot(req).toPandas()
    n = req.filter(F.col("date_created").isNotNull() & F.col("service_level_1").isNotNull()).count()
    assert int(wide.drop(columns=["Time"]).to_numpy().sum()) == n


def test_seasonality_cell_is_mean_of_nonzero_monthly_cells(req):
    long = FQ.frequency_long(req).toPandas()
    long["month"] = long["Time"].str[5:7].astype(int)
    exp = long.groupby(["service_level_1", "month"])["frequency"].mean()
    heat = FQ.seasonality(req).toPandas().set_index("service_category")
    for (cat, m), v in exp.items():
        assert abs(heat.loc[cat, FQ.MONTH_NAMES[m - 1]] - v) < 1e-6


def test_priority_counts_add_up(req):
    pq = P.priority(req).toPandas()
    assert pq["request_count"].sum() == req.filter(F.col("service_level_1").isNotNull()).count()
    assert (pq["open_count"] + pq["closed_count"] <= pq["request_count"]).all()


def test_catalog_smoke(spark, req):
    assert PR.load(spark, SF, "no_such_product") is None
    for pid in PR.CATALOG:
        df = PR.load(spark, SF, pid, req)
        assert df is not None and df.count() >= 0
    many = PR.load_many(spark, SF, ["fcr_by_category", "missing", "top10"])
    assert sorted(many) == ["fcr_by_category", "top10"]
    assert PR.listing(spark).count() == len(PR.CATALOG)


def test_fact_table_written_once_and_equal_to_derivation(spark):
    from civiclens.sources.requests import fact_requests, fingerprint
    a = fact_requests(spark, SF)
    files_a = sorted(a.inputFiles())
    b = fact_requests(spark, SF)
    assert sorted(b.inputFiles()) == files_a                  # reused, not rewritten
    assert fingerprint(spark, SF) == fingerprint(spark, SF)
    derived = requests(spark, SF)
    assert a.columns == derived.columns
    assert a.exceptAll(derived).count() == 0 and derived.exceptAll(a).count() == 0


def test_fact_rows_are_shuffled_before_their_texts_are_made(spark, monkeypatch, tmp_path):
    """The derived texts are made after the shuffle by month, of the same rows."""
    from civiclens.functions import columns as C
    from civiclens.sources import requests as R
    given = []
    write = R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, *rest: given.append(df) or write(df, *rest))
    monkeypatch.setattr(R, "fact_path", lambda *_: str(tmp_path / "fact"))
    stored = R.fact_requests(spark, SF)
    (df,) = given
    assert not {C.REQUEST_ID, C.SERVICE_TYPE, C.NEIGHBOURHOOD, C.STATUS, C.FCR} & set(df.columns)
    derived = R.requests(spark, SF)
    assert stored.columns == derived.columns
    assert stored.exceptAll(derived).isEmpty() and derived.exceptAll(stored).isEmpty()


def test_fact_rows_move_one_number_for_line_status_and_flag(spark, tmp_path):
    """Line numbers (null and negative too), status and flags come back from one
    number, and a line's ship date is dropped before the join unless it counts."""
    from itertools import product
    from civiclens.sources import requests as R
    flags, states, numbers = ["A", "R", "N", "X", None], ["F", "O", "P", "Y", None], [-3, 0, 7, 2 ** 31 - 1, None]
    lines = [(i, n, f) for i, _ in enumerate(states) for n, f in product(numbers, flags)]
    for name, rows, schema in (
            ("lineitem", [(o, 1, 2, n, f, "F" if o % 2 else "O", "1995-01-02") for o, n, f in lines],
             "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, "
             "l_linestatus string, ship string"),
            ("orders", [(i, 5, s, "1994-01-02") for i, s in enumerate(states)],
             "o_orderkey long, o_custkey long, o_orderstatus string, day string"),
            ("part", [(1, "SMALL", "Brand#1")], "p_partkey long, p_type string, p_brand string"),
            ("customer", [(5, 3, "BUILDING")], "c_custkey long, c_nationkey int, c_mktsegment string"),
            ("nation", [(3, "NATION_3")], "n_nationkey int, n_name string")):
        df = spark.createDataFrame(rows, schema)
        for text, date in (("ship", "l_shipdate"), ("day", "o_orderdate")):
            if text in df.columns:
                df = df.withColumn(date, df[text].cast("timestamp_ntz")).drop(text)
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    moved = R.joined(spark, str(tmp_path))
    assert not {"l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "o_orderstatus"} & set(moved.columns)
    got = sorted(repr((r.l_orderkey, r.l_linenumber, r.status_type, r.first_call_resolution, r.date_closed is None))
                 for r in R.requests(spark, str(tmp_path)).collect())

    def status(state, flag):
        if state == "P":
            return "In Progress" if flag not in ("N", None) else None
        return {"F": "Solved", "O": "Unresolved"}.get(state)
    assert got == sorted(repr((o, n, status(states[o], f), {"A": "Yes", "R": "No"}.get(f), o % 2 == 0))
                         for o, n, f in lines)


def test_nations_are_looked_up_after_the_shuffle(spark, tmp_path):
    """The shuffled rows hold a nation's number with the status (numbers may be
    negative or null), not its name, and no segment that is not shown."""
    from civiclens.sources import requests as R
    nations, segments = [-3, 0, 24, 99, None], ["BUILDING", "AUTO", None]
    custs = [(i * 3 + j, n, s) for i, n in enumerate(nations) for j, s in enumerate(segments)]
    for name, rows, schema in (
            ("lineitem", [(c, 1, 2, 1, "A", "F") for c, _, _ in custs],
             "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string"),
            ("orders", [(c, c, "FOP"[c % 3]) for c, _, _ in custs], "o_orderkey long, o_custkey long, o_orderstatus string"),
            ("part", [(1, "SMALL", "Brand#1")], "p_partkey long, p_type string, p_brand string"),
            ("customer", custs, "c_custkey long, c_nationkey int, c_mktsegment string"),
            ("nation", [(-3, "minus"), (0, "zero"), (24, None), (None, "none")], "n_nationkey int, n_name string")):
        df = spark.createDataFrame(rows, schema)
        for date in {"lineitem": ["l_shipdate"], "orders": ["o_orderdate"]}.get(name, []):
            df = df.selectExpr("*", f"timestamp_ntz'1994-01-02' AS {date}")
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    moved = R.joined(spark, str(tmp_path))
    assert not {"n_name", "status", "c_mktsegment"} & set(moved.columns)
    assert "BUILDING" not in {r.segment for r in moved.collect()}
    names, states = {-3: "minus", 0: "zero", 24: None}, ("Solved", "Unresolved", "In Progress")
    want = [(c, names[n], "/".join(x for x in (names[n], s) if x) if s == "AUTO" else None, states[c % 3])
            for c, n, s in custs if n in names]
    got = [(r.l_orderkey, r.electoral_district, r.neighbourhood, r.status_type)
           for r in R.requests(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
