"""Hand-made frames for the semantic traps (nulls, floors, bins, rounding, ties)."""

import datetime as dt

from pyspark.sql import functions as F

from civiclens.functions import predicates as P
from civiclens.functions.binning import AGE_EDGES, AGE_LABELS, bin_label
from civiclens.functions.ranking import rnd
from civiclens.functions.timecalc import floor_days, parse_date
from civiclens.operators import rankings as R

T = dt.datetime


def _req(spark, rows):
    schema = ("service_request_id string, service_level_1 string, date_created timestamp_ntz, "
              "date_closed timestamp_ntz, status_type string, neighbourhood string")
    return spark.createDataFrame(rows, schema)


def test_open_definitions_count_null_status(spark):
    rows = [("1", "A", T(2024, 1, 1), T(2024, 1, 2), "Solved", None),
            ("2", "A", T(2024, 1, 1), None, "Solved", None),
            ("3", "A", T(2024, 1, 1), None, "Unresolved", None),
            ("4", "A", T(2024, 1, 1), None, None, None),
            ("5", "A", T(2024, 1, 1), T(2024, 1, 3), "In Progress", None),
            ("6", "A", T(2024, 1, 1), T(2024, 1, 3), None, None)]
    df = _req(spark, rows)
    assert df.filter(P.is_unresolved_strict()).count() == 1
    assert df.filter(P.is_open()).count() == 4          # null status counts as open
    assert df.filter(P.is_open_or_unclosed()).count() == 5
    assert df.filter(P.is_closed()).count() == 1


def test_floor_days_matches_elapsed_24h_periods(spark):
    base = T(2024, 1, 10)
    cases = [(base - dt.timedelta(hours=1), -1), (base, 0), (base + dt.timedelta(hours=23, minutes=59), 0),
             (base + dt.timedelta(hours=24), 1), (None, None)]
    df = spark.createDataFrame([(base, e, x) for e, x in cases], "s timestamp_ntz, e timestamp_ntz, x long")
    got = df.select(floor_days("e", "s").alias("d"), "x").collect()
    assert [r.d for r in got] == [r.x for r in got]


def test_bins_left_closed(spark):
    vals = [-1, 0, 6, 7, 13, 14, 29, 30, 89, 90, 729, 730]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    got = [r.b for r in df.select(bin_label(F.col("v"), AGE_EDGES, AGE_LABELS).alias("b")).collect()]
    assert got == [None, "0-7 days", "0-7 days", "8-14 days", "8-14 days", "15-30 days", "15-30 days",
                   "31-60 days", "61-90 days", "91-180 days", "1-2 years", "2+ years"]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125,), (2.5,), (3.5,)], "v double")
    assert [r.r for r in df.select(rnd("v", 2).alias("r")).collect()][0] == 0.12
    assert [r.r for r in df.select(rnd("v", 0).alias("r")).collect()][1:] == [2.0, 4.0]


def test_top_volume_ties_break_by_key(spark):
    rows = [(str(i), cat, T(2024, 1, 20), None, "Unresolved", None)
            for i, cat in enumerate(["R", "R", "G", "G", "B"])]
    out = R.top_volume(_req(spark, rows), k=2).collect()
    assert [(r.category, r.volume) for r in out] == [("G", 2), ("R", 2)]
    assert abs(sum(r.pct_of_total for r in out) - 80.0) < 1e-9


def test_trending_rules(spark):
    now = T(2024, 3, 1)
    rows = []
    # previous volume 0 / 4 / 5 -> only the last survives the >= 5 filter
    for cat, prev, rec in (("Z", 0, 3), ("F", 4, 9), ("V", 5, 7)):
        rows += [(f"{cat}p{i}", cat, now - dt.timedelta(days=45), None, None, None) for i in range(prev)]
        rows += [(f"{cat}r{i}", cat, now - dt.timedelta(days=5), None, None, None) for i in range(rec)]
    rows.append(("now", "V", now, None, None, None))
    out = R.top_trending(_req(spark, rows)).collect()
    assert [(r.category, r.previous_volume, r.recent_volume, r.growth_rate) for r in out] == [("V", 5, 8, 60.0)]


def test_parse_date_layouts(spark):
    vals = ["2024-01-02", "1/2/2024", "13/2/2024", "2024-01-02 10:11:12", "1/2/2024 10:11:12",
            " 2024-01-02 ", "garbage", "", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.d for r in df.select(parse_date("s").alias("d")).collect()]
    d = dt.date
    assert got == [d(2024, 1, 2), d(2024, 1, 2), d(2024, 2, 13), d(2024, 1, 2), d(2024, 1, 2),
                   d(2024, 1, 2), None, None, None]


def test_required_columns_report_and_error(spark):
    import pytest
    from civiclens.operators import ingest as I
    df = spark.createDataFrame([("1", None), (None, "x")], "`Service Request ID` string, `Service Type` string")
    rep = {r.column: (r.present, r.non_null_rows) for r in I.column_report(df).collect()}
    assert rep["Service Request ID"] == (True, 1) and rep["Date Created"] == (False, None)
    with pytest.raises(I.MissingColumnsError):
        I.require_columns(df)
