import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from civiclens.functions import columns as C
from civiclens.operators import closing as CL
from civiclens.operators import fcr as FC
from civiclens.operators import frequency as FQ
from civiclens.operators import geo as G
from civiclens.operators import incremental as N
from civiclens.sources.monthly import MonthlyState

SCHEMA = (f"{C.LEVEL1} string, {C.DISTRICT} string, {C.FCR} string, {C.STATUS} string, "
          f"{C.CREATED} timestamp, {C.CLOSED} timestamp")


def requests(spark, months, seed=0):
    out = []
    for m in months:
        for i in range(60):
            k = i * 7 + m * 13 + seed
            created = dt.datetime(2024, m, 1 + k % 27, k % 24)
            closed = created + dt.timedelta(days=k % 40 - 3, hours=k % 11) if k % 3 else None
            out.append((f"c{k % 4}" if k % 9 else None, f"d{k % 5}" if k % 8 else None, ("Yes", "No", None)[k % 3],
                        ("Solved", "Unresolved", None, "Solved")[k % 4], created, closed))
    return spark.createDataFrame(out, SCHEMA)


def add(df, source, mode="append"):
    df.withColumn("created_month", F.date_format(C.CREATED, "yyyy-MM")).write.mode(mode).partitionBy(
        "created_month").parquet(source)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def full(spark, source):
    return spark.read.parquet(source).drop("created_month")


def check(spark, state, source):
    req, cells = full(spark, source), state.read()
    for mine, other in [(N.close_percentiles, CL.close_percentiles), (N.close_hist, CL.close_hist),
                        (N.close_overall, CL.close_overall), (N.frequency_long, FQ.frequency_long),
                        (N.fcr_rate, FC.fcr_rate), (N.geo_metrics, G.geo_metrics)]:
        a, b = mine(cells), other(req)
        assert a.columns == b.columns and rows(a) == rows(b), mine.__name__


@pytest.fixture
def watched(spark, tmp_path):
    read = []

    def partial(df):
        read.append(sorted({f.split("created_month=")[1].split("/")[0] for f in df.inputFiles()}))
        return N.cells(df)
    return MonthlyState(spark, str(tmp_path / "state"), partial), str(tmp_path / "fact"), read


def test_one_added_month_is_the_only_one_read(spark, watched):
    state, source, read = watched
    add(requests(spark, [1, 2, 3]), source)
    assert state.refresh(source) == ["2024-01", "2024-02", "2024-03"]
    check(spark, state, source)
    folders = state.manifest().folders
    add(requests(spark, [4]), source)
    assert state.refresh(source) == ["2024-04"] and read[-1] == ["2024-04"]
    assert {m: f for m, f in state.manifest().folders.items() if m != "2024-04"} == folders
    check(spark, state, source)
    assert state.refresh(source) == [] and len(read) == 2


def test_a_changed_and_a_removed_month(spark, watched):
    state, source, read = watched
    add(requests(spark, [1, 2, 3]), source)
    state.refresh(source)
    add(requests(spark, [2], seed=5), source)  # late rows of an old month
    assert state.refresh(source) == ["2024-02"] and read[-1] == ["2024-02"]
    check(spark, state, source)
    os.rename(f"{source}/created_month=2024-03", f"{source}/_gone")
    assert state.refresh(source) == [] and sorted(state.manifest().folders) == ["2024-01", "2024-02"]
    check(spark, state, source)


def test_a_lost_refresh_leaves_the_version_before(spark, watched, monkeypatch):
    state, source, _ = watched
    add(requests(spark, [1]), source)
    state.refresh(source)
    before = rows(state.read())
    add(requests(spark, [2]), source)

    def lost(*_):
        raise OSError("lost")
    monkeypatch.setattr(state.files, "publish", lost)
    with pytest.raises(OSError, match="lost"):
        state.refresh(source)
    monkeypatch.undo()
    assert rows(state.read()) == before
    assert state.refresh(source) == ["2024-02"]
    check(spark, state, source)
