import os

import pytest
from pyspark.sql import functions as F

from civiclens.sources.store import ConflictError, VersionedTable

SCHEMA = "id long, part string, value double, note string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"p{i % 3}", float(i), "old") for i in range(200)], SCHEMA)
    return VersionedTable.create(df, str(tmp_path / "t"), ["id", "part"], buckets=16)


def files(table):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{table.root}/data") for f in fs if f.endswith(".parquet")}


def test_update_rewrites_only_touched_buckets(spark, table):
    before, old, was = table.manifest(), rows(table.read()), files(table)
    new = spark.createDataFrame([(5, None, 1.5, "new"), (6, "p0", None, "new"), (6, "p9", 9.0, "new")], SCHEMA)
    assert table.upsert(new) == {"updated": 2, "inserted": 1, "skipped": 0}
    after, touched = table.manifest(), set(table.buckets_of(new))
    assert 0 < len(touched) <= 3
    assert {b for b in before.folders if before.folders[b] != after.folders.get(b)} <= {str(b) for b in touched}
    assert was < files(table)  # old files keep their names
    want = [r for r in old if r[:2] not in {(5, None), (6, "p0")}] + [(5, None, 1.5, "new"), (6, "p0", None, "new"), (6, "p9", 9.0, "new")]
    assert rows(table.read()) == sorted(want, key=repr)
    assert rows(table.read(version=1)) == old  # the old version stays readable


def test_scan_of_an_update_names_only_touched_buckets(spark, table):
    one = spark.createDataFrame([(7, "p1", 0.0, "x")], SCHEMA)
    assert len(table.read(buckets=table.buckets_of(one)).inputFiles()) < len(table.read().inputFiles()) / 4


def test_fill_skip_and_insert_if_absent(spark, table):
    new = spark.createDataFrame([(7, "p1", None, "n"), (999, "q", 1.0, "n")], SCHEMA)
    assert table.upsert(new, how="fill", insert=False) == {"updated": 1, "inserted": 0, "skipped": 1}
    assert rows(table.read().filter("id in (7, 999)")) == [(7, "p1", 7.0, "n")]
    assert table.upsert(new, update=False) == {"updated": 0, "inserted": 1, "skipped": 1}
    assert rows(table.read().filter("id in (7, 999)")) == [(7, "p1", 7.0, "n"), (999, "q", 1.0, "n")]
    part = new.select("id", "part", F.lit(3).alias("value"))  # other type, not all columns
    assert table.upsert(part) == {"updated": 2, "inserted": 0, "skipped": 0}
    assert rows(table.read().filter("id in (7, 999)")) == [(7, "p1", 3.0, "n"), (999, "q", 3.0, "n")]


def test_repeated_keys_and_no_updates(spark, table):
    twice = spark.createDataFrame([(1, "p1", 1.0, "a"), (1, "p1", 2.0, "b"), (1, "p1", 2.0, "a")], SCHEMA)
    assert table.upsert(twice)["updated"] == 1
    assert rows(table.read().filter("id = 1")) == [(1, "p1", 2.0, "b")]
    assert table.upsert(twice.limit(0)) == {"updated": 0, "inserted": 0, "skipped": 0}
    assert table.read().count() == 200


def test_delete_and_set_columns(spark, table):
    gone = spark.createDataFrame([(0, None), (1, "p1"), (2, "other")], "id long, part string")
    assert table.delete(gone) == 2 and table.read().count() == 198
    table.set_columns(note=F.lit(None))
    assert table.read().filter("note is not null").count() == 0 and table.manifest().version == 3


def test_a_lost_writer_leaves_the_old_version(spark, table, monkeypatch):
    old = rows(table.read())

    def lost(*_):
        raise OSError("lost")
    monkeypatch.setattr(table.files, "publish", lost)
    with pytest.raises(OSError, match="lost"):
        table.upsert(spark.createDataFrame([(5, None, 1.5, "new")], SCHEMA))
    again = VersionedTable(spark, table.root)
    assert again.versions() == [1] and rows(again.read()) == old


def test_of_two_writers_the_later_one_is_told(spark, table):
    other = VersionedTable(spark, table.root)
    stale = other.manifest()
    other.manifest = lambda version=None: stale
    new = spark.createDataFrame([(5, None, 1.5, "new")], SCHEMA)
    table.upsert(new)
    with pytest.raises(ConflictError):
        other.upsert(new)
    assert table.versions() == [1, 2]


def test_an_empty_table_takes_rows(spark, tmp_path):
    t = VersionedTable.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"), ["id"], 4)
    assert t.read().count() == 0
    assert t.upsert(spark.createDataFrame([(1, "a", 1.0, "x")], SCHEMA))["inserted"] == 1 and t.read().count() == 1
