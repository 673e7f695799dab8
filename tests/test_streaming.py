"""Watermarked window counts: late rows are dropped, closed windows emitted once."""

import datetime as dt
import os
import tempfile
import time

import pytest

from civiclens.sources.store import VersionedTable
from civiclens.streaming import jobs
from civiclens.streaming.jobs import volume_windows


def _write(spark, rows, path):
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").coalesce(1) \
        .write.mode("overwrite").parquet(path)


def test_late_rows_dropped(spark):
    root = tempfile.mkdtemp(prefix="civiclens-stream-test-")
    src = os.path.join(root, "src")
    day = dt.datetime(2024, 1, 1)
    # batch 1: days 0..19; batch 2: one row on day 2 (behind the watermark,
    # dropped) and rows on day 25 (advance the watermark, close windows)
    _write(spark, [(i, day + dt.timedelta(days=i, hours=1), "a") for i in range(20)], os.path.join(src, "b1"))
    schema = "event_id long, ts timestamp_ntz, event_type string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(src)
    out = os.path.join(root, "out")
    q = (volume_windows(stream, days=1, slide_days=1, delay="1 day").writeStream.outputMode("append")
         .format("parquet").option("path", out).option("checkpointLocation", os.path.join(root, "ck"))
         .trigger(processingTime="1 second").start())
    try:
        q.processAllAvailable()
        time.sleep(1)
        _write(spark, [(100, day + dt.timedelta(days=2, hours=5), "a"),
                       (101, day + dt.timedelta(days=25), "a"),
                       (102, day + dt.timedelta(days=25, hours=1), "a")], os.path.join(src, "b2"))
        q.processAllAvailable()
        time.sleep(1)
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.window_start: r["count"] for r in spark.read.parquet(out).collect()}
    assert got[day + dt.timedelta(days=2)] == 1          # the late row did not count
    assert len([k for k in got if k < day + dt.timedelta(days=20)]) == 20
    assert all(v == 1 for v in got.values())


RAW = ("`Service Request ID` string, `Reference Number` string, `Service Type` string, `Date Created` string, "
       "`Date Closed` string, `Electoral District` string, `Neighbourhood` string, `Service Level 1` string, "
       "`Service Level 2` string, `Service Level 3` string, `Service Level 4` string, `Service Level 5` string, "
       "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long")


def _land(spark, folder, name, rows):
    full = [(r[0], None, "type", "2024-01-02", None, None, None, r[1], None, None, None, None, r[2], 1, 1, 1)
            for r in rows]
    spark.createDataFrame(full, RAW).coalesce(1).write.parquet(os.path.join(folder, name))


def test_ingest_stops_in_mid_run_and_goes_on(spark, tmp_path):
    """A job lost between the write of a batch and its note in the checkpoint,
    and one lost before the write, lose and repeat nothing."""
    source, folder = str(tmp_path / "raw"), str(tmp_path / "job")
    for i in range(4):
        _land(spark, source, f"part-{i}", [(f"r{j}", f"from {i}", 100 * i + j) for j in range(i * 3, i * 3 + 8)])
    _flatten(source)
    calls = []

    def failing(df, i, target, buckets):
        calls.append(i)
        if len(calls) == 2:
            raise OSError("lost before the write")
        jobs.ingest_batch(df, i, target, buckets)
        if len(calls) == 4:
            raise OSError("lost after the write")

    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            jobs.run_ingest(spark, source, folder, max_files=1, on_batch=failing)
    out = jobs.run_ingest(spark, source, folder, max_files=1, on_batch=failing)
    assert len(calls) == len(set(calls)) + 2  # two batches ran twice
    got = {r.service_request_id: r.description for r in out.collect()}
    first = {}
    for i in range(4):
        for j in range(i * 3, i * 3 + 8):
            first.setdefault(f"r{j}", f"from {i}")
    assert out.count() == len(got) and set(got) == set(first)
    store = VersionedTable(spark, os.path.join(folder, "requests"))
    assert len(store.versions()) == len(set(calls))  # each batch published once


def _flatten(folder):
    """Part files of several writes side by side, as files land."""
    for name in sorted(n for n in os.listdir(folder) if os.path.isdir(os.path.join(folder, n))):
        for f in os.listdir(os.path.join(folder, name)):
            if f.endswith(".parquet"):
                os.rename(os.path.join(folder, name, f), os.path.join(folder, f"{name}.parquet"))


def test_a_later_run_takes_only_what_is_new(spark, tmp_path):
    source, folder = str(tmp_path / "raw"), str(tmp_path / "job")
    _land(spark, source, "part-0", [("a", "first", 1), ("a", "second", 2), ("b", "b", 3)])
    _flatten(source)
    assert jobs.run_ingest(spark, source, folder, redelivery="1 hour").count() == 2
    before = VersionedTable(spark, os.path.join(folder, "requests")).manifest()
    _land(spark, source, "part-1", [("a", "late", 0), ("c", "c", 4), ("c", "c", 4), ("b", "b", 3)])
    _flatten(source)
    out = jobs.run_ingest(spark, source, folder, redelivery="1 hour")
    assert {(r.service_request_id, r.description) for r in out.collect()} == {("a", "first"), ("b", "b"), ("c", "c")}
    after = VersionedTable(spark, os.path.join(folder, "requests")).manifest()
    kept = [b for b in before.folders if before.folders[b] == after.folders.get(b)]
    assert len(kept) >= len(before.folders) - 3 or len(before.folders) <= 2


def test_only_the_columns_a_batch_reads_reach_the_state_store(spark, tmp_path):
    from civiclens.functions.columns import ROW_ORDER
    from civiclens.operators import ingest as I
    source, seen = str(tmp_path / "raw"), []
    _land(spark, source, "part-0", [("a", "first", 1), ("b", "b", 2)])
    _flatten(source)
    columns = [*ROW_ORDER, *I.CLEAN_COLUMNS]

    def batch(df, i, target, buckets):
        seen.append(df.columns)
        jobs.ingest_batch(df, i, target, buckets)
    wide = spark.read.parquet(source).selectExpr("*", "'x' AS `Status Type`")
    wide.write.parquet(str(tmp_path / "wide"))
    out = jobs.run_ingest(spark, str(tmp_path / "wide"), columns=columns, on_batch=batch)
    assert {r.service_request_id for r in out.collect()} == {"a", "b"} and all(c == columns for c in seen)
