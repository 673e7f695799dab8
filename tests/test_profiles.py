"""Kept product profiles: slices, order, failures, and the refresh of one."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from civiclens.operators import products as PR
from civiclens.plans import products as plans
from civiclens.sources.requests import fact_requests

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reqs(spark):
    return fact_requests(spark, SF)


def test_profiles_are_kept_and_one_is_refreshed_alone(spark, reqs):
    root = os.path.join(tempfile.mkdtemp(prefix="civiclens-profiles-"), "p")
    ids = ["fcr_by_category", "frequency_over_time", "top10", "top10_trending_up"]
    PR.write_profiles(reqs, root, ids, max_rows=4)
    got = {r.product_id: r for r in PR.read_profiles(spark, root).collect()}
    assert set(got) == set(ids) and {r.status for r in got.values()} == {"ok"}
    months = sorted(r[0] for r in PR.load(spark, SF, "frequency_over_time", reqs).select("Time").collect())
    assert [json.loads(v)["Time"] for v in got["frequency_over_time"].rows] == months[::-1][:4]
    assert got["frequency_over_time"].row_count == len(months)
    up = got["top10_trending_up"]
    assert up.predicate and {json.loads(v)["ranking_type"] for v in up.rows} <= {"Trending Up"}
    assert up.columns == got["top10"].columns and up.row_count <= 10
    names = {d: sorted(os.listdir(os.path.join(root, f"product_id={d}"))) for d in ids}
    PR.write_profiles(reqs.filter(F.col("first_call_resolution") == "Yes"), root, ["fcr_by_category"], max_rows=2)
    after = {r.product_id: r for r in PR.read_profiles(spark, root).collect()}
    assert set(after) == set(ids) and len(after["fcr_by_category"].rows) <= 2
    changed = {d for d in ids if sorted(os.listdir(os.path.join(root, f"product_id={d}"))) != names[d]}
    assert changed == {"fcr_by_category"}


def test_a_failing_product_is_reported_and_an_empty_table_has_no_rows(spark, reqs):
    root = os.path.join(tempfile.mkdtemp(prefix="civiclens-profiles-"), "p")
    PR.write_profiles(reqs.drop("first_call_resolution").limit(0), root, ["fcr_by_category", "geographic_hot_spots"])
    got = {r.product_id: r for r in PR.read_profiles(spark, root).collect()}
    assert got["fcr_by_category"].status == "failed: AnalysisException" and got["fcr_by_category"].row_count is None
    assert got["geographic_hot_spots"].status == "ok"
    assert (got["geographic_hot_spots"].row_count, got["geographic_hot_spots"].rows) == (0, [])


@pytest.mark.parametrize("broken", ["missing", "raising"])
def test_a_failing_product_stops_the_query_without_a_status(spark, reqs, monkeypatch, broken):
    fcr = "first_call_resolution"
    bad = reqs.drop(fcr) if broken == "missing" else reqs.withColumn(fcr, F.raise_error(F.lit("bad")).cast("string"))
    monkeypatch.setattr(plans, "fact_requests", lambda *_: bad)
    with pytest.raises(RuntimeError, match="products failed: fcr_by_category") as e:
        plans.q_sum_rows(spark, SF)
    assert type(e.value.__cause__).__name__ == ("AnalysisException" if broken == "missing" else "SparkRuntimeException")
    if broken == "missing":
        status = {r.product_id: (r.status, r.rows) for r in plans.q_sum_all(spark, SF).collect()}
        assert status.pop("fcr_by_category") == ("failed: AnalysisException", None)
        assert len(status) == 14 and {s for s, _ in status.values()} == {"ok"}


def test_the_other_products_are_kept_when_strict_raises(spark, reqs):
    root = os.path.join(tempfile.mkdtemp(prefix="civiclens-profiles-"), "p")
    with pytest.raises(RuntimeError, match="products failed: fcr_by_category$"):
        PR.write_profiles(reqs.drop("first_call_resolution"), root, ["fcr_by_category", "geographic_hot_spots"],
                          strict=True)
    got = {r.product_id: r.status for r in PR.read_profiles(spark, root).collect()}
    assert got == {"fcr_by_category": "failed: AnalysisException", "geographic_hot_spots": "ok"}
