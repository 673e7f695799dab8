"""File sources: read-through snapshot TTL, CSV round trip, GeoJSON reader."""

import datetime as dt
import json
import os
import tempfile

from civiclens.sources import files


def test_snapshot_ttl_and_force_refresh(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="civiclens-snap-"), "snap")
    builds = []

    def build():
        builds.append(1)
        return spark.range(len(builds) * 10)

    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    assert files.cached_snapshot(spark, build, root, now=t0).count() == 10
    assert files.cached_snapshot(spark, build, root, now=t0 + dt.timedelta(hours=23)).count() == 10
    assert len(builds) == 1                                     # reused inside the TTL
    assert files.cached_snapshot(spark, build, root, now=t0 + dt.timedelta(hours=25)).count() == 20
    assert files.cached_snapshot(spark, build, root, now=t0 + dt.timedelta(hours=26),
                                 force_refresh=True).count() == 30
    assert len(builds) == 3


def test_csv_round_trip_and_geojson_collection(spark):
    d = tempfile.mkdtemp(prefix="civiclens-files-")
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v long")
    files.write_csv(df, os.path.join(d, "csv"), single_file=True)
    back = files.read_csv(spark, os.path.join(d, "csv"), "k string, v long")
    assert sorted(back.collect()) == sorted(df.collect())
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"Electoral District": "X", "n": 1}, "geometry": None},
        {"type": "Feature", "properties": {"electoral_district": "Y"},
         "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}]}
    p = os.path.join(d, "fc.geojson")
    with open(p, "w") as f:
        json.dump(doc, f)
    from civiclens.operators.geo import district_of
    got = files.read_geojson(spark, p).select("feature_idx", district_of().alias("d")).collect()
    assert [(r.feature_idx, r.d) for r in sorted(got)] == [(0, "X"), (1, "Y")]
