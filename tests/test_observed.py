"""Counts that the writing job itself takes."""

from pyspark.sql import functions as F

from civiclens.operators import geo as G
from civiclens.operators import ingest as I

RAW = "`Service Request ID` string, `Reference Number` string, `Service Type` string, `Date Created` string, " + ", ".join(
    f"`{c}` string" for c in ("Date Closed", "Electoral District", "Neighbourhood", *I.LEVEL_COLUMNS))


def raw(spark):
    bad = [("", "t", "2024-01-01"), (None, "t", "2024-01-01"), ("9", None, "2024-01-01"), ("8", "t", "no date"), ("7", "t", None)]
    good = [(str(i), "t", "2024-01-01") for i in range(20)]
    return spark.createDataFrame([(a, None, b, c, *[None] * 8) for a, b, c in bad + good], RAW).repartition(4)


def test_clean_counts_come_from_the_write(spark, tmp_path):
    seen = I.load_clean(raw(spark), str(tmp_path / "out"))
    assert seen == I.clean_counts(raw(spark)).first().asDict() == {
        "total": 25, "accepted": 20, "skipped_missing": 3, "skipped_date": 2}
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.exceptAll(I.clean(raw(spark))).count() == 0 and out.count() == 20


def test_required_rows(spark, tmp_path):
    assert I.load_required(raw(spark), str(tmp_path / "out")) == {"total": 25, "dropped": 3}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 22


def test_one_scan(spark):
    """The counts ride on the plan of the write: one scan, not two."""
    from pyspark.sql import Observation
    plan = I.clean(raw(spark), seen=Observation())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CollectMetrics") == 1 and plan.count("LogicalRDD") == 1


def test_features_written_and_matched(spark, tmp_path):
    feats = spark.range(5).select(F.col("id").alias("feature_idx"), F.create_map(
        F.lit("Electoral District"), F.when(F.col("id") < 4, F.concat(F.lit("d"), F.col("id"))).otherwise("")).alias("properties"),
        F.lit(None).cast("string").alias("geometry"))
    geo = spark.createDataFrame([("d0", 1, 2, 3.0), ("d1", 1, 2, None)], "electoral_district string, volume long, unresolved long, slow_p90 double")
    assert G.write_geojson_lines(G.enrich_features(feats, geo), str(tmp_path / "g")) == {
        "features": 5, "with_district": 4, "updated": 2}
