"""Inputs the test tables never hold, and plans that must keep their shape."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from civiclens import session
from civiclens.functions.text import is_simple, strip, words
from civiclens.functions.timecalc import parse_date
from civiclens.operators import clusters as K
from civiclens.operators import geo as G
from civiclens.operators import metrics as M
from civiclens.operators import products as PR
from civiclens.operators import sampling as S
from civiclens.operators import vectors as V
from civiclens.plans import ingest, registry
from civiclens.streaming import jobs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clusters_beyond_the_stated_range_keep_their_rows(spark):
    df = spark.createDataFrame([(11, 0), (11, 7), (1, 0)], "top_cluster_id int, sub_cluster_id int")
    got = V.cluster_sizes(df, k1=10, k2=4).collect()
    for level in (1, 2):
        assert sum(r["size"] for r in got if r["level"] == level) == 3
    assert sum(r["level"] == 1 for r in got) == 11


def test_seeds_are_as_many_for_large_and_small_parents(spark):
    pts = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2900, 0).otherwise(1).alias("top_cluster_id"),
                                   F.array(F.col("id").cast("float"), F.lit(0.0).cast("float")).alias("embedding"))
    seeds = K.seeds(K._points(pts, "id", "embedding", F.col("top_cluster_id")), [0, 1], 3, 1)
    assert {key: len(c) for key, c in seeds.items()} == {(s, p): 3 for s in range(K.STARTS) for p in (0, 1)}


def test_every_point_lies_with_its_nearest_centroid(spark):
    pts = spark.range(400).select("id", F.array(*[((F.col("id") * m) % 17).cast("float") for m in (1, 3, 7)]).alias("embedding"))
    assigned, tops, subs = K.hierarchical(pts, k1=3, k2=2, max_iter=20)
    assert assigned.count() == 400 and subs.agg(F.sum("size")).first()[0] == 400
    where = {r["id"]: (r["top_cluster_id"], r["sub_cluster_id"]) for r in assigned.collect()}
    cents = {r["cluster_id"]: r["centroid"] for r in tops.collect()}
    for r in pts.collect():
        dist = {c: sum((a - b) ** 2 for a, b in zip(r["embedding"], m, strict=True)) for c, m in cents.items()}
        assert dist[where[r["id"]][0]] <= min(dist.values()) + 1e-6


def test_no_master_unless_passed(monkeypatch):
    seen = []
    builder = session.SparkSession.builder

    class Probe:
        def __getattr__(self, name):
            def call(*args):
                seen.append((name, *args))
                return self
            return call

    monkeypatch.setattr(session, "SparkSession", type("S", (), {"builder": Probe()}))
    monkeypatch.setattr(session, "configure", lambda s: s)
    session.get_spark()
    assert not [x for x in seen if x[0] == "master"]
    session.get_spark("local[2]")
    assert ("master", "local[2]") in seen and builder is not None


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *args):
            return None

        def getCheckpointDir(self):
            return None

    fake = type("S", (), {"sparkContext": Context(), "conf": Context()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(fake)


def test_missing_plan_module_is_an_error(monkeypatch):
    monkeypatch.setattr(registry, "_MODULES", ("no_such_plan",))
    with pytest.raises(ModuleNotFoundError):
        registry.load_all()


def test_streams_read_tables_of_several_files(spark, tmp_path):
    for name in ("events", "lineitem", "documents"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("orders", "part", "customer", "nation", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    d = str(tmp_path)
    assert jobs.run_volume(spark, d).count() == jobs.run_volume(spark, SF).count() > 0
    landed, one = (ingest.landed_raw(spark, x) for x in (d, SF))
    assert jobs.run_ingest(spark, landed).count() == jobs.run_ingest(spark, one).count() > 0
    assert jobs.run_embed(spark, d).count() == jobs.run_embed(spark, SF).count()


def test_white_space_of_every_kind_is_stripped(spark):
    texts = ["\t2024-01-01", "2024-01-01\r", "2024-01-01\n", "　 2024-01-01\xa0", "\x1c2024-01-01 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0] for r in df.select(parse_date("t")).collect()} == {dt.date(2024, 1, 1)}
    for t in ["\tStreet Light", "Road Repair Now\n", " a\x0b b\x85c ", "", " \n", "one"]:
        r = spark.createDataFrame([(t,)], "t string").select(strip("t"), words("t"), is_simple("t")).first()
        assert r[0] == t.strip() and r[1] == t.split() and (r[2] or not 2 <= len(t.split()) <= 3)


def test_one_decimal_rounds_the_binary_value(spark):
    values = [12.25, 0.35, -0.25, 45.25, 0.05, 2.5, 0.15, 0.45, 99.95, 1e6 + 0.05, 0.0, 7.0, 123456.75, 1.005, 2.675, -0.04]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(M.one_decimal(F.col("v"))).collect()] == [f"{abs(v):.1f}" for v in values]
    rows = spark.createDataFrame([(" 12.25% growth in Parking\n",), ("-0.25% growth in Parks",)], "metric string")
    assert {r["label"] for r in M.parse(rows).collect()} == {"+12.2% Growth", "-0.2% Growth"}


def test_cut_inside_one_date_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW_ROWS", 5)
    monkeypatch.setattr(S, "SLICES", 8)
    day = dt.datetime(2024, 1, 1)
    rows = [(i * 7 % 900, day + dt.timedelta(days=0 if i % 3 else i % 90, seconds=0 if i % 2 else i)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz")
    for percent in (0, 1, 33, 50, 99, 100):
        n = int(900 * percent / 100)
        for how, key in (("oldest", lambda r: (r[1], r[0])), ("newest", lambda r: (-(r[1] - day).total_seconds(), r[0]))):
            got = S.reduce_ids(df, how, percent)
            assert sorted(r["id"] for r in got.collect()) == sorted(r[0] for r in sorted(rows, key=key)[:n])
    cut = S.sample_percent(df, 50, "id")
    assert cut.count() == 450
    assert not re.search("Exchange|Sort|Join|Checkpoint", plan(cut)), plan(cut)


def test_staged_tables_are_pruned_and_nothing_is_cached(spark):
    loaded = ingest.loaded(spark, SF)
    stats = loaded.agg(F.min("created_at"))
    assert re.search(r"ReadSchema: struct<created_at:\w+>", plan(stats))
    registry.queries()["cat_many"](spark, SF).count()
    registry.queries()["sum_all"](spark, SF).count()
    later = registry.queries()["top_volume"](spark, SF)
    assert "InMemoryTableScan" not in plan(later)


def test_catalogue_slices(spark):
    whole = PR.load(spark, SF, "top10").collect()
    parts = [PR.load(spark, SF, p) for p in PR.CATALOG if p.startswith("top10_")]
    assert len(parts) == 5 and sum(p.count() for p in parts) == len(whole)
    assert all(len({r["ranking_type"] for r in p.collect()}) == 1 for p in parts)


def test_geojson_metrics_are_numbers(spark):
    feats = spark.createDataFrame([(0, {"Electoral District": "A", "volume": "old"}, '{"type":"Point","coordinates":[1.0,2.0]}'),
                                   (1, {"x": "1"}, None), (2, {}, "null")],
                                  "feature_idx long, properties map<string,string>, geometry string")
    extra = feats.withColumn("updated", F.col("feature_idx") != 1).select(
        "*", F.lit(5).cast("long").alias("volume"), F.lit(2).cast("long").alias("unresolved"), F.lit(1.5).alias("slow_p90"))
    got = {r["feature_idx"]: json.loads(r["value"]) for r in G.features_to_json(extra).collect()}
    assert got[0]["properties"] == {"Electoral District": "A", "volume": 5, "unresolved": 2, "slow_p90": 1.5}
    assert got[1]["properties"] == {"x": "1"} and got[2]["properties"] == {"volume": 5, "unresolved": 2, "slow_p90": 1.5}


def test_texts_of_members_are_joined_once(spark, monkeypatch):
    """The text assignment joins members to their texts once and computes each
    centroid table once: both are written, and what follows reads them."""
    from civiclens.operators import vectors as V
    from civiclens.plans import products
    written, staged = [], V.staged
    monkeypatch.setattr(V, "staged", lambda df: written.append(df.columns) or staged(df))
    got = products.q_assign_text(spark, SF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in "".join(got.inputFiles()) and "lang#" not in plan
    assert [c for c in written if "description" in c] == [["id", "top_cluster_id", "sub_cluster_id", "service_type", "description"]]
    assert sum("centroid" in c for c in written) == 2
    assert got.count() > 0


def test_first_rows_hold_each_column_once(spark):
    """The de-duplication moves one struct a row, and rows alike in the order's
    columns give the same winner however they are spread."""
    rows = [("k", 1, "b"), ("k", 1, "a"), ("k", 2, "0"), ("l", None, "y"), ("l", 0, "x"), (None, 5, None)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "id string, at int, text string").coalesce(1)
        first = ingest.I.dedupe_first(df, "id", ["at"])
        assert "min_by" not in plan(first)
        assert {tuple(r) for r in first.collect()} == {("k", 1, "a"), ("l", None, "y"), (None, 5, None)}
    maps = df.select("id", "at", F.create_map("at", "text").alias("m")).filter("at IS NOT NULL")
    assert {r.id for r in ingest.I.dedupe_first(maps, "id", ["at"]).collect()} == {"k", "l", None}


def test_dates_with_the_day_first(spark):
    texts = ["13/1/2024", "31/12/2024", "1/2/2024", "01/13/2024", "12/31/2024", "2/30/2024", "30/2/2024", "0/5/2024", "5/0/2024", "32/1/2024"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] and r[0].isoformat() for r in df.select(parse_date("t")).collect()]
    assert got == ["2024-01-13", "2024-12-31", "2024-01-02", "2024-01-13", "2024-12-31", None, None, None, None, None]
    assert "^(0?[1-9]|1[0-2])/" in plan(df.select(parse_date("t")))
