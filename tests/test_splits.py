"""Records that span lines, cut at many byte offsets, against readers that see a
whole file at once."""

import json
import os
import tempfile
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from civiclens.sources import files, splits

SIZES = [11, 29, 64, 10_000]


@contextmanager
def blocks_of(spark, size):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], str(size))
    spark.conf.set(names[1], "1")
    try:
        yield
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)


@pytest.fixture(scope="module")
def folder():
    return tempfile.mkdtemp(prefix="civiclens-splits-")


CSV = ('k,v,w\n1,"two\nlines",x\n\n2,"a, ""b""\n\n\nend",\n3,plain,"q""uo\nted\\"\n4,"","' + "long\n" * 40
       + '"\n5,"é\n{}",z\n6,last,"no line end"')


@pytest.mark.parametrize("size", SIZES)
def test_csv_cut_anywhere_equals_the_whole_file_reader(spark, folder, size):
    root = os.path.join(folder, "csv")
    os.makedirs(root, exist_ok=True)
    for name, text in (("a.csv", CSV), ("b.csv", CSV.replace("\n", "\r\n")), ("c.csv", ""), ("d.csv", "k,v,w\n")):
        with open(os.path.join(root, name), "w", newline="") as f:
            f.write(text)
    schema = "k int, v string, w string"
    want = spark.read.schema(schema).options(header=True, **files._CSV).csv(root).collect()
    with blocks_of(spark, size):
        if size < 100:
            assert splits._pieces(spark, os.path.join(root, "a.csv"), "\n").rdd.getNumPartitions() > 3
        got = files.read_csv(spark, root, schema).collect()
    assert len(want) == 12
    # The whole-file reader turns CRLF inside values into LF; here values stay as written.
    got = [tuple(v.replace("\r\n", "\n") if isinstance(v, str) else v for v in r) for r in got]
    assert sorted(got, key=repr) == sorted(map(tuple, want), key=repr)


def test_csv_round_trip_of_awkward_values(spark, folder):
    rows = [(i, v) for i, v in enumerate(["a\nb", 'say "x"', "c,d", " e ", "\n", None, "f\r\ng", '"', "{}", "z" * 300])]
    path = os.path.join(folder, "round")
    files.write_csv(spark.createDataFrame(rows, "i int, v string"), path)
    with blocks_of(spark, 11):
        got = files.read_csv(spark, path, "i int, v string").collect()
    assert sorted(tuple(r) for r in got) == rows


def shuffled(plan):
    """Bytes that the shuffles of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    own = plan.metrics().apply("shuffleBytesWritten").value() if kind == "ShuffleExchangeExec" else 0
    children = plan.children()
    return own + sum(shuffled(children.apply(i)) for i in range(children.size()))


def test_records_inside_a_block_are_not_shuffled(spark, folder):
    path = os.path.join(folder, "narrow")
    text = F.concat(F.md5(F.col("id").cast("string")), F.lit('\n"'), F.sha2(F.col("id").cast("string"), 512))
    files.write_csv(spark.range(0, 20_000, 1, 2).select("id", text.alias("v")), path)
    got = files.read_csv(spark, path, "id long, v string")
    assert len({r.v for r in got.collect()}) == 20_000
    assert 0 < shuffled(got._jdf.queryExecution().executedPlan()) < 20_000


@pytest.mark.parametrize("size", SIZES)
def test_compressed_files_hold_few_rows_and_read_back(spark, folder, size, monkeypatch):
    monkeypatch.setattr(files, "COMPRESSED_ROWS", 3)
    rows = [(i, v) for i, v in enumerate(["a\nb", 'say "x"', "c,d", None, "f\r\ng", '"', "\n\n", "z" * 300])]
    path = os.path.join(folder, f"gz{size}")
    files.write_csv(spark.createDataFrame(rows, "i int, v string").coalesce(1), path, compressed=True)
    names = [n for n in os.listdir(path) if n.startswith("part-")]
    assert len(names) == 3 and all(n.endswith(".csv.gz") for n in names)
    with blocks_of(spark, size):
        got = files.read_csv(spark, path, "i int, v string").collect()
    assert sorted(tuple(r) for r in got) == rows


@pytest.mark.parametrize("batch", [1, 2, 3, 7])
def test_csv_records_go_over_arrow_batches(spark, folder, batch):
    path = os.path.join(folder, f"batch{batch}.csv")
    with open(path, "w", newline="") as f:
        f.write("\n\r\n" + CSV)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = [files.read_csv(spark, path, "k int, v string, w string").collect()]
        with blocks_of(spark, 64):
            got.append(files.read_csv(spark, path, "k int, v string, w string").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for rows in got:
        assert sorted(r.k for r in rows) == [1, 2, 3, 4, 5, 6]
        by_key = {r.k: r.v for r in rows}
        assert by_key[2] == 'a, "b"\n\n\nend' and by_key[5] == "é\n{}"


def test_an_open_quote_keeps_the_rest_of_the_file_in_one_record(spark, folder):
    path = os.path.join(folder, "open.csv")
    with open(path, "w") as f:
        f.write('k,v\n1,a\n2,"b\n3,c\n\n4,d\n')
    for size in SIZES:
        with blocks_of(spark, size):
            got = splits.csv_records(spark, path).collect()
        assert sorted((r._header, r._text) for r in got) == [
            (False, "1,a"), (False, '2,"b\n3,c\n\n4,d'), (True, "k,v")]


def test_files_cut_in_two_ways_fail(spark, folder, monkeypatch):
    path = os.path.join(folder, "twice.csv")
    with open(path, "w") as f:
        f.write("k,v\n1,a\n")
    other = F.udf(lambda: int.from_bytes(os.urandom(4)), "long").asNondeterministic()
    pieces = splits._pieces
    monkeypatch.setattr(splits, "_pieces", lambda *a: pieces(*a).withColumn("_block", other()))
    with pytest.raises(Exception, match="cut in two ways"):
        files.read_csv(spark, path, "k int, v string").collect()


def collection():
    features = [{"type": "Feature", "properties": {"n": i, "name": name, "none": None, "in": {"x": {"y": 1}}},
                 "geometry": {"type": "Point", "coordinates": [i, 0.5]} if i % 3 else None}
                for i, name in enumerate(['}{', 'a "q" }', "\\", "\\\"}", "ü{", "", '"features":[{', "z" * 90])]
    return {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn"}}, "features": features,
            "other": [{"a": 1}, {"b": {"c": 2}}], "tail": {"d": {"e": "}"}}}


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", SIZES)
def test_features_cut_anywhere_equal_the_parsed_document(spark, folder, size, indent):
    root = os.path.join(folder, f"geo{indent}")
    os.makedirs(root, exist_ok=True)
    docs = {"a.json": collection(), "b.json": {"features": [], "type": "FeatureCollection"},
            "c.json": {"features": collection()["features"][:3], "type": "FeatureCollection"}}
    for name, doc in docs.items():
        with open(os.path.join(root, name), "w") as f:
            json.dump(doc, f, indent=indent, ensure_ascii=False)
    with blocks_of(spark, size):
        got = files.read_geojson(spark, root).select("feature_idx", "properties", "geometry").collect()
    want = [(i, f["properties"]["name"], f["geometry"]) for d in docs.values() for i, f in enumerate(d["features"])]
    read = [(r.feature_idx, r.properties["name"], json.loads(r.geometry) if r.geometry else None) for r in got]
    assert sorted(read, key=repr) == sorted(want, key=repr)
    assert all(r.properties["n"] == str(r.feature_idx) and "none" not in r.properties for r in got)


def test_folder_of_many_files_reads_whole(spark, folder):
    path = os.path.join(folder, "plan")
    files.write_csv(spark.range(100).select("id", F.lit("a\nb").alias("v")), path)
    assert files.read_csv(spark, path, "id long, v string").agg(F.sum("id"), F.count("v")).first()[:] == (4950, 100)
