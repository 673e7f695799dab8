import os

import pytest

import corpus_pipeline
from civiclens.llm import queries as Q
from tests import oracle_tools as O
from tests.llm.helpers import docs, empty, prose

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_matches_its_oracle(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    ok, message = O.compare(spark, name, Q.QUERIES[name], Q.ORACLES.get(name), SF)
    assert ok, message


def test_entry_point_has_all_eleven():
    import __spark_entry__ as E
    names = set(E.queries())
    assert set(Q.QUERIES) <= names and "pipeline" in names
    assert sorted({int(n[2:].split("_")[0]) for n in Q.QUERIES}) == [*range(1, 14)]


def test_pipeline_stages(spark):
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["quality", "line", "SimHash", "mixing", "packing"]
    shared = "a boiler plate line of every site"
    rows = [(i, f"{prose(60, i)}\n{shared}", f"s{i % 12}") for i in range(24)] + [(100, "too short", "s1"), (101, None, None), (102, "# | " * 40, "s2")]
    rows += [(200 + i, prose(60, 3) + f"\n{shared}", "s3") for i in range(4)]
    frames = {"in": docs(spark, rows)}
    df = frames["in"]
    for name, stage in corpus_pipeline.STAGES:
        df = spark.createDataFrame(stage(spark, df, None).collect(), stage(spark, df, None).schema)
        frames[name] = df
    assert all(frames[n].columns == frames["in"].columns for n, _ in corpus_pipeline.STAGES[:-1])
    kept = {r["doc_id"] for r in frames["quality rules"].collect()}
    assert kept == {r[0] for r in rows} - {100, 101, 102}
    assert sum(shared in r["text"] for r in frames["line dedup"].collect()) == 1
    alone = [r["doc_id"] for r in frames["SimHash near-dedup"].collect()]
    assert len(alone) == len(set(alone)) and not {201, 202, 203} & set(alone) and set(range(24)) - {3} <= set(alone)
    packed = frames["packing"].collect()
    assert {r["doc_id"] for r in packed} <= set(alone) and all(r["length"] <= 2048 for r in packed)


def test_pipeline_on_an_empty_table(spark):
    df = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, None)
    assert df.count() == 0
