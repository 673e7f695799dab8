"""Centroid tables beyond the bound go in blocks and give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from civiclens.operators import vectors as V

CENTS = "cluster_id int, centroid array<double>"
SUBS = "parent_cluster_id int, cluster_id int, centroid array<double>"


@pytest.fixture(scope="module")
def frames(spark):
    r = random.Random(4)
    vec = lambda: [r.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(6)]
    tops = [(i, vec()) for i in range(30)]
    tops += [(30 + i, tops[i][1]) for i in range(10)] + [(50, [0.0] * 6)]  # exact ties and a null vector's direction
    subs = [(p, c, vec()) for p in range(0, 40) if p % 4 for c in range(5)] + [(77, 0, vec())]
    sizes = [(p, c, (p + c) % 3) for p in range(40) for c in range(5)] + [(50, 0, 4)]
    queries = [(i, vec()) for i in range(120)] + [(5, vec()), (5, vec()), (400, None), (401, [0.0] * 6)]
    return (spark.createDataFrame(queries, "query_id long, embedding array<double>").repartition(3),
            spark.createDataFrame(tops, CENTS), spark.createDataFrame(subs, SUBS),
            spark.createDataFrame(sizes, "parent_cluster_id int, cluster_id int, size int"))


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("which", ["nearest", "ranked", "excluding", "assign"])
def test_blocks_give_the_same_rows(frames, monkeypatch, which):
    queries, tops, subs, sizes = frames
    run = {"nearest": lambda: V.nearest(queries, tops), "ranked": lambda: V.ranked(queries, tops),
           "excluding": lambda: V.ranked(queries, tops, exclude=(0, 31)),
           "assign": lambda: V.assign(queries, tops, subs, sizes)}[which]
    whole = run()
    want = rows(whole)
    monkeypatch.setattr(V, "CENTROID_BYTES", 1000)
    got = run()
    assert got.dtypes == whole.dtypes and rows(got) == want and len(want) > 100


def test_one_block_at_a_time_reaches_the_driver(frames, monkeypatch):
    queries, tops, _, _ = frames
    held = []
    block_pass = V._block_pass
    monkeypatch.setattr(V, "_block_pass", lambda block, *a: held.append(len(block)) or block_pass(block, *a))
    monkeypatch.setattr(V, "CENTROID_BYTES", 1000)
    V.nearest(queries, tops)
    assert sum(held) == 41 and len(held) >= 3 and max(held) < 41


@pytest.mark.parametrize("bound", [1000, 256 << 20])
def test_no_centroid_and_no_query(frames, monkeypatch, bound):
    queries, tops, subs, sizes = frames
    monkeypatch.setattr(V, "CENTROID_BYTES", bound)
    none = tops.filter(F.lit(False))
    assert V.nearest(queries.limit(0), tops).count() == 0
    assert V.nearest(queries, none).filter("cluster_id IS NULL AND similarity IS NULL").count() == queries.count()
    assert V.ranked(queries, none).count() == 0
    assert V.assign(queries, none, subs, sizes).count() == 0
