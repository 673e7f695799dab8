"""Neighbour graph against brute force; the layout against its PCA start."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from civiclens.operators import layout as L
from civiclens.operators.clusters import project

SCHEMA = "id long, embedding array<float>"


def curved(n=900, dim=24, seed=3):
    """Groups on directions spread over many axes, which two axes cannot show."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(30, dim))
    return (middles[rng.integers(0, 30, n)] + rng.normal(0, 0.35, (n, dim))).astype(np.float32)


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u.astype(np.float64) @ u.T.astype(np.float64)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def kept(near, y):
    d = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    low = np.argsort(d, axis=1)[:, :near.shape[1]]
    return np.mean([len(set(a) & set(b)) / near.shape[1] for a, b in zip(near, low, strict=True)])


@pytest.fixture(scope="module")
def cloud(spark):
    x = curved()
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4).cache(), x


def test_graph_recall(spark, cloud, monkeypatch):
    monkeypatch.setattr(L, "GROUP", 48)
    df, x = cloud
    got = {}
    for r in L.neighbours(df, k=10).collect():
        got.setdefault(r.id, {})[r.other] = r.d
    near = exact(x, 10)
    assert len(got) == len(x) and all(len(v) == 10 and i not in v for i, v in got.items())
    assert np.mean([len(set(near[i]) & set(got[i])) / 10 for i in got]) >= 0.95
    i, (j, d) = 5, next(iter(got[5].items()))
    assert abs(d - (1 - x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]))) < 1e-5


def test_layout_keeps_more_neighbours_than_pca(spark, cloud, monkeypatch):
    monkeypatch.setattr(L, "TILE", 300)
    df, x = cloud
    near = exact(x, 15)
    def placed(frame):
        rows = sorted(frame.select("id", "x_2d", "y_2d").collect())
        assert [r.id for r in rows] == list(range(len(x)))
        return np.array([[r.x_2d, r.y_2d] for r in rows])
    y = placed(L.layout(df))
    assert np.isfinite(y).all()
    assert kept(near, y) > kept(near, placed(project(df))) + 0.2  # 0.61 and 0.35 when written


def test_copies_missing_vectors_and_tiny_tables(spark):
    copies = [(i, [1.0, 0.0]) for i in range(400)] + [(400 + i, [0.0, 1.0 + i]) for i in range(8)]
    bad = [(900, None), (901, [None, 1.0]), (902, [float("nan"), 1.0]), (903, [0.0, 0.0])]
    got = L.neighbours(spark.createDataFrame(copies + bad, SCHEMA), k=3, descents=2)
    per = {r.id: (r.n, r.far) for r in got.groupBy("id").agg(F.count("d").alias("n"), F.max("d").alias("far")).collect()}
    assert set(per) == {i for i, _ in copies} | {903}
    assert all(per[i] == (3, 0.0) for i, _ in copies)
    assert per[903] == (3, 1.0)
    assert L.neighbours(spark.createDataFrame([(1, [1.0])], SCHEMA)).count() == 0
    assert L.layout(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in L.layout(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect()] == [(1, 0.0, 0.0)]
