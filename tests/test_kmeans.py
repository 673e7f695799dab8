import numpy as np
import pytest
from pyspark.sql import functions as F

from civiclens.operators import clusters as K

SCHEMA = "id long, embedding array<float>"


def blobs(spark, sizes, dim=6, seed=0, noise=0.4):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 6, (len(sizes), dim))
    x = np.concatenate([m + rng.normal(0, noise, (n, dim)) for m, n in zip(middles, sizes, strict=True)])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4), x, middles


def cost(x, centres):
    return ((x[:, None, :] - centres[None]) ** 2).sum(2).min(1).sum()


def full_batch(x, k, rng):
    """Lloyd from k-means++ on the whole matrix, best of five."""
    best = np.inf
    for _ in range(5):
        c = K._reduced(x, np.ones(len(x)), k, rng)
        for _ in range(60):
            near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(k)])
        best = min(best, cost(x, c))
    return best


@pytest.mark.parametrize("batch", [50_000, 100])
def test_top_level_is_as_cheap_as_full_batch(spark, monkeypatch, batch):
    monkeypatch.setattr(K.minibatch, "__defaults__", (batch, 1e-3))
    df, x, _ = blobs(spark, [120] * 10, noise=1.5)
    assigned, cents = K.fit_top(df, k=8, seed=1)
    c = np.array([r["centroid"] for r in cents.orderBy("cluster_id").collect()])
    assert cost(x, c) <= 1.05 * full_batch(x, 8, np.random.default_rng(5))
    near = ((x[:, None] - c[None]) ** 2).sum(2)
    for r in assigned.collect():
        assert near[r["id"], r["top_cluster_id"]] <= near[r["id"]].min() + 1e-6


def test_a_small_group_gets_its_centre(spark):
    """A group of 0.5 % inside one parent, seen by every start's draws."""
    big, x, _ = blobs(spark, [995, 5], seed=3)
    other, y, _ = blobs(spark, [300], seed=4)
    df = big.withColumn("top_cluster_id", F.lit(0)).unionByName(
        other.select((F.col("id") + 5000).alias("id"), "embedding").withColumn("top_cluster_id", F.lit(1)))
    assigned, cents = K.fit_sub(df, k2=3, seed=7)
    small = assigned.filter("id between 995 and 999").select("sub_cluster_id").distinct().collect()
    rest = assigned.filter("id < 995").select("sub_cluster_id").distinct().collect()
    assert len(small) == 1 and small[0] not in rest
    assert cents.groupBy("parent_cluster_id").agg(F.sum("size").alias("n")).orderBy("parent_cluster_id").collect()[0]["n"] == 1000


def test_draws_follow_the_distance(spark):
    df, x, _ = blobs(spark, [400, 40], seed=6)
    pts = K._points(df, "id", "embedding", F.lit(0))
    centre = x[:400].mean(0)[None]
    drawn = K._draw(pts, {(0, 0): centre, (1, 0): centre}, 20, 1)
    far = [np.linalg.norm(np.array(r["vec"]) - centre) > 4 for r in drawn]
    assert len(drawn) == 40 and np.mean(far) > 0.8
    first = {tuple(r["vec"]) for r in drawn if r["start"] == 0}
    assert first != {tuple(r["vec"]) for r in drawn if r["start"] == 1}


def test_a_pass_moves_centres_not_points(spark):
    df, _, _ = blobs(spark, [200] * 3)
    pts = K._points(df, "id", "embedding", F.lit(0))
    found = K._gather(pts, {(0, 0): np.zeros((2, 6)), (1, 0): np.ones((2, 6))})
    assert all(counts.sum() == 600 for _, counts, _ in found.values())


@pytest.mark.parametrize("fit", [K.fit_top, K.fit_sub])
def test_an_empty_table(spark, fit):
    df = spark.createDataFrame([], SCHEMA + ", top_cluster_id int")
    assigned, cents = fit(df if fit is K.fit_sub else df.drop("top_cluster_id"))
    assert assigned.count() == 0 and cents.count() == 0
