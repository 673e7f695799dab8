"""Neighbour graph of vectors and a 2-D layout that keeps it.

* Graph: points meet in buckets of random hyperplanes through the mean, then in
  rounds of neighbour descent: those that share a neighbour are compared, and a
  pair is handed on only if it is nearer than the farthest neighbour either has.
* Layout: edge weights fall from 1 at the nearest neighbour so that every point
  has about log2(k) neighbours in weight; positions start from PCA and move in
  rounds.  In a round each tile (points by a hash, so tiles are even whatever
  the data) moves its points along their edges, with the positions of other
  tiles as the last round left them, and away from random points of the tile.

Groups compared in one piece are bounded: buckets and neighbourhoods above
``GROUP`` members are split by a hash of the member.  Every round is written to
the shared checkpoint folder, so a lost executor costs one round at most.

Points without a vector, or with a null or non-finite component, are left out.
Ids are distinct longs; equal vectors are neighbours at distance 0.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiclens.operators.clusters import project
from civiclens.sources.files import scratch_path

#: Points compared in one piece about, trees of hyperplanes, rounds of descent.
GROUP = 128
TREES = 6
DESCENTS = 4
#: Points a tile about, rounds over tiles, gradient steps a round, points drawn
#: to push away for every edge.
TILE = 4096
ROUNDS = 8
STEPS = 25
AWAY = 5
#: The low-dimensional curve 1 / (1 + A d^(2B)) for points kept 0.1 apart.
A, B = 1.577, 0.895

_EDGE = "id long, other long, d double"


def _saved(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, f"layout/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _nearest(df: DataFrame, k: int) -> DataFrame:
    """The k nearest of each id; ties to the smaller id."""
    best = df.groupBy("id", "other").agg(F.min("d").alias("d"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
    return best.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def _split(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """``_part``: groups above GROUP rows in even parts by a hash of the member."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("_parts"))
    return rows.join(parts, keys).withColumn("_part", F.pmod(F.xxhash64(member), F.col("_parts"))).drop("_parts")


def _tile(rows: float, size: int, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by, F.lit(7)), F.lit(max(1, math.ceil(rows / size)))).alias("_tile")


def _compared(keys: list[str], k: int):
    """Pairs of each group of a tile that improve on the radius of ``id``."""
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*keys, "_part"], kind="stable")
        ids, radius, x = rows["id"].to_numpy(), rows["radius"].to_numpy(), _units(rows["vec"])
        group = rows[[*keys, "_part"]].to_numpy()
        cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        out = []
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(ids)], strict=True):
            if hi - lo < 2:
                continue
            far = np.maximum(1.0 - x[lo:hi] @ x[lo:hi].T, 0.0)
            np.fill_diagonal(far, np.inf)
            if hi - lo > k + 1:
                bound = np.partition(far, k - 1, axis=1)[:, k - 1]
                keep = (far <= bound[:, None]) & (far < radius[lo:hi, None])
            else:
                keep = (far < radius[lo:hi, None]) & np.isfinite(far)
            a, b = np.nonzero(keep)
            if len(a) > k * (hi - lo):  # ties at the bound: any k of them are nearest
                order = np.lexsort((ids[lo:hi][b], far[a, b], a))
                a, b = a[order], b[order]
                first = np.searchsorted(a, a, side="left")
                within = np.arange(len(a)) - first < k
                a, b = a[within], b[within]
            out.append(pd.DataFrame({"id": ids[lo:hi][a], "other": ids[lo:hi][b], "d": far[a, b]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "d": []})
    return compare


def _bucketed(vecs: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """First neighbours: the nearest in the buckets of each tree."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    mean = vecs.select(Summarizer.mean(array_to_vector("vec"))).first()[0].toArray()
    bits = max(0, min(30, math.ceil(math.log2(n / (GROUP / 2)))))
    planes = np.random.default_rng(seed).normal(size=(TREES, bits, len(mean)))
    powers = 1 << np.arange(bits)

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = np.stack(rows["vec"].to_numpy()).astype(np.float64) - mean
            for tree in range(TREES):
                yield rows.assign(tree=tree, code=((x @ planes[tree].T > 0) @ powers).astype(np.int64))

    rows = vecs.mapInPandas(codes, "id long, vec array<float>, tree long, code long")
    keys = ["tree", "code"]
    rows = _split(rows, keys, "id").withColumn("radius", F.lit(float("inf")))
    tiled = rows.withColumn("_tile", _tile(n * TREES, 8 * GROUP, *keys, "_part"))
    return _nearest(tiled.groupBy("_tile").applyInPandas(_compared(keys, k), _EDGE), k)


def neighbours(points: DataFrame, k: int = 15, vec: str = "embedding", id_col: str = "id",
               descents: int = DESCENTS, seed: int = 42) -> DataFrame:
    """(id, other, d): the k nearest points of each by cosine distance, from 0
    to 2 (a zero vector lies at 1 from all); fewer if there are not k others."""
    ok = F.col(vec).isNotNull() & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    vecs = _saved(points.filter(ok).select(F.col(id_col).cast("long").alias("id"),
                                           F.col(vec).cast("array<float>").alias("vec")))
    n = vecs.count()
    k = min(k, n - 1)
    if k < 1:
        return points.sparkSession.createDataFrame([], _EDGE)
    edges = _saved(_bucketed(vecs, n, k, seed))
    for _ in range(descents):
        full = edges.groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.max("d").alias("far"))
        radius = F.when(F.col("m") == k, F.col("far")).otherwise(F.lit(float("inf")))
        nodes = vecs.join(full.select("id", radius.alias("radius")), "id", "left").na.fill(float("inf"), ["radius"])
        both = edges.select(F.col("other").alias("middle"), "id").union(
            edges.select(F.col("id").alias("middle"), F.col("other").alias("id"))).distinct()
        members = _split(both, ["middle"], "id").join(nodes, "id")
        tiled = members.withColumn("_tile", _tile(2 * n * k, 64 * GROUP, "middle", "_part"))
        found = tiled.groupBy("_tile").applyInPandas(_compared(["middle"], k), _EDGE)
        edges = _saved(_nearest(edges.unionByName(found), k))
    return edges


def weights(edges: DataFrame, k: int = 15) -> DataFrame:
    """(id, other, w) in both directions: ``a + b - a * b`` of the two directed
    weights ``exp(-(d - nearest) / scale)``, scale so that they sum to log2(k)."""
    def directed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for group in rows.itertuples(index=False):
                over = np.maximum(np.asarray(group.ds) - np.min(group.ds), 0.0)
                want, lo, hi = min(np.log2(k), len(over)), 1e-6, 1e3
                for _ in range(40):
                    scale = math.sqrt(lo * hi)
                    lo, hi = (scale, hi) if np.exp(-over / scale).sum() < want else (lo, scale)
                yield pd.DataFrame({"id": group.id, "other": group.others, "w": np.exp(-over / hi)})

    lists = edges.groupBy("id").agg(F.collect_list(F.struct("other", "d")).alias("e")).select(
        "id", F.col("e.other").alias("others"), F.col("e.d").alias("ds"))
    one = lists.mapInPandas(directed, "id long, other long, w double")
    either = one.unionByName(one.select(F.col("other").alias("id"), F.col("id").alias("other"), "w"))
    w = F.sum("w") - F.when(F.count("w") == 2, F.product("w")).otherwise(0.0)
    return either.groupBy("id", "other").agg(w.alias("w"))


def _moved(first_step: int, steps: int, seed: int):
    """Gradient steps over the points of one tile."""
    def move(edges: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        places = places.sort_values("id")
        ids, y = places["id"].to_numpy(), places[["x_2d", "y_2d"]].to_numpy().copy()
        rng = np.random.default_rng([seed, first_step, int(places["_tile"].iloc[0])])
        edges = edges.sort_values(["id", "other"])
        head = np.searchsorted(ids, edges["id"].to_numpy())
        other = edges["other"].to_numpy()
        tail = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
        inside = ids[tail] == other
        fixed, w = edges[["ox", "oy"]].to_numpy(), edges["w"].to_numpy()
        for step in range(first_step, first_step + STEPS):
            drawn = np.flatnonzero(rng.random(len(w)) < w)
            h = head[drawn]
            to = y[h] - np.where(inside[drawn, None], y[tail[drawn]], fixed[drawn])
            d2 = (to * to).sum(1)
            pull = np.where(d2 > 0, -2 * A * B * np.maximum(d2, 1e-12) ** (B - 1) / (1 + A * d2 ** B), 0.0)
            force = np.clip(pull[:, None] * to, -4, 4)
            for _ in range(AWAY):
                off = y[h] - y[rng.integers(0, len(ids), len(h))]
                d2 = (off * off).sum(1)
                push = 2 * B / ((0.001 + d2) * (1 + A * d2 ** B))
                force += np.clip(push[:, None] * off, -4, 4)
            count = np.maximum(np.bincount(h, minlength=len(ids)), 1)
            rate = 1.0 - step / steps
            for axis in (0, 1):
                y[:, axis] += rate * np.bincount(h, force[:, axis], len(ids)) / count
        return pd.DataFrame({"id": ids, "x_2d": y[:, 0], "y_2d": y[:, 1]})
    return move


def layout(points: DataFrame, k: int = 15, vec: str = "embedding", id_col: str = "id", rounds: int = ROUNDS,
           seed: int = 42) -> DataFrame:
    """``id_col``, ``x_2d``, ``y_2d``: one row for each point with a vector.
    The same rows give the same layout, whatever their order; a single point
    lies at the origin."""
    edges = neighbours(points, k, vec, id_col, seed=seed)
    linked = _saved(weights(edges, k))
    ok = F.col(vec).isNotNull() & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = points.filter(ok).select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("vec"))
    n = kept.count()
    if n < 3:
        alone = F.row_number().over(Window.orderBy("id")) - 1  # two rows at most
        return kept.select(F.col("id").alias(id_col), alone.cast("double").alias("x_2d"), F.lit(0.0).alias("y_2d"))
    start = project(kept, 2, "vec", "id")
    wide = start.agg(F.greatest(F.max(F.abs("x_2d")), F.max(F.abs("y_2d")), F.lit(1e-9)).alias("wide")).first()["wide"]
    shaken = [F.pmod(F.xxhash64("id", F.lit(axis)), F.lit(1 << 20)) / float(1 << 20) * 1e-3 for axis in (1, 2)]
    places = _saved(start.select("id", *[(F.col(c) * (10.0 / wide) + s).alias(c)
                                         for c, s in zip(("x_2d", "y_2d"), shaken, strict=True)]))
    tile = _tile(n, TILE, "id")
    for r in range(rounds):
        others = places.select(F.col("id").alias("other"), F.col("x_2d").alias("ox"), F.col("y_2d").alias("oy"))
        near = linked.join(others, "other").withColumn("_tile", tile).groupBy("_tile")
        mine = places.withColumn("_tile", tile).groupBy("_tile")
        moved = near.cogroup(mine).applyInPandas(_moved(r * STEPS, rounds * STEPS, seed),
                                                 "id long, x_2d double, y_2d double")
        places = _saved(moved)
    return places.withColumnRenamed("id", id_col)
