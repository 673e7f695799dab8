"""Two-level k-means in DataFrame passes.

All parents and all starts advance together.  A pass compares every point with
the current centres of its parent, for each start, in numpy on Arrow's flat
buffers; a task hands on one mean, count and cost per centre, and ``Summarizer``
averages them with partial aggregation.  So a pass moves tasks x centres rows
and not the points, and only centres (starts x parents x k rows) reach the
driver.

* Seeds: k-means||.  Each round draws points of every parent with a chance in
  proportion to their squared distance from the seeds so far, over all points
  (the smallest of ``-log(u) / d2`` with ``u`` from a hash of the id), so a
  small group far from the rest is found.  The candidates, weighted by the
  points nearest to them, are reduced to k on the driver.
* Top level: mini-batches.  Points are written once in folders by a hash; a
  step reads one folder, and every centre moves by its own learning rate.  The
  cheapest start (one full pass for all of them) is polished by Lloyd rounds.
* Sub level: Lloyd rounds over all parents, the cheapest start of each parent.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclens.session import checkpoint_dir

#: Starts advanced together, rounds of k-means||, candidates a round for each
#: centre, points of a mini-batch about, most folders they are dealt to, full
#: rounds that polish the cheapest start.
STARTS = 5
DRAWS = 3
OVER = 3
BATCH = 50_000
FOLDERS = 1024
POLISH = 12

Centres = dict[tuple[int, int], np.ndarray]  # (start, parent) -> centres


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix, without a copy per row."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
    return np.maximum(d, 0)


def _by_parent(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(parent, row numbers, vectors) of a batch with columns id, parent, vec."""
    parents, x = batch.column(1).to_numpy(), _matrix(batch.column(2))
    for p in np.unique(parents):
        rows = np.flatnonzero(parents == p)
        yield int(p), rows, x[rows]


def _gather(points: DataFrame, centres: Centres) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One pass: per start and parent the means, counts and costs by centre."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, costs = {}, {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, _, x in _by_parent(batch):
                for key, c in centres.items():
                    if key[1] != p:
                        continue
                    d = _distances(x, c)
                    near = d.argmin(1)
                    if key not in sums:
                        sums[key], counts[key], costs[key] = np.zeros_like(c), np.zeros(len(c)), np.zeros(len(c))
                    np.add.at(sums[key], near, x)
                    counts[key] += np.bincount(near, minlength=len(c))
                    costs[key] += np.bincount(near, d[np.arange(len(x)), near], minlength=len(c))
        rows = [(s, p, i, sums[s, p][i] / n, n, costs[s, p][i])
                for s, p in sums for i, n in enumerate(counts[s, p]) if n]
        start, parent, centre, mean, n, cost = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_pydict({
            "start": pa.array(start, pa.int32()), "parent": pa.array(parent, pa.int32()),
            "centre": pa.array(centre, pa.int32()), "mean": pa.array(mean, pa.list_(pa.float64())),
            "n": pa.array(n, pa.float64()), "cost": pa.array(cost, pa.float64())})

    parts = points.mapInArrow(run, "start int, parent int, centre int, mean array<double>, n double, cost double")
    total = (parts.groupBy("start", "parent", "centre")
             .agg(Summarizer.mean(array_to_vector("mean"), F.col("n")).alias("m"), F.sum("n").alias("n"),
                  F.sum("cost").alias("cost"))
             .select("start", "parent", "centre", vector_to_array("m").alias("mean"), "n", "cost"))
    out = {key: (c.copy(), np.zeros(len(c)), np.zeros(len(c))) for key, c in centres.items()}
    for r in total.collect():  # at most one row a centre
        means, counts, costs = out[r["start"], r["parent"]]
        means[r["centre"]], counts[r["centre"]], costs[r["centre"]] = r["mean"], r["n"], r["cost"]
    return out


def _draw(points: DataFrame, seeds: Centres, many: int, salt: int) -> list:
    """``many`` points of each start and parent, drawn in proportion to their
    squared distance from its seeds (alike while there are none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            chance = batch.column(3).to_numpy()
            for p, rows, x in _by_parent(batch):
                for key, c in seeds.items():
                    if key[1] != p:
                        continue
                    d = _distances(x, c).min(1) if len(c) else np.ones(len(x))
                    # A start's own uniform number of the point, from its hash.
                    u = np.modf(chance[rows] * (1 + 7919.0 * (key[0] + 1)))[0]
                    with np.errstate(divide="ignore"):
                        rank = np.where(d > 1e-12, -np.log(np.maximum(u, 1e-300)) / d, np.inf)
                    first = np.argsort(rank, kind="stable")[:many]
                    first = first[np.isfinite(rank[first])]
                    old = best.get(key, (np.zeros(0), np.zeros((0, x.shape[1]))))
                    ranks, vectors = np.concatenate([old[0], rank[first]]), np.concatenate([old[1], x[first]])
                    keep = np.argsort(ranks, kind="stable")[:many]
                    best[key] = ranks[keep], vectors[keep]
        rows = [(s, p, r, v) for (s, p), (ranks, vectors) in best.items() for r, v in zip(ranks, vectors, strict=True)]
        start, parent, rank, vec = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_pydict({
            "start": pa.array(start, pa.int32()), "parent": pa.array(parent, pa.int32()),
            "rank": pa.array(rank, pa.float64()), "vec": pa.array(vec, pa.list_(pa.float64()))})

    from pyspark.sql import Window
    bits = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = points.withColumn("chance", bits).mapInArrow(run, "start int, parent int, rank double, vec array<double>")
    order = Window.partitionBy("start", "parent").orderBy("rank")
    return drawn.select("*", F.row_number().over(order).alias("at")).filter(F.col("at") <= many).collect()


def _reduced(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted candidates by k-means++, then a few weighted rounds."""
    if len(candidates) <= k:
        return candidates
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    d = _distances(candidates, candidates[chosen])[:, 0]
    while len(chosen) < k:
        w = weights * d
        chosen.append(int(rng.choice(len(candidates), p=w / w.sum()) if w.sum() > 0 else rng.integers(len(candidates))))
        d = np.minimum(d, _distances(candidates, candidates[chosen[-1:]])[:, 0])
    centres = candidates[chosen].copy()
    for _ in range(10):
        near = _distances(candidates, centres).argmin(1)
        for i in np.unique(near):
            mine = near == i
            if weights[mine].sum():
                centres[i] = np.average(candidates[mine], axis=0, weights=weights[mine])
    return centres


def seeds(points: DataFrame, parents: list[int], k: int, seed: int, starts: int = STARTS, draws: int = DRAWS,
          over: int = OVER) -> Centres:
    """k-means|| for every start and parent at once: ``draws`` + 2 passes."""
    width = points.select(F.size("vec")).first()[0]
    found: Centres = {(s, p): np.zeros((0, width)) for s in range(starts) for p in parents}
    for n in range(draws + 1):
        rows = _draw(points, found, 1 if n == 0 else over * k, seed * 1009 + n)
        more: dict = {}
        for r in rows:
            more.setdefault((r["start"], r["parent"]), []).append(r["vec"])
        found = {key: np.concatenate([c, np.array(more[key])]) if key in more else c for key, c in found.items()}
    weights = _gather(points, found)
    rng = np.random.default_rng(seed)
    return {key: _reduced(c, weights[key][1], k, rng) for key, c in found.items()}


def lloyd(points: DataFrame, centres: Centres, max_iter: int, tol: float = 1e-6) -> tuple[Centres, dict]:
    """Full rounds until no mean moves; a start and parent that stands still is
    left out of the later passes.  Returns the centres and their costs."""
    costs, moving = {}, dict(centres)
    for _ in range(max_iter):
        if not moving:
            break
        for key, (means, counts, cost) in _gather(points, moving).items():
            costs[key] = cost.sum()
            still = np.abs(means - moving[key]).max(initial=0) <= tol
            centres[key] = means  # a centre without points stays
            if still:
                del moving[key]
            else:
                moving[key] = means
    return centres, costs


def _cheapest(centres: Centres, costs: dict) -> dict[int, np.ndarray]:
    """Per parent the centres of its cheapest start."""
    best: dict = {}
    for (s, p), c in centres.items():
        cost = (costs.get((s, p), np.inf), s)
        if p not in best or cost < best[p][0]:
            best[p] = cost, c
    return {p: c for p, (_, c) in best.items()}


def minibatch(points: DataFrame, centres: Centres, max_iter: int, batch: int = BATCH, tol: float = 1e-3) -> Centres:
    """Steps over one folder of points each, two rounds of the folders and at
    most ``max_iter`` steps, so a large table is not read whole.  A centre's
    rate is the share of this step's points among all it has had; steps end
    early when the last few moved no centre by more than ``tol`` of the
    vectors' spread."""
    folders = max(1, min(FOLDERS, points.count() // batch))
    spark = points.sparkSession
    path = os.path.join(checkpoint_dir(spark), "civiclens", "batches", uuid.uuid4().hex)
    points.withColumn("folder", F.pmod(F.xxhash64("id", F.lit(97)), F.lit(folders))).write.partitionBy("folder").parquet(path)
    stored = spark.read.schema("id long, parent int, vec array<float>, folder int").parquet(path)
    had = {key: np.zeros(len(c)) for key, c in centres.items()}
    spread = max(float(np.concatenate(list(centres.values())).std()), 1e-12)
    moved = []
    for n in range(min(max_iter, max(4, 2 * folders))):
        found = _gather(stored.filter(F.col("folder") == n % folders).drop("folder"), centres)
        most = 0.0
        for key, (means, counts, _) in found.items():
            had[key] += counts
            rate = np.divide(counts, had[key], out=np.zeros_like(counts), where=had[key] > 0)[:, None]
            step = rate * (means - centres[key])
            centres[key] = centres[key] + step
            most = max(most, float(np.abs(step).max(initial=0)))
        moved.append(most)
        if len(moved) >= 4 and max(moved[-4:]) <= tol * spread:
            break
    return centres


def _assign(points: DataFrame, centres: dict[int, np.ndarray], id_col: str) -> DataFrame:
    """(id, parent, centre): the nearest centre, the lowest of equals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, np.int32)
            if batch.num_rows:
                for p, rows, x in _by_parent(batch):
                    near[rows] = _distances(x, centres[p]).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)],
                                             names=["id", "parent", "centre"])
    return points.mapInArrow(run, "id long, parent int, centre int").select(F.col("id").alias(id_col), "parent", "centre")


def _points(df: DataFrame, id_col: str, vec: str, parent) -> DataFrame:
    """Points read over and over, cut from their lineage."""
    checkpoint_dir(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), parent.cast("int").alias("parent"),
                     F.col(vec).cast("array<float>").alias("vec")).checkpoint(eager=True)


def fit_top(points: DataFrame, k: int = 25, seed: int = 42, max_iter: int = 100,
            vec: str = "embedding", id_col: str = "id", restarts: int = STARTS):
    """Mini-batch k-means, the best of ``restarts`` starts by cost, polished by
    full rounds; returns (assignments, centroids).  Labels equal the
    reference's only up to a permutation (different draws)."""
    spark = points.sparkSession
    base = _points(points, id_col, vec, F.lit(0))
    schema = "cluster_id int, centroid array<double>"
    if base.isEmpty():
        return (points.select(id_col, F.lit(None).cast("int").alias("top_cluster_id")).limit(0),
                spark.createDataFrame([], schema))
    centres = minibatch(base, seeds(base, [0], k, seed, restarts), max_iter)
    cost = {key: c.sum() for key, (_, _, c) in _gather(base, centres).items()}
    best = _cheapest(centres, cost)
    polished, _ = lloyd(base, {(0, 0): best[0]}, min(max_iter, POLISH))
    final = polished[0, 0]
    assigned = _assign(base, {0: final}, id_col).select(id_col, F.col("centre").alias("top_cluster_id"))
    return assigned, spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(final)], schema)


def fit_sub(points: DataFrame, k2: int = 10, max_iter: int = 100, seed: int = 42,
            vec: str = "embedding", id_col: str = "id", tol: float = 1e-6, restarts: int = STARTS):
    """Sub-clusters inside every top cluster at once; returns
    (assignments(id, top, sub), centroid table).

    Parents with fewer than ``k2`` points keep everything in sub-cluster 0
    (centroid = their mean).  All parents and starts share each pass, and every
    parent takes its own cheapest start.  A sub-cluster that empties keeps its
    previous mean."""
    spark = points.sparkSession
    base = _points(points, id_col, vec, F.col("top_cluster_id"))
    sizes = {r["parent"]: r["n"] for r in base.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).collect()}  # k1 rows
    schema = "parent_cluster_id int, cluster_id int, centroid array<double>, size long"
    if not sizes:
        return (points.select(id_col, "top_cluster_id", F.lit(0).alias("sub_cluster_id")).limit(0),
                spark.createDataFrame([], schema))
    large = [p for p, n in sizes.items() if n >= k2]
    width = base.select(F.size("vec")).first()[0]
    centres = {p: np.zeros((1, width)) for p in sizes}
    if large:
        big = base.filter(F.col("parent").isin(large))
        centres |= _cheapest(*lloyd(big, seeds(big, large, k2, seed, restarts), max_iter, tol))
    counted = _gather(base, {(0, p): c for p, c in centres.items()})
    for p in set(sizes) - set(large):
        centres[p] = counted[0, p][0]
    rows = [(p, i, [float(x) for x in c], int(n)) for p in sorted(centres)
            for i, (c, n) in enumerate(zip(centres[p], counted[0, p][1], strict=True)) if n]
    assigned = _assign(base, centres, id_col).select(
        id_col, F.col("parent").alias("top_cluster_id"), F.col("centre").alias("sub_cluster_id"))
    return assigned, spark.createDataFrame(rows, schema)


def hierarchical(points: DataFrame, k1: int = 25, k2: int = 10, seed: int = 42,
                 max_iter: int = 100, vec: str = "embedding", id_col: str = "id"):
    """Top-level fit, then the joint sub-level fit; returns
    (assignments(id, top, sub), top centroids, sub centroids)."""
    top, top_cents = fit_top(points, k1, seed, max_iter, vec, id_col)
    pts = points.select(id_col, vec).join(top, id_col)
    sub, sub_cents = fit_sub(pts, k2, max_iter, seed, vec, id_col)
    return sub, top_cents, sub_cents


def project(points: DataFrame, k: int = 2, vec: str = "embedding", id_col: str = "id") -> DataFrame:
    """2-D / 3-D coordinates by PCA on L2-normalised vectors (re-aimed from a
    neighbour-graph layout); each axis' sign is fixed so that the largest
    absolute loading is positive, making runs comparable."""
    from pyspark.ml.feature import PCA, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array
    data = points.select(id_col, array_to_vector(F.col(vec)).alias("_v"))
    data = Normalizer(inputCol="_v", outputCol="_n", p=2.0).transform(data)
    model = PCA(k=k, inputCol="_n", outputCol="_p").fit(data)
    pc = model.pc.toArray()
    signs = [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(k)]
    arr = vector_to_array("_p")
    names = ["x_2d", "y_2d", "z_2d"][:k]
    return model.transform(data).select(
        id_col, *[(arr[j] * F.lit(signs[j])).alias(names[j]) for j in range(k)])
