"""Cluster assignment fallbacks, cosine edge cases and label word rules."""

import random

import numpy as np
from pyspark.sql import functions as F

from civiclens.functions.text import shorten
from civiclens.functions.vectors import cosine
from civiclens.operators import vectors as V


def test_cosine_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(cosine("a", "b").alias("c")).collect()] == [0.0, 1.0]


def _loop_assign(q, tops, subs, nonempty):
    """Direct transcription of the sequential search semantics (test oracle)."""
    def cos(a, b):
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        return 0.0 if na == 0 or nb == 0 else float(np.dot(a, b) / (na * nb))
    par = sorted(tops)
    sims = {p: cos(q, tops[p]) for p in par}
    best = max(par, key=lambda p: (sims[p], -p))
    kids = {c: v for (p, c), v in subs.items() if p == best}
    if not kids:
        if (best, 0) in nonempty:
            return best, 0
    cands = []
    for p in sorted(par, key=lambda p: (-sims[p], p)):
        for c in sorted((c for (pp, c) in subs if pp == p), key=lambda c: (-cos(q, subs[(p, c)]), c)):
            if (p, c) in nonempty:
                cands.append((p, c))
    return cands[0] if cands else None


def test_assign_set_form_equals_loop(spark):
    rng = random.Random(7)
    tops = {0: [1.0, 0.0], 1: [0.0, 1.0], 2: [0.7, 0.7]}
    subs = {(0, 0): [1.0, 0.1], (0, 1): [0.9, -0.2], (1, 0): [0.1, 1.0]}   # parent 2 has no children
    sizes = {(0, 0): 0, (0, 1): 3, (1, 0): 0, (2, 0): 5}
    nonempty = {k for k, v in sizes.items() if v > 0}
    qs = [(i, [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(200)]
    qdf = spark.createDataFrame(qs, "query_id long, embedding array<float>")
    tdf = spark.createDataFrame(list(tops.items()), "cluster_id int, centroid array<double>")
    sdf = spark.createDataFrame([(p, c, v) for (p, c), v in subs.items()],
                                "parent_cluster_id int, cluster_id int, centroid array<double>")
    zdf = spark.createDataFrame([(p, c, n) for (p, c), n in sizes.items()],
                                "parent_cluster_id int, cluster_id int, size long")
    got = {r.query_id: (r.parent_cluster_id, r.child_cluster_id)
           for r in V.assign(qdf, tdf, sdf, zdf).collect()}
    for i, v in qs:
        f32 = np.asarray(v, dtype=np.float32).astype(np.float64)
        exp = _loop_assign(f32, {k: np.asarray(x) for k, x in tops.items()},
                           {k: np.asarray(x) for k, x in subs.items()}, nonempty)
        assert got.get(i) == exp, (i, v)


def test_shorten_rules(spark):
    cases = [("Roads, traffic and sidewalks", 3, "Roads, traffic"),
             ("Garbage and", 3, "Garbage"),
             ("Service request for parking", 3, "Service request for"),
             ("Trees", 3, "Trees"),
             ("and or", 3, "and or"),
             ("", 3, "")]
    df = spark.createDataFrame([(s, m) for s, m, _ in cases], "s string, m int")
    got = [r.x for r in df.select(shorten(F.col("s"), 3).alias("x")).collect()]
    assert got == [x for _, _, x in cases]


def test_pandas_encoder_and_worker_model(spark):
    calls = []

    def encode(texts):
        model = V.worker_model("len-model", lambda: calls.append(1) or (lambda t: [float(len(t)), 1.0]))
        return np.asarray([model(t) for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("ab",), (None,), ("abcd",)], "text string")
    out = [r.embedding for r in V.pandas_encoder(df, "text", encode).collect()]
    assert out[0] == [2.0, 1.0] and out[1] is None and out[2] == [4.0, 1.0]


def test_cluster_sizes_with_centroids(spark):
    df = spark.createDataFrame([(1, 0, 0, [1.0, 0.0]), (2, 0, 0, [3.0, 0.0]), (3, 1, 1, [0.0, 2.0])],
                               "id long, top_cluster_id int, sub_cluster_id int, embedding array<float>")
    rows = {(r.level, r.parent_cluster_id, r.cluster_id): (r["size"], r.centroid)
            for r in V.cluster_sizes(df, k1=2, k2=2, vec="embedding").collect()}
    assert rows[(1, None, 0)] == (2, [2.0, 0.0])
    assert rows[(2, 0, 1)] == (0, None)                          # empty cluster, no centroid
    assert rows[(2, 1, 1)] == (1, [0.0, 2.0])
