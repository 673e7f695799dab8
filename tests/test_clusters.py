"""Joint sub-level k-means: well separated groups are recovered inside every
parent; small parents keep one sub-cluster."""

import numpy as np
import pytest

from civiclens.operators import clusters as K


@pytest.mark.parametrize("seed", [1, 2, 42])
def test_fit_sub_recovers_separated_groups(spark, seed):
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    i = 0
    for parent in (0, 1):
        for g, centre in enumerate(([0, 0], [10, 0], [0, 10])):
            for _ in range(30):
                rows.append((i, parent, [float(x) for x in np.asarray(centre) + rng.normal(0, 0.3, 2)]))
                truth[i] = (parent, g)
                i += 1
    for _ in range(2):  # a parent smaller than k2
        rows.append((i, 2, [1.0, 1.0])); truth[i] = (2, 0); i += 1
    df = spark.createDataFrame(rows, "id long, top_cluster_id int, embedding array<float>")
    assigned, cents = K.fit_sub(df, k2=3, max_iter=20, seed=seed)
    got = {r.id: (r.top_cluster_id, r.sub_cluster_id) for r in assigned.collect()}
    assert len(got) == len(rows)
    for parent in (0, 1):
        ids = [k for k, v in truth.items() if v[0] == parent]
        mapping = {}
        for k in ids:
            mapping.setdefault(truth[k][1], set()).add(got[k][1])
        assert all(len(v) == 1 for v in mapping.values())          # each true group in one cluster
        assert len({next(iter(v)) for v in mapping.values()}) == 3  # three distinct clusters
    assert {got[k] for k, v in truth.items() if v[0] == 2} == {(2, 0)}
    assert cents.filter("parent_cluster_id = 2").collect()[0]["size"] == 2
