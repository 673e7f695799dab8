import math
import random

from pyspark.sql import functions as F

from civiclens.llm import search as S

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:k]
            out += [(q, n, i, max(-2 ** 63, min(2 ** 63 - 1, -s))) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, k=10, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(map(tuple, S.top_k(df, df.filter(F.col("vec_id") % 100 == 0), k).collect()))


def rows(n=450, dim=16, seed=1):
    r = random.Random(seed)
    return [(i, [r.choice([0.0, r.uniform(-2, 2)]) for _ in range(dim)]) for i in range(n)]


def test_matches_brute_force(spark, monkeypatch):
    extra = [(500, None), (600, [1.0, None]), (700, [float("nan")]), (800, [float("inf"), 1.0]), (900, []), (None, [1.0] * 16),
             (1000, [0.5] * 30), (-100, [1.0])]
    assert run(spark, rows() + extra) == brute(rows() + extra)
    monkeypatch.setattr(S, "ROW_BLOCK", 7)
    monkeypatch.setattr(S, "QUERY_BLOCK", 2)
    assert run(spark, rows() + extra) == brute(rows() + extra)


def test_many_passes(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BYTES", 300)
    assert run(spark, rows()) == brute(rows())


def test_the_plan_does_not_grow_with_the_passes(spark, monkeypatch):
    """Passes are written one after another: the result is one scan."""
    df = spark.createDataFrame(rows(2000, 3) + [(100, [1.0, 2.0, 3.0])] * 40, SCHEMA)
    monkeypatch.setattr(S, "QUERY_BYTES", 100)
    held = []
    postings = S.postings
    monkeypatch.setattr(S, "postings", lambda ids, vecs: held.append(len(ids)) or postings(ids, vecs))
    out = S.top_k(df, df.filter("vec_id % 100 = 0"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert len(held) > 15 and max(held) < 10 and sum(held) == 21
    assert out.filter("query_id = 100").count() == 41 * 10


def test_ties_go_to_the_smaller_id_and_few_candidates_give_all(spark):
    same = [(i, [1.0, -0.3]) for i in range(300)]
    assert run(spark, same) == brute(same)
    assert run(spark, same[:4]) == brute(same[:4]) and len(run(spark, same[:4])) == 3
    assert run(spark, same[:1]) == []


def test_sums_beyond_64_bits(spark):
    big = [(0, [1e17, 3e17, 0.1]), (1, [2e16, 1.0, -1.5]), (2, [-3e18, 5.0, 2.0]), (3, [1.0, 1.0, 1.0])]
    assert run(spark, big) == brute(big)


def test_empty_repeated_and_extra_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame(rows(120) + [(100, [1.0] * 16)], SCHEMA).withColumn("id", F.lit(1)).withColumn("score", F.lit(2))
    out = S.top_k(df, df.filter("vec_id % 100 = 0"))
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert out.filter("query_id = 100").count() == 20 and out.filter("vec_id = query_id").count() == 0
