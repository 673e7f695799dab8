import hashlib

from pyspark.sql import functions as F

from civiclens.llm import mixing as M
from tests.llm.helpers import docs, empty, prose


def key(i, t):
    text = hashlib.md5((t or "").encode()).hexdigest()
    return int(hashlib.md5(f"{'' if i is None else i}:{text}".encode()).hexdigest()[:15], 16)


def targets(sizes, epochs=3):
    """Raises a common level until the shares use up all words (bisection)."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, low, high = sum(sizes.values()), 0.0, 3.0 * sum(sizes.values()) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(w[s] * mid, epochs * sizes[s]) for s in names) < total else (low, mid)
    return {s: min(w[s] * high, epochs * sizes[s]) for s in names}


ROWS = ([(i, prose(5 + i % 60, i), "big") for i in range(400)] + [(1000 + i, prose(30, i), "mid") for i in range(60)]
        + [(2000 + i, prose(10, i), None) for i in range(5)] + [(3000, None, "blank"), (3001, "", "blank")]
        + [(4000 + i, prose(40, i), "Zebra") for i in range(40)])


def test_targets_and_taken_words(spark):
    out = M.mix(docs(spark, ROWS)).collect()
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = targets(sizes)
    longest = max(r["size"] for r in out)
    for s in sizes:
        mine = [r for r in out if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for r in mine)
        taken = sum(r["size"] * r["copies"] for r in mine)
        assert abs(taken - want[s]) <= 2 * longest, (s, taken, want[s])
        assert all(0 <= r["copies"] <= 3 for r in mine)
    assert sum(r["size"] * r["copies"] for r in out) <= sum(sizes.values())


def test_matches_one_queue(spark, monkeypatch):
    """The distributed order equals one sorted list; small windows change nothing."""
    monkeypatch.setattr(M, "WINDOW_ROWS", 7)
    out = {(r["doc_id"], r["text"]): r for r in M.mix(docs(spark, ROWS)).collect()}
    sizes = {}
    for r in out.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    names = sorted(s for s in sizes if s is not None) + [None]
    queue = []
    for rank, s in enumerate(names, 1):
        mine = sorted((key(i, t), i, out[i, t]["size"]) for i, t, src in ROWS if src == s)
        upto = 0
        for k, i, size in mine:
            upto += size
            queue += [((e * sizes[s] + upto) / (1 + (rank - 1) % 3), rank, e, k, i, size) for e in range(3)]
    budget, served, copies = sum(sizes.values()), 0, {}
    for f in sorted(queue):
        served += f[-1]
        if served > budget:
            break
        copies[f[4]] = copies.get(f[4], 0) + 1
    assert {i: r["copies"] for (i, _), r in out.items() if r["size"]} == {
        i: copies.get(i, 0) for (i, _), r in out.items() if r["size"]}


def test_reruns_agree_and_repeats(spark):
    df = docs(spark, ROWS + ROWS[:5])
    a, b = (sorted(map(tuple, M.mix(df).select("doc_id", "copies").collect())) for _ in range(2))
    assert a == b
    mixed = M.mix(df)
    assert M.repeat(mixed, df.columns).count() == mixed.agg(F.sum("copies")).first()[0]
    assert M.repeat(mixed, df.columns).columns == df.columns


def test_empty_and_clashing_columns(spark):
    assert M.mix(empty(spark)).count() == 0
    assert M.mix(docs(spark, [(1, None, None), (2, "", "a")])).agg(F.sum("copies")).first()[0] in (0, 2, 4, 6)
    df = docs(spark, ROWS).withColumn("size", F.lit("x")).withColumn("rank", F.lit(0)).withColumn("last", F.lit(1)).withColumn("k", F.lit(2))
    out = M.mix(df)
    assert out.columns == [*df.columns, "source_size", "target", "copies"]
    assert out.filter("rank = 0 AND last = 1 AND k = 2").count() == len(ROWS)
