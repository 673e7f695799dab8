import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from civiclens.llm import simhash as S
from tests.llm.helpers import docs, empty, prose


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(fps, distance):
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= distance:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fps}


def partition(pairs):
    groups = {}
    for node, root in pairs:
        groups.setdefault(root, set()).add(node)
    return sorted(map(sorted, groups.values()))


TEXTS = ["", None, " \n", "One", "one two", "ONE two THREE", "a\tb\x0bc\x0cd", "É é Straße ÀB", prose(40), prose(3000), "x " * 50_000]


def test_fingerprints(spark):
    got = {r["doc_id"]: r["fp"] & (2 ** 64 - 1) for r in S.fingerprints(docs(spark, list(enumerate(TEXTS))).select("doc_id", "text")).collect()}
    assert got == {i: fingerprint(t) for i, t in enumerate(TEXTS)}


def test_long_texts_are_counted_in_chunks(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 7)
    for t in TEXTS[:-1]:
        assert S.text_fingerprint(t) == fingerprint(t)


def test_links_connect_what_all_pairs_connect(spark):
    r = random.Random(5)
    signed = lambda x: x - 2 ** 64 if x >> 63 else x
    fps = {r.getrandbits(64) for _ in range(200)}
    for base in [r.getrandbits(64) for _ in range(8)]:  # chains and balls of near fingerprints
        x = base
        for _ in range(25):
            x ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            fps.add(x)
        fps |= {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(60)}
    fps |= {0, 2 ** 64 - 1, 1 << 63}
    fps = [signed(f) for f in fps]
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for distance, hot in ((0, 32), (1, 4), (2, 1), (2, 8), (2, 10_000), (3, 2)):
        got = S.components(S.links(frame, distance, segments=5, hot_rows=hot)).collect()
        pairs = {f: f for f in fps} | {r["node"]: r["root"] for r in got}
        assert partition(pairs.items()) == partition(roots(fps, distance).items()), (distance, hot)


def test_ring_condition_never_loses_a_pair():
    r = random.Random(9)
    for _ in range(2000):
        a = r.getrandbits(64)
        b = a ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
        ones = [bin((a ^ b) >> s & ((1 << (e - s)) - 1)).count("1") for s, e in zip(S._cuts(5), S._cuts(5)[1:], strict=False)]
        assert any(all(sum(ones[(p + i) % 5] for i in range(n)) * 5 <= n * 2 for n in range(1, 6)) for p in range(5))


def test_forest_in_blocks(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(0)
    fps = np.unique(rng.integers(0, 2 ** 9, 150) | (rng.integers(0, 2, 150) << 63))
    links = S.forest(fps, 2)
    want = roots(fps.tolist(), 2)
    assert len(links) == len(fps) - len(set(want.values()))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    got = S.components(edges).collect()
    assert len(got) == 300 and {r["root"] for r in got} == {0}


def test_components_and_dedup(spark):
    base = prose(2000)
    rows = [(5, base), (3, base), (9, base + " ."), (None, "one"), (None, "two"), (7, None), (6, ""), (8, "alone in the world"),
            (4, "same id"), (4, "same id"), (4, "other text of one id")]
    df = docs(spark, rows).withColumn("fp", F.lit(1)).withColumn("n", F.lit(2)).withColumn("id", F.lit(3))
    got = {(r["doc_id"], r["text"]) for r in S.dedup(df).collect()}
    assert S.dedup(df).columns == df.columns
    near = fingerprint(base) ^ fingerprint(base + " .")
    want = {(3, base), (None, "one"), (None, "two"), (6, ""), (8, "alone in the world"), (4, "same id"), (4, "other text of one id")}
    assert got == (want if bin(near).count("1") <= 2 else want | {(9, base + " .")})
    assert S.dedup(df).count() == len(got)
    marked = {(r["doc_id"], r["component_id"]) for r in S.cluster(docs(spark, rows[:2]).select("doc_id", "text")).collect()}
    assert marked == {(5, 3), (3, 3)}
    assert S.dedup(empty(spark)).count() == 0 and S.cluster(empty(spark).select("doc_id", "text")).count() == 0
