import hashlib

from pyspark.sql import functions as F

from civiclens.llm import sharding as S
from tests.llm.helpers import docs, empty, prose


def bits(i, t):
    text = hashlib.md5((t or "").encode()).hexdigest()
    h = hashlib.md5(f"{'' if i is None else i}:{text}".encode()).hexdigest()
    return bin(int(h[:15], 16))[2:].zfill(60)


def brute(rows, limit):
    """Splits oversized buckets one bit at a time."""
    def split(prefix, members):
        if sum(len((t or "").encode()) for _, t in members) <= limit:
            return {(i, t): (prefix, len(prefix)) for i, t in members}
        out = {}
        for b in "01":
            if part := [m for m in members if bits(*m)[len(prefix)] == b]:
                out |= split(prefix + b, part)
        return out
    return split("", rows) if rows else {}


def test_matches_splitting_one_bit_at_a_time(spark):
    rows = [(i, prose(i % 40, i)) for i in range(300)] + [(None, "no id"), (400, None), (401, "")]
    for limit in (700, 2000, 10_000, 10_000_000):
        got = {(r["doc_id"], r["text"]): (r["shard"], r["depth"]) for r in S.shard(docs(spark, rows), limit).collect()}
        assert got == brute(rows, limit)


def test_every_shard_fits_with_repeats_and_long_rows(spark):
    rows = [(7, "hot row " * 5)] * 200 + [(i, prose(30, i)) for i in range(50)] + [(99, "z" * 5000)] * 3
    out = S.shard(docs(spark, rows), 1000)
    assert out.count() == len(rows)
    for r in S.directory(out).collect():
        assert r["n_bytes"] <= 1000 or r["n_rows"] == 1
    assert S.directory(out).count() < 60


def test_skewed_hashes_go_deeper(spark):
    rows = [(i, prose(20, i)) for i in range(400)]
    rows = sorted(rows, key=lambda r: bits(*r))[:60]  # all in one corner of the directory
    got = {(r["doc_id"], r["text"]): (r["shard"], r["depth"]) for r in S.shard(docs(spark, rows), 300).collect()}
    assert got == brute(rows, 300)


def test_empty_and_clashing_columns(spark, tmp_path):
    assert S.shard(empty(spark)).count() == 0
    df = docs(spark, [(1, "a"), (2, "b")]).withColumn("shard", F.lit(5)).withColumn("bits", F.lit(6)).withColumn("row", F.lit(7))
    out = S.shard(df)
    assert out.columns == [*df.columns, "n_bytes", "depth"] and {r["shard"] for r in out.collect()} == {""}
    S.write_shards(S.shard(docs(spark, [(i, prose(20, i)) for i in range(50)]), 1000), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
