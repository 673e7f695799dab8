import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from civiclens.llm import toxicity as X
from tests.llm.helpers import docs, empty, prose

BAD = ["vile", "rotten", "wretch", "scorn"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = []
    for i in range(900):
        words = prose(20 + i % 200, i).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", ".", ","]))
        out.append((i, " ".join(words), "s", "en" if i % 3 else "de", int(toxic)))
    return out


@pytest.fixture(scope="module")
def model(spark, rows):
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows] + [(None, 1), (10 ** 6, 0)], "doc_id long, toxic int")
    return X.train(docs(spark, [r[:4] for r in rows]), labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))


def test_held_out_accuracy(spark, rows, model):
    out = {r["doc_id"]: r["score"] for r in X.score(docs(spark, [r[:4] for r in rows]), model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    toxic = [out[r[0]] >= 0.7 for r in held if r[4]]
    clean = [out[r[0]] >= 0.7 for r in held if not r[4]]
    assert np.mean(toxic) > 0.95 and np.mean(clean) < 0.02
    assert set(model.thresholds) == {None, "en", "de"} and all(0 < t <= 1 for t in model.thresholds.values())


def test_batches_do_not_change_scores(model):
    texts = [X.encode(model.rows, X.buckets(t)) for t in ("", "vile", "a b c", prose(500, 1) + " rotten", "  ")]
    together = model.score(texts)
    assert np.allclose(together, [model.score([t])[0] for t in texts])
    assert ((together >= 0) & (together <= 1)).all() and together[1] > 0.7 > together[2]


def test_nulls_long_texts_and_other_columns(spark, model):
    df = docs(spark, [(1, None, None, None), (2, "", "s", "xx"), (3, prose(60_000) + " vile"), (3, prose(60_000) + " vile"), (None, "vile")])
    out = X.score(df.withColumn("row", F.lit(1)), model)
    assert out.columns == [c for c in df.columns if c != "text"] + ["row", "score"]
    got = out.withColumn("t", X.threshold(model, F.col("lang"))).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and by[1]["score"] == by[2]["score"] < 0.5 and by[3]["score"] > 0.7 and by[1]["t"] == model.thresholds[None]
    assert X.score(empty(spark), model).count() == 0


def test_one_class_or_no_labels(spark):
    df = docs(spark, [(i, "some text") for i in range(4)])
    one = X.train(df, df.select("doc_id", F.lit(1).alias("toxic")))
    none = X.train(df, df.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert X.score(df, one).first()["score"] > 0.99 and abs(X.score(df, none).first()["score"] - 0.5) < 1e-9


def test_repeated_doc_ids_neither_displace_rows_nor_multiply(spark, monkeypatch):
    monkeypatch.setattr(X, "MAX_NEGATIVE", 120)
    fetched = []
    fit = X.fit_network
    monkeypatch.setattr(X, "fit_network", lambda texts, y: fetched.append((texts, y)) or fit(texts, y))
    ids = spark.range(100).orderBy(F.xxhash64("id", F.lit(X.SEED))).collect()
    hot = ids[0]["id"]  # the smallest hash
    rows = [(i, f"clean words {i}" if i % 2 or i == hot else f"vile words {i}") for i in range(100)]
    rows += [(hot, f"clean words {hot}")] * 2000 + [(hot, f"hot text {k}") for k in range(1000)]
    clean = {i for i, t in rows if t.startswith("clean")}
    labels = spark.createDataFrame([(i, int(i not in clean)) for i in range(100)] + [(hot, 0)] * 3, "doc_id long, toxic int")
    X.train(docs(spark, rows), labels)
    (texts, y), = fetched
    held = -(-(120 + 100 - len(clean)) // 5)
    assert len(texts) == 120 + 100 - len(clean) - held
    marks = {X.bucket(str(i)) for i in clean}
    seen = set().union(*({b for b in t.tolist()} for t, k in zip(texts, y, strict=True) if not k)) & marks
    assert len(seen) >= len(clean) - held  # a fifth calibrates


def test_every_labelled_row_counts_beyond_the_first_sample(spark, rows, monkeypatch):
    monkeypatch.setattr(X, "MAX_NEGATIVE", 30)
    monkeypatch.setattr(X, "MAX_POSITIVE", 30)
    monkeypatch.setattr(X, "SHARD_ROWS", 100)
    seen = {}
    calibrate = X._calibrate
    monkeypatch.setattr(X, "_calibrate", lambda r, *rest: seen.update(held=r.count()) or calibrate(r, *rest))
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, toxic int")
    texts = docs(spark, [r[:4] for r in rows])
    model = X.train(texts, labels)
    assert 120 < seen["held"] < 240  # about a fifth of 900 rows, not of 60
    words = [set(X.buckets(r[1]).tolist()) for r in rows]
    often = {b for b in set().union(*words) if sum(b in w for w in words) > 100}
    assert often <= set(model.rows.tolist())
    again = X.train(texts, labels)
    assert (again.emb == model.emb).all() and again.thresholds == model.thresholds
    out = {r["doc_id"]: r["score"] >= X.DECISION for r in X.score(texts, model).collect()}
    assert np.mean([out[r[0]] == bool(r[4]) for r in rows]) > 0.97
