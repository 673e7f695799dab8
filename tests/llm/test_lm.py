import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from civiclens.llm import lm
from tests.llm.helpers import docs, empty


def toks(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for i in range(240):
        tongue = "ab"[i % 2]
        out.append((i, " ".join(f"{tongue}{int(r.paretovariate(0.8)) % 400}{tongue}x" if r.random() < .9 else f"N{i}_{k}" for k in range(60))))
    return out + [(1000, None), (1001, ""), (1002, "A0ax a0AX"), (1002, "A0ax a0AX"), (1003, "Ünïcode   ÀB")]


def split(df):
    return df.filter("doc_id IS NULL OR doc_id % 5 <> 3")


def test_base_counts_and_better_than_base_on_held_out_texts(spark, rows, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 200)  # most words go through the join
    df = docs(spark, rows).select("doc_id", "text")
    model, counts = lm.train(split(df))
    got = lm.score(df, model, counts).collect()
    train = Counter(w for i, t in rows if i % 5 != 3 for w in toks(t))
    n, v = sum(train.values()), len(train)
    assert model.total == n and len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        found = toks(texts[r["doc_id"]])
        assert r["n_tokens"] == len(found) and r["n_known"] == sum(w in train for w in found)
        assert abs(r["base_score"] - sum(math.log10((train[w] + 1) / (n + v + 1)) for w in found)) < 1e-6
        assert r["score"] < 0
    held = [r for r in got if r["doc_id"] % 5 == 3]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_of_a_history_add_up_to_one(spark, rows):
    model, counts = lm.train(split(docs(spark, rows).select("doc_id", "text")))
    symbols, _ = model.numbers(lm.tokens("a1ax b2bx never-seen"))
    _, buckets = model.features([symbols])
    every = np.stack([np.exp(model.log_class(buckets, np.full(buckets.shape[1], c))) for c in range(lm.CLASSES)], axis=1)
    assert np.allclose(every.sum(axis=1), 1, atol=1e-4) and np.allclose(every, model.shares(buckets), atol=1e-5)
    inside = [0.0] * lm.ENDINGS
    head = {w for w, i in model.ids.items() if i < lm.HEAD}
    singles = [0] * lm.ENDINGS
    for r in counts.collect():
        w = bytes(r["word"])
        if w not in head:
            g = lm.ending(w)
            inside[g] += (r["c"] - model.ending_discount[g]) / model.ending_mass[g]
            singles[g] += r["c"] == 1
    for g in range(lm.ENDINGS):
        if inside[g]:
            assert abs(inside[g] + 10 ** model.ending_unseen[g] * max(singles[g], 1) - 1) < 1e-9


def test_native_ending_equals_python(spark):
    words = [b"a", b"\n", b"ab", "né".encode(), "日本".encode(), b"x" * 500, b"1."]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
    assert [r[1] for r in df.select("word", lm.ending_of(F.col("word"))).collect()] == [lm.ending(w) for w in words]


def test_merge_tree(spark, rows, monkeypatch):
    df = docs(spark, rows).select("doc_id", "text").repartition(9, "doc_id")
    monkeypatch.setattr(lm, "FAN_IN", 2)
    model, _ = lm.train(df)
    assert np.isfinite(model.weights).all() and np.abs(model.weights).max() > 0


def test_no_training_texts_and_empty_tables(spark):
    df = docs(spark, [(1, "a b"), (None, None), (2, "a b")]).select("doc_id", "text")
    model, counts = lm.train(df.limit(0))
    got = {r["doc_id"]: r for r in lm.score(df, model, counts).collect()}
    assert got[1]["n_known"] == 0 and got[1]["base_score"] == 0 and got[1]["n_tokens"] == 3 and got[None]["n_tokens"] == 1
    assert math.isclose(got[1]["score"], -3 * math.log10(lm.CLASSES), rel_tol=1e-5)
    model, counts = lm.train(df)
    assert lm.score(empty(spark).select("doc_id", "text"), model, counts).count() == 0


def test_the_24_most_frequent_words_have_classes_of_their_own(spark):
    df = docs(spark, [(i, " ".join(f"w{k}" for k in range(40 - i))) for i in range(40)]).select("doc_id", "text")
    model = lm.start_model(lm.count_words(df.select("text")))
    assert model.classes[:24].tolist() == list(range(24)) and model.classes[24:].min() == 24


def test_runs_are_summed_number_for_number_as_by_reduceat():
    rng = np.random.default_rng(5)
    for n, kinds in ((1, 1), (7, 1), (8, 1), (9, 1), (400, 3), (900, 200), (3000, 2000), (500, 10 ** 6)):
        rows = (rng.normal(size=(n, lm.CLASSES)) * 10.0 ** rng.integers(-6, 6, (n, 1))).astype(np.float32)
        keys = rng.integers(0, kinds, n).astype(np.uint32)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        assert (lm.sum_runs(rows, order, first) == np.add.reduceat(rows[order], first, axis=0)).all()


def test_a_step_sums_short_runs_without_a_loop_per_column(monkeypatch):
    """Only runs of more than 8 rows go through ``reduceat``."""
    runs = []
    whole = np.add.reduceat

    class Add:
        @staticmethod
        def reduceat(a, at, axis=0):
            runs.extend(np.diff(at, append=len(a)))
            return whole(a, at, axis=axis)
    rng = np.random.default_rng(6)
    buckets = np.minimum(rng.zipf(1.5, (lm.TEMPLATES, 2000)), lm.BUCKETS - 1).astype(np.uint16)
    m = lm.Model()
    shape = m.weights.shape[:2]
    monkeypatch.setattr(lm.np, "add", Add)
    lm.step(m.weights.copy(), m.bias.copy(), np.zeros(shape, np.int64), np.zeros(shape, np.float32), np.zeros_like(m.bias),
            m, rng.integers(0, lm.CLASSES, 2000).astype(np.int32), buckets)
    assert runs and min(runs) > 8
