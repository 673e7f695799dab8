"""Toxicity by a convolutional text classifier.

Words are hashed into 2^22 buckets; a bucket that at least two training texts
hold has an embedding, every other word has the zero one.  Filters of several
widths slide over the embedded words, each is max-pooled over the whole text,
and a logistic layer reads the pooled values.  Filters and embeddings start from
a network fitted to a bounded sample of labelled rows (``MAX_POSITIVE`` and
``MAX_NEGATIVE`` rows, by hash of the id); then all labelled rows are counted
for the vocabulary and its log-odds, and trained on in ``ROUNDS`` rounds: the
rows are dealt by hash into shards of about ``SHARD_ROWS``, each shard takes
Adam steps from the same weights, and the shards' weights are averaged by how
often each was used.  Before training one embedding
dimension holds the bucket's log-odds, which a filter of each
width starts out reading; the rest starts at random (fixed seed).

A fifth of the labelled rows is held back: it fits the logistic scale and
offset, at the label shares of all labelled training rows, and the threshold of
each language (best F1), both from counts by logit in cells of 1 / CELLS.  A
language column picks a threshold; it is no input of the score, nor is any other
column but the text.

Defined cases: a null or empty text scores as a text without known words; no
labelled rows of one class: every score is the share of label 1 (0.5 without
rows); repeated rows get the same score; unknown or null languages use the
overall threshold; extra columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclens.llm.common import positional, renamed, saved, written

#: Bound of the starting network's sample by class; slices of a key in its
#: ranking; hash buckets; model shape.
MAX_POSITIVE = 4000
MAX_NEGATIVE = 4000
SLICES = 64
BUCKETS = 1 << 22
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 4
BATCH = 32
SEED = 42
#: Rounds over all labelled rows and rows of a shard; step sizes of the starting
#: network and of the rounds; fixed-point unit of the averages; cells of a unit
#: of the logit.
ROUNDS = 2
SHARD_ROWS = 2048
RATES = (0.01, 0.003)
#: Labelled rows (no texts) that are broadcast to the documents; more are joined by key.
LOOKUP_ROWS = 1_000_000
UNIT = 1 << 20
CELLS = 256
#: A text counts as toxic from this score on (fixed value).
DECISION = 0.7
#: Characters stripped from a word's ends, words a worker remembers.
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~"
CACHE_WORDS = 300_000


def bucket(word: str) -> int:
    return zlib.crc32(word.strip(EDGES).encode("utf-8", "surrogatepass")) % BUCKETS


def buckets(text: str | None) -> np.ndarray:
    """Hash buckets of a text's words, in order."""
    return np.fromiter(map(bucket, (text or "").lower().split()), np.int32)


def encode(rows: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Embedding rows of hashed words: place in the sorted ``rows`` from 1 on, 0
    for buckets not there."""
    if not len(rows):
        return np.zeros(len(hashed), np.int32)
    at = np.minimum(np.searchsorted(rows, hashed), len(rows) - 1)
    return np.where(rows[at] == hashed, at + 1, 0).astype(np.int32)


def _spaced(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by as many blanks as the widest
    filter has places; where each starts and its size with the blanks."""
    gap = np.zeros(max(WIDTHS), np.int32)
    joined = np.concatenate([x for t in texts for x in (t, gap)] + [gap])
    sizes = np.array([len(t) + len(gap) for t in texts])
    return joined, np.cumsum(sizes) - sizes, sizes


@dataclass
class Model:
    """rows: sorted buckets with an embedding; emb: their embeddings from row 1 on
    (0: unknown); filters[w][o]: what the filters of width w read at offset o."""

    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    emb: np.ndarray = field(default_factory=lambda: np.zeros((1, DIM), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))  # offset while training
    offset: float = 0.0
    scale: float = 1.0
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """Max-pooled filter values (at least 0) of texts given as rows."""
        if not texts or not self.filters:
            return np.zeros((len(texts), len(self.out)), np.float32)
        joined, starts, sizes = _spaced(texts)
        lookup, cols = self.emb[joined], []
        for parts, bias in zip(self.filters, self.bias, strict=True):
            total = lookup[:len(joined) - len(parts)] @ parts[0]
            for o in range(1, len(parts)):
                total += lookup[o:len(joined) - len(parts) + o] @ parts[o]
            # Every other range is a text's windows; the rest cross its end.
            ranges = np.stack([starts, starts + sizes - len(parts) + 1], axis=1).ravel()
            cols.append(np.maximum(np.maximum.reduceat(total, ranges, axis=0)[::2] + bias, 0))
        return np.concatenate(cols, axis=1)

    def logit(self, texts: list[np.ndarray]) -> np.ndarray:
        pooled = self.pooled(texts)
        return pooled @ self.out if len(self.out) else np.zeros(len(texts), np.float32)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.calibrated(self.logit(texts).astype(np.float64))

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        z = self.scale * logit + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state = rate, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v, n = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value), [0]))
        n[0] += 1
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.999 * v[at] + 0.001 * grad * grad
        fix = np.sqrt(1 - 0.999 ** n[0]) / (1 - 0.9 ** n[0])
        value[at] -= self.rate * fix * m[at] / (np.sqrt(v[at]) + 1e-8)


def _odds(n_all: np.ndarray, n_pos: np.ndarray, rows: float, positive: float) -> np.ndarray:
    """Log-odds of buckets as they stand in the embeddings' first dimension."""
    odds = np.log((n_pos + 0.5) / (positive + 1)) - np.log((n_all - n_pos + 0.5) / (rows - positive + 1))
    return np.clip(odds, -4, 4) / 4


def fit_network(texts: list[np.ndarray], y: np.ndarray) -> Model:
    """Embeddings, filters and output layer from hashed texts and 0/1 labels."""
    rng = np.random.default_rng(SEED)
    sets = [np.unique(t) for t in texts]
    ids, n_all = np.unique(np.concatenate(sets), return_counts=True)
    hit = np.concatenate([s for s, k in zip(sets, y, strict=True) if k])
    n_pos = np.searchsorted(np.sort(hit), ids, "right") - np.searchsorted(np.sort(hit), ids, "left")
    keep = n_all >= 2
    ids, n_all, n_pos = ids[keep], n_all[keep], n_pos[keep]
    emb = rng.normal(0, 0.05, (len(ids) + 1, DIM)).astype(np.float32)
    emb[1:, 0] = _odds(n_all, n_pos, len(y), y.sum())
    emb[0] = 0
    weights = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in weights:
        w[0, 0, 0] = 2.0
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    bias = [b - np.eye(1, FILTERS, dtype=np.float32)[0] for b in bias]
    out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
    out[::FILTERS] = 1.0
    model = Model(ids, emb, weights, bias, out)
    coded, adam = [encode(ids, t) for t in texts], _Adam(RATES[0])
    for _ in range(EPOCHS):
        _epoch(model, coded, y, np.ones(len(y), np.float32), adam, rng.permutation(len(coded)))
    return model


def _epoch(m: Model, texts: list[np.ndarray], y: np.ndarray, n: np.ndarray, adam: _Adam, order: np.ndarray) -> None:
    """Adam steps in place over texts given as rows, each standing for ``n`` rows."""
    for first in range(0, len(order), BATCH):
        some = order[first:first + BATCH]
        joined, starts, sizes = _spaced([texts[i] for i in some])
        lookup = m.emb[joined]
        pooled, at = [], []
        for w, b in zip(m.filters, m.bias, strict=True):
            total = lookup[:len(joined) - len(w)] @ w[0]
            for o in range(1, len(w)):
                total += lookup[o:len(joined) - len(w) + o] @ w[o]
            ends = starts + sizes - len(w) + 1
            where = np.stack([s + np.argmax(total[s:e], axis=0) for s, e in zip(starts, ends, strict=True)])
            at.append(where)
            pooled.append(np.take_along_axis(total, where, 0) + b)
        raw = np.concatenate(pooled, axis=1)
        act = np.maximum(raw, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ m.out + m.start[0], -30, 30)))
        err = ((p - y[some]) * n[some] / n[some].sum()).astype(np.float32)
        d_out = act.T @ err
        d_raw = err[:, None] * m.out[None, :] * (raw > 0)
        touched, grads = [], []
        for k, (w, b) in enumerate(zip(m.filters, m.bias, strict=True)):
            d = d_raw[:, k * FILTERS:(k + 1) * FILTERS]
            d_w = np.zeros_like(w)
            for o in range(len(w)):
                spots = at[k] + o
                x = lookup[spots]  # text, filter, dim
                d_w[o] = np.einsum("tfd,tf->df", x, d)
                touched.append(joined[spots].ravel())
                grads.append((d[:, :, None] * w[o].T[None]).reshape(-1, DIM))
            adam.step(f"w{k}", w, d_w + 1e-5 * w)
            adam.step(f"b{k}", b, d.sum(axis=0))
        adam.step("out", m.out, d_out + 1e-4 * m.out)
        adam.step("offset", m.start, err.sum(keepdims=True))
        uniq, back = np.unique(np.concatenate(touched), return_inverse=True)
        g = np.zeros((len(uniq), DIM), np.float32)
        np.add.at(g, back, np.concatenate(grads))
        g[uniq == 0] = 0
        adam.step("emb", m.emb, g, uniq)
        m.emb[0] = 0


def _logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and offset of a weighted logistic fit with a slight pull to scale 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z * weight).sum() + 0.01 * (a - 1), ((p - y) * weight).sum() + 1e-3 * b])
        s = p * (1 - p) * weight
        h = np.array([[(s * z * z).sum() + 0.01, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return max(a, 0.05), b


def _threshold(score: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> float:
    """The score from which on label 1 is called with the best F1; ``hits`` of
    the ``rows`` with a score have label 1."""
    order = np.argsort(-score, kind="stable")
    f1 = 2 * np.cumsum(hits[order]) / (np.cumsum(rows[order]) + hits.sum())
    return float(score[order][int(np.argmax(f1))])


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int32)


def _examples(docs: DataFrame, seen: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """One row per labelled key, text and label: y, t, h, n, shard, held, lang and
    the words' buckets.  Words are hashed where the text is read."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # copies of a row leave a task once
        for b in batches:
            marks = list(zip(*[b.column(c).to_pylist() for c in ("y", "t", "h", "lang")], strict=True))
            new = [i for i, m in enumerate(marks) if not (m in done or done.add(m))]
            rest = b.take(pa.array(new, pa.int64()))
            words = [buckets(b.column("text")[i].as_py()).tobytes() for i in new]
            yield pa.RecordBatch.from_arrays([*rest.columns[:-1], pa.array(words, pa.binary())],
                                             names=[*b.schema.names[:-1], "words"])

    texts = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("t"), F.col(lang).cast("string").alias("lang"),
                        F.col(text).alias("text"))
    marked = texts.join(seen, ["id", "t"]).select("y", "t", "h", "n", "shard", "held", "lang", "text")
    rows = marked.mapInArrow(hashed, "y int, t long, h long, n long, shard long, held boolean, lang string, words binary")
    return written(rows.groupBy("y", "t", "h", "n", "shard", "held").agg(F.min(F.struct("lang", "words")).alias("row"))
                   .select("y", "t", "h", "n", "shard", "held", "row.lang", "row.words"))


def _vocabulary(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets that two or more texts hold, in how many, and in how many of label 1."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(_ints(w.as_py())) for w in b.column("words")]
            ids, back = np.unique(np.concatenate([np.zeros(0, np.int32), *sets]), return_inverse=True)
            y = np.repeat(b.column("y").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.bincount(back, minlength=len(ids))),
                 pa.array(np.bincount(back, y, len(ids)).astype(np.int64))], names=["bucket", "n", "hits"])

    got = (rows.select("y", "words").mapInArrow(counted, "bucket int, n long, hits long").groupBy("bucket")
           .agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).filter("n >= 2").toArrow().sort_by("bucket"))
    return tuple(got[c].to_numpy() for c in ("bucket", "n", "hits"))


def _flat(m: Model) -> np.ndarray:
    """Filters, biases and output layer in rows of DIM numbers."""
    flat = np.concatenate([x.ravel() for x in (*m.filters, *m.bias, m.out, m.start)])
    return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)


def _shaped(m: Model, flat: np.ndarray) -> None:
    """Takes what ``_flat`` gave."""
    flat, at = flat.ravel(), 0
    for x in (*m.filters, *m.bias, m.out, m.start):
        x[...] = flat[at:at + x.size].reshape(x.shape)
        at += x.size


def _round(rows: DataFrame, model: Model, number: int) -> None:
    """Every shard trains a copy of the model on its rows; the copies' means, by
    how many texts used a row of the embeddings, become the model.  The sums are
    integers, so their order does not matter."""
    def shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "t", "y"])
        texts = [encode(model.rows, _ints(w)) for w in group["words"]]
        used, uses = np.unique(np.concatenate([np.zeros(1, np.int32), *map(np.unique, texts)]), return_counts=True)
        own = Model(model.rows, model.emb[used], [w.copy() for w in model.filters], [b.copy() for b in model.bias],
                    model.out.copy(), model.start.copy())
        rng = np.random.default_rng([SEED, number, int(group["shard"].iloc[0])])
        _epoch(own, [np.searchsorted(used, t) for t in texts], group["y"].to_numpy(np.float32),
               group["n"].to_numpy(np.float32), _Adam(RATES[1]), rng.permutation(len(group)))
        flat = _flat(own)
        at = np.concatenate([used, np.arange(len(flat)) + len(model.emb)])
        n = np.concatenate([uses, np.full(len(flat), len(group))]).astype(np.int64)
        sums = np.rint(np.concatenate([own.emb, flat]).astype(np.float64) * UNIT).astype(np.int64) * n[:, None]
        return pd.DataFrame({"row": at.astype(np.int64), "n": n} | {f"v{i}": sums[:, i] for i in range(DIM)})

    names = ["n", *[f"v{i}" for i in range(DIM)]]
    trained = rows.groupBy("shard").applyInPandas(shard, "row long, " + ", ".join(f"{c} long" for c in names))
    merged = trained.groupBy("row").agg(*[F.sum(c).alias(c) for c in names])
    got = merged.select("row", *[(F.col(c) / F.col("n") / UNIT).cast("float").alias(c) for c in names[1:]]).toArrow()
    at, means = got["row"].to_numpy(), np.stack([got[c].to_numpy() for c in names[1:]], axis=1)
    inside = at < len(model.emb)
    model.emb[at[inside]] = means[inside]
    model.emb[0] = 0
    flat = np.zeros_like(_flat(model))
    flat[at[~inside] - len(model.emb)] = means[~inside]
    _shaped(model, flat)


def _calibrate(rows: DataFrame, model: Model, n0: int, n1: int) -> None:
    """Scale, offset and thresholds from the rows' counts by language and logit."""
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.clip(model.logit([encode(model.rows, _ints(w.as_py())) for w in b.column("words")]), -60, 60)
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(np.floor(z * CELLS).astype(np.int32)),
                                              b.column("y"), b.column("n")], names=["lang", "cell", "y", "n"])

    got = (rows.select("lang", "words", "y", "n").mapInArrow(cells, "lang string, cell int, y int, n long")
           .groupBy("lang", "cell").agg(F.sum("n").alias("n"), F.sum(F.col("y") * F.col("n")).alias("hits"))
           .orderBy("cell", "lang").toArrow())
    z, n, hits = got["cell"].to_numpy() / CELLS, got["n"].to_numpy().astype(float), got["hits"].to_numpy().astype(float)
    weight = np.concatenate([hits * n1 / max(hits.sum(), 1), (n - hits) * n0 / max((n - hits).sum(), 1)])
    both, target = np.concatenate([z, z]), np.concatenate([np.ones(len(z)), np.zeros(len(z))])
    model.scale, model.offset = _logistic(both, target, weight * n.sum() / weight.sum())
    score = model.calibrated(z)
    model.thresholds = {None: _threshold(score, hits, n)}
    langs = np.array(got["lang"].to_pylist(), object)
    for name in sorted({x for x in langs if x is not None}):
        mine = langs == name
        if 0 < hits[mine].sum() < n[mine].sum():
            model.thresholds[name] = _threshold(score[mine], hits[mine], n[mine])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          lang: str = "lang") -> Model:
    """A model from the documents that ``labels`` (key, label) marks.

    All of them are counted, trained on or calibrate.  A key's equal texts with
    the same label are one row that weighs as many.  The starting network's
    sample is drawn from keys, labels and text hashes: distinct texts, the first
    of every key before the second of any, in the order of the keys' hashes, at
    most MAX_POSITIVE + MAX_NEGATIVE rows.
    """
    marks = (labels.filter(F.col(label).isin(0, 1))
             .groupBy(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("m")))
    hashes = docs.groupBy(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    seen = saved(marks.join(hashes, "id").select(
        "id", "y", "t", F.xxhash64("id", F.lit(SEED)).alias("h"), (F.col("m") * F.col("n")).alias("n")))
    shares = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    if not n0 or not n1:
        rate = n1 / (n0 + n1) if n0 + n1 else 0.5
        return Model(offset=float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))))

    def ranked(rows: DataFrame, most: int) -> DataFrame:
        # Slices of a key come first, so that no task ranks more of it than SLICES * most rows.
        for part in (["id", F.pmod("t", F.lit(SLICES))], ["id"]):
            rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy("t"))).filter(
                F.col("rank") <= most)
        return rows.orderBy("rank", "h", "id", "t").limit(most).select("id", "y", "t", "h")

    drawn = [ranked(seen.filter(F.col("y") == y), most) for y, most in ((0, MAX_NEGATIVE), (1, MAX_POSITIVE))]
    place = F.row_number().over(Window.orderBy("h", "t", "y")) - 1  # over the bounded sample
    chosen = saved(drawn[0].unionByName(drawn[1]).withColumn("place", place))
    fifth = F.col("place") % 5 == 0
    parts = chosen.groupBy(fifth.alias("held")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("labels"))
    parts = {r["held"]: r for r in parts.collect()}
    # The sample's places decide for its rows, as they did when it was all there was.
    split = sum(r["n"] for r in parts.values()) >= 50 and all(r["labels"] == 2 for r in parts.values())
    size = seen.count()
    shards = -(-size // SHARD_ROWS)
    held = F.coalesce(fifth, F.pmod(F.xxhash64("h", "t", F.lit(SEED)), F.lit(5)) == 0) if split else F.lit(False)
    dealt = written(seen.join(F.broadcast(chosen.select("id", "t", "y", "place")), ["id", "t", "y"], "left").withColumns(
        {"held": held, "shard": F.pmod(F.xxhash64("t", "h"), F.lit(shards))}).drop("place"))
    rows = _examples(docs, F.broadcast(dealt) if size <= LOOKUP_ROWS else dealt, key, text, lang)
    drawn_rows = rows.filter(~F.col("held")).join(F.broadcast(chosen.select("h", "t", "y")), ["h", "t", "y"])
    got = drawn_rows.select("h", "t", "y", "words").toArrow().sort_by([(c, "ascending") for c in ("h", "t", "y")])
    model = fit_network([_ints(w.as_py()) for w in got["words"]], got["y"].to_numpy().astype(np.float32))
    learnt = rows.filter(~F.col("held"))
    start, (ids, n_all, n_pos) = model, _vocabulary(learnt)
    count, positive = learnt.agg(F.count(F.lit(1)), F.sum("y")).first()
    emb = np.random.default_rng(SEED).normal(0, 0.05, (len(ids) + 1, DIM)).astype(np.float32)
    old = encode(start.rows, ids)
    emb[1:][old > 0] = start.emb[old[old > 0]]
    emb[1:, 0] = _odds(n_all, n_pos, count, positive)
    emb[0] = 0
    model.rows, model.emb = ids, emb
    for number in range(ROUNDS):
        _round(learnt, model, number)
    _calibrate(rows.filter("held") if split else rows, model, n0, n1)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` in place of the text (and of an input column so
    named): whole texts, one pass."""
    plain, kept = positional(docs, text)
    return renamed(_scored(plain, model, "text"), kept, "score")


def _scored(docs: DataFrame, model: Model, text: str) -> DataFrame:
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def coded(t: str | None) -> np.ndarray:
            found = (t or "").lower().split()
            ids = list(map(known.get, found))
            if None in ids:
                new = list({w for i, w in zip(ids, found, strict=True) if i is None})
                at = dict(zip(new, encode(model.rows, np.fromiter(map(bucket, new), np.int32, len(new))).tolist(), strict=True))
                ids = [at[w] if i is None else i for w, i in zip(found, ids, strict=True)]
                if len(known) < CACHE_WORDS:
                    known.update(at)
            return np.array(ids, np.int32)

        for b in batches:
            scores, texts, size = [], [], 0
            for t in b.column(len(rest)):
                texts.append(coded(t.as_py()))
                size += len(texts[-1])
                if size > 100_000:
                    scores.append(model.score(texts))
                    texts, size = [], 0
            scores.append(model.score(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(scores))],
                                             names=[*b.schema.names[:-1], "score"])

    return docs.select(*rest, text).mapInArrow(run, schema)


def threshold(model: Model, lang: Column) -> Column:
    """The calibrated threshold of a row's language."""
    out = F.lit(model.thresholds.get(None, DECISION))
    for name, value in sorted((k, v) for k, v in model.thresholds.items() if k is not None):
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out
