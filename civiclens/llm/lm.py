"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

``P(word | history) = P(class | history) * P(word | class)``.  The ``HEAD`` most
frequent words and the end mark are classes of their own; every other word's
class is a hash of its last two bytes.  The class softmax sums weights of hashed
features of the history: the last word, the last two (n-grams), the word
before the last and the one before that (skips).  Inside a class words have
their discounted training share; what the discount frees is spread over as many
unseen words as the class has words seen once.

Training.  Word counts come from every training text, merged map-side.  Then
come ``ROUNDS`` rounds of gradient updates, each on its own share of the
training texts: every task starts from the same weights, takes row-wise
adaptive gradient steps over its texts, and the tasks' weights are averaged by
how many tokens touched each row, in a tree of bounded fan-in.  The model's size is
fixed by its parameters; the counts stay a distributed table.

Scoring runs over whole texts in sparse numpy batches.  The ``KNOWN`` most frequent
words travel with the model; counts of all others are joined by word.

Defined cases: a null text is empty and has its end mark only; a null id counts
as the empty text and so as training; repeated rows are scored and counted as many
texts; without training texts every class is as likely as any other; extra columns
are left out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiclens.llm.common import positional, renamed, saved

#: Stands for a text's end; no word holds white space.
END = b"\n"
#: Words with classes of their own (the end mark included), classes by ending,
#: words that travel with the model and their greatest length in bytes.
HEAD = 24
ENDINGS = 24
KNOWN = 1 << 16
KNOWN_BYTES = 64
#: Feature templates, hash buckets of each, rounds of updates, step size, tokens of one step.
TEMPLATES = 4
BUCKETS = 1 << 12
ROUNDS = 2
RATE = 1.0
STEP = 4096
#: Distinct words a worker counts before it hands them on; weight rows in one
#: row of the merge; tables merged at a time.
COUNT_FLUSH = 300_000
MERGE_ROWS = 256
FAN_IN = 64
CLASSES = HEAD + ENDINGS


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end mark."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of the one text column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
                if len(seen) > COUNT_FLUSH:
                    yield flush(seen)
                    seen = Counter()
        yield flush(seen)

    def flush(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                          names=["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def ending_of(word: Column) -> Column:
    return (F.crc32(F.substring(word, -2, 2)) % ENDINGS).cast("int")


@dataclass
class Model:
    total: int = 0
    distinct: int = 0
    ids: dict[bytes, int] = field(default_factory=dict)  # known word -> number; head words first
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # by number, then by ending
    inside: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 P(word | class) of known words
    base: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 add-one share of known words
    ending_mass: list[float] = field(default_factory=list)
    ending_discount: list[float] = field(default_factory=list)
    ending_unseen: list[float] = field(default_factory=list)  # log10 P(an unseen word | class)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((TEMPLATES, BUCKETS, CLASSES), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.full(CLASSES, -math.log(CLASSES), np.float32))

    def numbers(self, found: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Symbols of tokens (known words, else their ending) and the tokens that
        are not known."""
        ids = list(map(self.ids.get, found))
        rare: list[bytes] = []
        if None in ids:
            known = len(self.ids)
            for at, i in enumerate(ids):
                if i is None:
                    rare.append(found[at])
                    ids[at] = known + ending(found[at])
        return np.array(ids, np.int64), rare

    def features(self, symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Class of every token and its feature buckets (template by token)."""
        start = np.full(3, len(self.ids) + ENDINGS, np.int64)
        joined = np.concatenate([x for s in symbols for x in (start, s)]).astype(np.uint32)
        place = np.ones(len(joined), bool)
        heads = np.cumsum([0, *[len(s) + 3 for s in symbols[:-1]]])
        place[(heads[:, None] + np.arange(3)).ravel()] = False
        at = np.nonzero(place)[0]
        one, two, three = joined[at - 1], joined[at - 2], joined[at - 3]
        mixed = (one * np.uint32(0x9E3779B1), (one * np.uint32(0x85EBCA6B) + two) * np.uint32(0xC2B2AE35),
                 two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1))
        shift = np.uint32(32 - BUCKETS.bit_length() + 1)
        return self.classes[joined[at].astype(np.int64)], np.stack([m >> shift for m in mixed]).astype(np.uint16)

    def _sums(self, buckets: np.ndarray) -> np.ndarray:
        """Weights of each token's features by class."""
        z = self.weights[0].take(buckets[0], axis=0)
        for t in range(1, TEMPLATES):
            z += self.weights[t].take(buckets[t], axis=0)
        z += self.bias
        return z

    def _powers(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
        """Powers of e, their sums, and what was taken off ``z`` first: nothing,
        or each token's greatest where a power would leave the range."""
        with np.errstate(over="ignore", under="ignore"):
            powers = np.exp(z)
            total = powers @ np.ones(CLASSES, np.float32)
        if np.isfinite(total).all() and total.min(initial=1) > 1e-30:
            return powers, total, 0.0
        most = z.max(axis=1)
        powers = np.exp(z - most[:, None])
        return powers, powers.sum(axis=1), most

    def shares(self, buckets: np.ndarray) -> np.ndarray:
        """The class softmax, token by class."""
        powers, total, _ = self._powers(self._sums(buckets))
        powers /= total[:, None]
        return powers

    def log_class(self, buckets: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Natural log of each token's own class' share."""
        z = self._sums(buckets)
        _, total, off = self._powers(z)
        return z[np.arange(len(z)), classes] - off - np.log(total)


def known_words(counts: DataFrame) -> DataFrame:
    """The most frequent words, whole classes of equal count, at most KNOWN of
    them; and the end mark.  The least count follows from the number of words
    of each count, so no task sends more than its share of the result."""
    short = counts.filter(F.octet_length("word") <= KNOWN_BYTES)
    sizes = short.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("c")))
    least = sizes.select("c", upto.alias("upto")).filter(F.col("upto") <= KNOWN).agg(F.min("c")).first()[0]
    frequent = F.lit(False) if least is None else F.col("c") >= least
    return short.filter(frequent | (F.col("word") == F.lit(bytearray(END))))


def start_model(counts: DataFrame) -> Model:
    """Word tables and class shares from the counts."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    if not total:
        return Model(classes=np.arange(HEAD, CLASSES, dtype=np.int32), ending_mass=[0.0] * ENDINGS,
                     ending_discount=[0.0] * ENDINGS, ending_unseen=[0.0] * ENDINGS)
    top = known_words(counts).collect()
    order = sorted(((bytes(r["word"]), r["c"]) for r in top), key=lambda x: (x[0] != END, -x[1], x[0]))
    head = {w for w, _ in order[:HEAD]}
    by_class = (counts.filter(~F.col("word").isin([bytearray(w) for w in head])).groupBy(ending_of(F.col("word")).alias("g"))
                .agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("n1"),
                     F.count_if(F.col("c") == 2).alias("n2")).collect())
    m = Model(total, distinct, {w: i for i, (w, _) in enumerate(order)})
    floor = -math.log10(total + distinct + 1)
    m.ending_mass, m.ending_discount, m.ending_unseen = [0.0] * ENDINGS, [0.0] * ENDINGS, [floor] * ENDINGS
    for r in by_class:
        share = min(max(r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] else 0.0, 0.1), 0.9)
        m.ending_mass[r["g"]], m.ending_discount[r["g"]] = float(r["m"]), share
        m.ending_unseen[r["g"]] = math.log10(share * r["v"] / r["m"] / max(r["n1"], 1))
    endings = [ending(w) for w, _ in order]
    m.classes = np.array([i if i < HEAD else HEAD + g for i, g in enumerate(endings)] + list(range(HEAD, CLASSES)), np.int32)
    m.inside = np.array([0.0 if i < HEAD else math.log10((c - m.ending_discount[g]) / m.ending_mass[g])
                         for i, ((_, c), g) in enumerate(zip(order, endings, strict=True))])
    m.base = np.array([math.log10((c + 1) / (total + distinct + 1)) for _, c in order])
    share = np.ones(CLASSES)
    for i, (_, c) in enumerate(order[:HEAD]):
        share[i] += c
    share[HEAD:] += m.ending_mass
    m.bias = np.log(share / share.sum()).astype(np.float32)
    return m


def _batched(batches: Iterator[pa.RecordBatch], column: int, size: int):
    """Rows' texts as token lists, in groups of about ``size`` tokens."""
    group, n = [], 0
    for batch in batches:
        for row, text in enumerate(batch.column(column)):
            found = tokens(text.as_py())
            group.append((batch, row, found))
            n += len(found)
            if n >= size:
                yield group
                group, n = [], 0
    if group:
        yield group


def sum_runs(rows: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``np.add.reduceat(rows[order], first, axis=0)``, the same number for
    number.  That calls a loop per run and column, and most runs have few rows:
    those of up to 8 are added whole, row by row, all runs of a length together."""
    length = np.diff(first, append=len(order))
    total = rows.take(order[first], axis=0)
    short = np.flatnonzero((length > 1) & (length <= 8))
    if len(short):
        short = short[np.argsort(-length[short], kind="stable")]
        left, at = length[short], first[short]
        rest = rows.take(order[at + 1], axis=0)
        for k in range(2, int(left[0])):
            n = np.count_nonzero(left > k)
            rest[:n] += rows.take(order[at[:n] + k], axis=0)
        total[short] += rest
    long = np.flatnonzero(length > 8)
    if len(long):
        runs = length[long]
        starts = np.cumsum(runs) - runs
        at = np.repeat(first[long] - starts, runs) + np.arange(runs.sum())
        total[long] = np.add.reduceat(rows.take(order[at], axis=0), starts, axis=0)
    return total


def step(w: np.ndarray, bias: np.ndarray, seen: np.ndarray, squares: np.ndarray, bias_squares: np.ndarray,
         model: Model, classes: np.ndarray, buckets: np.ndarray) -> None:
    """One gradient update, in place, from one group of tokens."""
    model.weights, model.bias = w, bias
    g = model.shares(buckets)
    g[np.arange(len(classes)), classes] -= 1
    for t in range(TEMPLATES):
        order = np.argsort(buckets[t], kind="stable")
        ordered = buckets[t][order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        rows = ordered[first]
        total = sum_runs(g, order, first)
        squares[t, rows] += (total * total).max(axis=1)
        w[t, rows] -= (RATE / np.sqrt(squares[t, rows] + 1e-2))[:, None] * total
        seen[t, rows] += np.diff(first, append=len(order))
    total = g.sum(axis=0)
    bias_squares += total * total
    bias -= 0.1 * RATE / np.sqrt(bias_squares + 1) * total


_TABLE = "block int, worker int, seen binary, w binary"


def update(texts: DataFrame, model: Model) -> Model:
    """One round: every task updates a copy of the weights on its own texts."""
    blocks = TEMPLATES * BUCKETS // MERGE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        w, bias = model.weights.copy(), model.bias.copy()
        start_w, start_bias = model.weights, model.bias
        seen, squares = np.zeros(w.shape[:2], np.int64), np.zeros(w.shape[:2], np.float32)
        bias_squares, n = np.zeros_like(bias), 0
        for group in _batched(batches, 0, STEP):
            classes, buckets = model.features([model.numbers(found)[0] for _, _, found in group])
            for at in range(0, len(classes), 2 * STEP):
                part = slice(at, at + 2 * STEP)
                step(w, bias, seen, squares, bias_squares, model, classes[part], buckets[:, part])
            n += len(classes)
        model.weights, model.bias = start_w, start_bias
        if n:
            flat, counts = w.reshape(blocks, -1), seen.reshape(blocks, -1)
            extra = np.array([n], np.int64)
            rows = [(b, counts[b].tobytes(), flat[b].tobytes()) for b in range(blocks) if counts[b].any()]
            rows.append((blocks, extra.tobytes(), bias.tobytes()))
            worker = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([worker] * len(rows), pa.int32()),
                 pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                names=["block", "worker", "seen", "w"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        seen = [np.frombuffer(x, np.int64) for x in group["seen"]]
        total = np.sum(seen, axis=0)
        shape = (len(total), CLASSES)
        mean = np.zeros(shape)
        for s, x in zip(seen, group["w"], strict=True):
            mean += np.frombuffer(x, np.float32).reshape(shape) * s[:, None]
        mean /= np.maximum(total, 1)[:, None]
        return pd.DataFrame({"block": group["block"].iloc[:1], "worker": group["worker"].iloc[:1],
                             "seen": [total.tobytes()], "w": [mean.astype(np.float32).tobytes()]})

    width = texts.rdd.getNumPartitions()
    tables = texts.mapInArrow(run, _TABLE)
    while width > 1:
        width = -(-width // FAN_IN)
        tables = (tables.withColumn("worker", F.pmod("worker", F.lit(width)).cast("int"))
                  .groupBy("block", "worker").applyInPandas(merge, _TABLE))
    weights, bias = model.weights.reshape(blocks, -1).copy(), model.bias
    for r in tables.collect():  # one row per block: the model's own size
        got = np.frombuffer(bytes(r["w"]), np.float32)
        if r["block"] == blocks:
            bias = got
        else:
            touched = np.repeat(np.frombuffer(bytes(r["seen"]), np.int64) > 0, CLASSES)
            weights[r["block"]][touched] = got[touched]
    model.weights, model.bias = weights.reshape(model.weights.shape), bias.copy()
    return model


def train(texts: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame]:
    """A model and the word counts from training rows."""
    counts = saved(count_words(texts.select(text)))
    model = start_model(counts)
    share = F.pmod(F.xxhash64(F.col(key), F.length(text)), F.lit(ROUNDS))
    if model.total:
        for n in range(ROUNDS):
            model = update(texts.filter(share == n).select(text), model)
    return model, counts


_SCORED = "number long, n_tokens long, top double, base_top double, known long, rare array<struct<word:binary,n:int>>"


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with n_tokens, n_known, base_score
    and score, which replace input columns so named."""
    plain, kept = positional(docs, text)
    return renamed(_scored(plain, model, counts, "text"), kept, "n_tokens", "n_known", "base_score", "score")


def _scored(docs: DataFrame, model: Model, counts: DataFrame, text: str) -> DataFrame:
    kept = [c for c in docs.columns if c != text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 40
        known = len(model.ids)
        inside = np.concatenate([model.inside, np.zeros(ENDINGS)])
        base = np.concatenate([model.base, np.zeros(ENDINGS)])
        for group in _batched(batches, len(kept), 8 * STEP):
            numbered = [model.numbers(found) for _, _, found in group]
            symbols = [s for s, _ in numbered]
            classes, buckets = model.features(symbols)
            logs = np.empty(len(classes))
            for at in range(0, len(classes), STEP):
                part = slice(at, at + STEP)
                logs[part] = model.log_class(buckets[:, part], classes[part])
            joined = np.concatenate(symbols)
            starts = np.cumsum([0, *[len(s) for s in symbols[:-1]]])
            add = lambda x: np.add.reduceat(x, starts)
            rare = [Counter(r) for _, r in numbered]
            ends = np.cumsum([0, *map(len, rare)], dtype=np.int32)
            each = pa.StructArray.from_arrays(
                [pa.array([w for r in rare for w in r], pa.binary()),
                 pa.array([n for r in rare for n in r.values()], pa.int32())], names=["word", "n"])
            origin = [pa.array([b.column(c)[r].as_py() for b, r, _ in group], group[0][0].schema.field(c).type)
                      for c in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*origin, pa.array(np.arange(number, number + len(group))), pa.array([len(s) for s in symbols], pa.int64()),
                 pa.array(add(logs / math.log(10) + inside[joined])), pa.array(add(base[joined])),
                 pa.array(add((joined < known).astype(np.int64))),
                 pa.ListArray.from_arrays(pa.array(ends), each)],
                names=[*kept, "number", "n_tokens", "top", "base_top", "known", "rare"])
            number += len(group)

    schema = f"{fields}, {_SCORED}" if fields else _SCORED
    rows = docs.select(*kept, text).mapInArrow(run, schema)
    # One row per text and rare word; the first, with no word, carries the rest.
    head = F.array(F.struct(F.lit(None).cast("binary").alias("word"), F.lit(0).alias("n")))
    own = F.struct(*kept, "n_tokens", "top", "base_top", "known")
    spread = rows.select("number", own.alias("own"), F.explode(F.concat(head, F.col("rare"))).alias("r"))
    spread = spread.select("number", F.when(F.col("r.word").isNull(), F.col("own")).alias("own"), "r.word", "r.n")
    c = F.coalesce(F.col("c"), F.lit(0))
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), ending_of(F.col("word")) + 1)
    inside = F.when(c > 0, F.log10((c - pick(model.ending_discount)) / pick(model.ending_mass))).otherwise(
        pick(model.ending_unseen))
    share = F.log10((c + 1) / F.lit(float(model.total + model.distinct + 1)))
    table = counts.select(F.col("word").alias("counted"), "c")
    joined = spread.join(table, F.col("word") == F.col("counted"), "left")
    summed = joined.groupBy("number").agg(
        F.max("own").alias("own"), F.sum(F.when(F.col("word").isNotNull(), F.col("n") * inside)).alias("rare"),
        F.sum(F.when(F.col("word").isNotNull(), F.col("n") * share)).alias("base_rare"),
        F.sum(F.when(F.col("word").isNotNull() & (c > 0), F.col("n"))).alias("rare_known"))
    zero = F.lit(0.0)
    return summed.select(
        *[F.col("own").getField(k).alias(k) for k in kept], F.col("own.n_tokens").alias("n_tokens"),
        (F.col("own.known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("own.base_top") + F.coalesce("base_rare", zero)).alias("base_score"),
        (F.col("own.top") + F.coalesce("rare", zero)).alias("score"))
