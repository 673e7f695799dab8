"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's components are terms.  Each block of candidate rows is turned into
postings: per term, the rows that have it and their weights.  A block of sparse
query rows then walks the terms one at a time and scatters weight times weight
into dense score arrays, one row per query.  A partition select keeps the best
k of each array, a task keeps a running best over its blocks, and the tasks'
lists merge by rank.

The queries are a stated set.  Equal query rows are asked once, and the set is
written down in blocks of about ``QUERY_BYTES`` by hash.  Each block is one pass
over the candidates whose lists are merged and written before the next block is
read, so neither the driver nor a task ever holds more than one block, and the
plan of the result is one scan, whatever their number.

Components become ``floor(1024 * x)``.  Scores are exact integers: 64-bit when
the largest possible sum fits, Python integers else (scores past the range of
a long stop at its ends).

Defined cases: vectors null, or with a null or non-finite component, and rows
without an id take no part; a candidate with the query's id is the query's own
row; vectors of unlike length share the terms they both have; repeated query
rows give their list once per row; fewer candidates than k give all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiclens.llm.common import table_path, written

TOP = 10
SCALE = 1024
#: Bytes of the queries of one pass; queries and rows scored at a time.
QUERY_BYTES = 16 << 20
QUERY_BLOCK = 256
ROW_BLOCK = 4096

LISTS = "number long, times long, query_id long, vec_id long, score long"
FOUND = "query_id long, rank int, vec_id long, score long"

Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec as doubles) of the rows that take part."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("vec"))
            .filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & sound))


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as 64-bit integers, or Python integers where too large."""
    if not len(x) or np.abs(x).max() < 2.0 ** 52:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([math.floor(v * SCALE) if abs(v) < 2.0 ** 52 else int(v) * SCALE for v in x.tolist()], object)


def postings(ids: pa.Array, vectors: pa.ListArray) -> Block:
    """ids; and the non-zero weights ordered by term: term, row, weight."""
    ends = vectors.offsets.to_numpy()
    size = np.diff(ends)
    weight = scaled(vectors.flatten().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(size)), size)
    term = np.arange(len(weight)) - np.repeat(ends[:-1] - ends[0], size)
    keep = np.nonzero(weight != 0)[0]
    keep = keep[np.argsort(term[keep], kind="stable")]
    return ids.to_numpy(zero_copy_only=False), term[keep], row[keep], weight[keep]


def by_term(block: Block) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    _, term, row, weight = block
    terms, starts = np.unique(term, return_index=True)
    cuts = [*starts.tolist(), len(term)]
    return {t: (row[a:b], weight[a:b]) for t, a, b in zip(terms.tolist(), cuts, cuts[1:], strict=False)}


def accumulate(queries: Block, rows: Block) -> np.ndarray:
    """Scores of every query (rows) and candidate (columns)."""
    q_lists, r_lists = by_term(queries), by_term(rows)
    shared = [t for t in q_lists if t in r_lists]
    peak = sum(int(abs(q_lists[t][1]).max()) * int(abs(r_lists[t][1]).max()) for t in shared)
    wide = peak >= 2 ** 63
    scores = np.zeros((len(queries[0]), len(rows[0])), object if wide else np.int64)
    for t in shared:
        (q, qw), (r, rw) = q_lists[t], r_lists[t]
        if wide:
            qw, rw = qw.astype(object), rw.astype(object)
        if len(r) == scores.shape[1]:
            for one, w in zip(q.tolist(), qw.tolist(), strict=True):
                scores[one] += w * rw
        else:
            for one, w in zip(q.tolist(), qw.tolist(), strict=True):
                scores[one, r] += w * rw
    return np.clip(scores, -2 ** 63, 2 ** 63 - 1).astype(np.int64) if wide else scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores.astype(object) if (scores == -2 ** 63).any() else -scores))[:k]
    return scores[order], ids[order]


def _whole(column: pa.ChunkedArray) -> pa.Array:
    """A column of at most one chunk as an array."""
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _pass(queries: Block, times: np.ndarray, k: int):
    """Scores a task's candidates against one block of queries, each asked
    ``times`` times."""
    q_ids, term, row, weight = queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        top = [(none, none)] * len(q_ids)
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                block = postings(part.column(0), part.column(1))
                ids = block[0]
                for first in range(0, len(q_ids), QUERY_BLOCK):
                    some = (row >= first) & (row < first + QUERY_BLOCK)
                    asked = q_ids[first:first + QUERY_BLOCK], term[some], row[some] - first, weight[some]
                    for n, line in enumerate(accumulate(asked, block)):
                        other = ids != asked[0][n]
                        had, had_ids = top[first + n]
                        if len(had) == k:
                            other &= line >= had[-1]
                        if other.any():
                            s, i = best(line[other], ids[other], k)
                            top[first + n] = best(np.concatenate([had, s]), np.concatenate([had_ids, i]), k)
        for n, (s, i) in enumerate(top):
            if len(s):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), x)) for x in (n, times[n], q_ids[n])] + [pa.array(i), pa.array(s)],
                    names=["number", "times", "query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, key: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every query row against every
    row of ``vectors``."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    asked = written(usable(queries, key, vector).groupBy("id", "vec").agg(F.count(F.lit(1)).alias("times")))
    size = asked.agg(F.sum(F.size("vec") * 16 + 64)).first()[0] or 0
    passes = max(1, math.ceil(size / QUERY_BYTES))
    path = table_path(spark)
    ranks = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    for n in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("id", "vec"), F.lit(passes)) == n).toArrow().combine_chunks()
        ids, vecs, times = (_whole(part.column(c)) for c in ("id", "vec", "times"))
        lists = rows.mapInArrow(_pass(postings(ids, vecs), times.to_numpy(), k), LISTS)
        (lists.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k)
         .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
         .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
         .write.mode("append").parquet(path))
    return spark.read.schema(FOUND).parquet(path)
