"""Embeddings, centroids, similarity and cluster assignment.

Scoring many vectors against the cluster centroids uses Arrow batches and
numpy (``mapInPandas``) with the centroid table shipped to the tasks: the
table is bounded by the number of clusters (k1 + k1*k2, a parameter), never by
the data; its bytes are checked below, and a larger one is taken in blocks.  Everything else is DataFrame aggregation.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from civiclens.functions.ranking import rnd
from civiclens.functions.text import strip
from civiclens.session import checkpoint_dir

CENTROID_BYTES = 256 << 20  # centroids shipped to tasks at a time; more go in blocks


# ---------------------------------------------------------------- text and vectors
def embedding_text(service_type: str = "service_type", description: str = "description"):
    """``"<type> | <description>"`` of the non-blank parts, trimmed; null if none."""
    parts = [F.nullif(strip(c), F.lit("")) for c in (service_type, description)]
    return F.nullif(strip(F.concat_ws(" | ", *parts)), F.lit(""))


def pending(df: DataFrame, id_col: str = "id", vec: str = "embedding", limit: int | None = None):
    """Rows still lacking a vector; with ``limit`` (a batch size) the first by id."""
    out = df.filter(F.col(vec).isNull())
    return out.orderBy(id_col).limit(limit) if limit else out


def hashing_encoder(df: DataFrame, text_col: str, out_col: str = "embedding",
                    dim: int = 384) -> DataFrame:
    """Default encoder, all JVM-side: tokenize -> HashingTF(dim) -> L2 norm.
    Null text gives a null vector."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    base = df.withColumn("_txt", F.coalesce(F.col(text_col), F.lit("")))
    tok = RegexTokenizer(inputCol="_txt", outputCol="_tok", pattern="[^\\p{L}\\p{N}_]+",
                         toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    nm = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0)
    out = nm.transform(tf.transform(tok.transform(base)))
    vec = F.when(F.col(text_col).isNull(), F.lit(None)).otherwise(
        vector_to_array("_nv", dtype="float32"))
    return out.withColumn(out_col, vec).drop("_txt", "_tok", "_tf", "_nv")


_WORKER_MODELS: dict = {}


def worker_model(name: str, factory: Callable[[], object]):
    """Load a model once per Python worker process and reuse it across
    batches and tasks (call inside ``encode``)."""
    if name not in _WORKER_MODELS:
        _WORKER_MODELS[name] = factory()
    return _WORKER_MODELS[name]


def pandas_encoder(df: DataFrame, text_col: str, encode: Callable[[list[str]], np.ndarray],
                   out_col: str = "embedding") -> DataFrame:
    """Plug-in encoder: ``encode`` (a batch of texts -> 2-D array) runs on
    Arrow batches in the Python workers; load models inside ``encode`` lazily
    so each worker loads once."""
    @F.pandas_udf(ArrayType(FloatType()))
    def _enc(texts: pd.Series) -> pd.Series:
        mask = texts.notna().to_numpy()
        vals = [None] * len(texts)
        if mask.any():
            vecs = np.asarray(encode(texts[mask].tolist()), dtype=np.float32)
            for j, i in enumerate(np.nonzero(mask)[0]):
                vals[i] = vecs[j]
        return pd.Series(vals, dtype=object)
    return df.withColumn(out_col, _enc(F.col(text_col)))


def merge_vectors(target: DataFrame, vectors: DataFrame, id_col: str = "id",
                  vec: str = "embedding") -> DataFrame:
    """Write-back by id: new non-null vectors replace, others keep the old."""
    v = vectors.filter(F.col(vec).isNotNull()).select(id_col, F.col(vec).alias("_new"))
    return (target.join(v, id_col, "left")
                  .withColumn(vec, F.coalesce(F.col("_new"), F.col(vec))).drop("_new"))


# ---------------------------------------------------------------- centroids
def centroids(points: DataFrame, keys: list[str], vec: str = "embedding",
              digits: int | None = 6) -> DataFrame:
    """Mean vector per cluster key: one aggregate whose partial state is a
    vector per cluster, so a hot cluster is combined map-side."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    means = (points.filter(F.col(vec).isNotNull()).select(*keys, array_to_vector(F.col(vec)).alias("_v"))
             .groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m")))
    mean = vector_to_array("_m")
    return means.select(*keys, (F.transform(mean, lambda x: rnd(x, digits)) if digits is not None else mean)
                        .alias("centroid"))


def cluster_sizes(points: DataFrame, top: str = "top_cluster_id", sub: str = "sub_cluster_id",
                  k1: int | None = None, k2: int | None = None,
                  vec: str | None = None) -> DataFrame:
    """Cluster table rows: level 1 per top id, level 2 per (top, sub); with
    ``k1``/``k2`` every id in range appears as well, size 0 when empty (ids
    beyond the range keep their rows).  With ``vec``
    each row also carries its centroid (null for an empty cluster)."""
    if vec is not None:
        base = cluster_sizes(points, top, sub, k1, k2)
        c1 = centroids(points, [top]).select(F.col(top).cast("int").alias("cluster_id"),
                                             F.lit(1).alias("level"), "centroid")
        c2 = centroids(points, [top, sub]).select(F.col(sub).cast("int").alias("cluster_id"),
                                                  F.col(top).cast("int").alias("parent_cluster_id"),
                                                  F.lit(2).alias("level"), "centroid")
        l1 = base.filter(F.col("level") == 1).join(c1, ["cluster_id", "level"], "left")
        l2 = base.filter(F.col("level") == 2).join(c2, ["cluster_id", "parent_cluster_id", "level"], "left")
        return l1.unionByName(l2)
    l1 = points.groupBy(F.col(top).alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"))
    l2 = points.groupBy(F.col(top).alias("parent_cluster_id"), F.col(sub).alias("cluster_id")) \
               .agg(F.count(F.lit(1)).alias("size"))
    if k1 is not None:
        spark = points.sparkSession
        ids1 = spark.range(k1).select(F.col("id").cast("int").alias("cluster_id"))
        l1 = ids1.join(l1, "cluster_id", "full").na.fill(0, ["size"])
        if k2 is not None:
            ids2 = spark.range(k1 * k2).select(
                (F.col("id") / k2).cast("int").alias("parent_cluster_id"),
                (F.col("id") % k2).cast("int").alias("cluster_id"))
            l2 = ids2.join(l2, ["parent_cluster_id", "cluster_id"], "full").na.fill(0, ["size"])
    return (l1.select(F.col("cluster_id").cast("int"), F.lit(None).cast("int").alias("parent_cluster_id"),
                      F.lit(1).alias("level"), "size")
              .unionByName(l2.select(F.col("cluster_id").cast("int"),
                                     F.col("parent_cluster_id").cast("int"),
                                     F.lit(2).alias("level"), "size")))


def cluster_stats(clusters: DataFrame, digits: int = 6) -> DataFrame:
    """Totals and per-level average / min / max size of the cluster table."""
    s = F.col("size")
    l1, l2 = F.col("level") == 1, F.col("level") == 2
    return clusters.agg(
        F.count(F.lit(1)).alias("total_clusters"),
        F.count_if(l1).alias("level1_clusters"), F.count_if(l2).alias("level2_clusters"),
        rnd(F.avg(F.when(l1, s)), digits).alias("level1_avg_size"),
        F.min(F.when(l1, s)).alias("level1_min_size"), F.max(F.when(l1, s)).alias("level1_max_size"),
        rnd(F.avg(F.when(l2, s)), digits).alias("level2_avg_size"),
        F.min(F.when(l2, s)).alias("level2_min_size"), F.max(F.when(l2, s)).alias("level2_max_size"))


def level1_ids(clusters: DataFrame, limit: int = 25) -> DataFrame:
    """First ``limit`` level-1 cluster ids ascending (a small report)."""
    return (clusters.filter(F.col("level") == 1).select("cluster_id").distinct()
                    .orderBy("cluster_id").limit(limit))


# ---------------------------------------------------------------- similarity
def _table_bytes(df: DataFrame) -> int:
    width = F.size("centroid") if "centroid" in df.columns else F.lit(0)
    return df.select(F.sum(width.cast("long") * 8 + 32)).first()[0] or 0


def _rows_within_bound(*tables: DataFrame):
    """Rows of the cluster tables, or None when they exceed ``CENTROID_BYTES``
    together (their size is checked before any row is read).  Each is computed
    once, for its size and its rows."""
    tables = [staged(t) for t in tables]
    if sum(_table_bytes(t) for t in tables) > CENTROID_BYTES:
        return None
    return [t.collect() for t in tables]


def _matrix(vectors) -> tuple[np.ndarray, np.ndarray]:
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    if m.ndim == 1:
        m = m.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))
    n = np.linalg.norm(m, axis=1) if len(m) else np.zeros(0)
    return m, n


def _cos_batch(q: np.ndarray, qn: np.ndarray, m: np.ndarray, mn: np.ndarray) -> np.ndarray:
    if m.shape[0] == 0:
        return np.zeros((q.shape[0], 0))
    d = q @ m.T
    den = np.outer(qn, mn)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(den == 0, 0.0, d / np.where(den == 0, 1.0, den))
    return s


def _queries(pdf: pd.DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ok = pdf[vec].notna().to_numpy()
    if ok.any():
        q = np.stack([np.asarray(v, dtype=np.float64) for v in pdf.loc[ok, vec]])
    else:
        q = np.zeros((0, 1))
    return ok, q, np.linalg.norm(q, axis=1) if len(q) else np.zeros(0)


# Centroid tables beyond the bound: blocks of centroids against all queries.
def staged(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read back."""
    spark = df.sparkSession
    path = _new_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _new_folder(spark) -> str:
    return os.path.join(checkpoint_dir(spark), "civiclens", "blocks", uuid.uuid4().hex)


def _numbered(queries: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(_row, id, _vec): written down, so that every pass sees the same rows under
    the same numbers, repeated ids too."""
    return staged(queries.select(F.monotonically_increasing_id().alias("_row"), id_col, F.col(vec).alias("_vec")))


def _scored(numbered: DataFrame, cents: DataFrame, cid: str, pick: Callable) -> DataFrame:
    """(_row, cid, _s): what ``pick`` takes of every block of centroids for every
    query row.

    Blocks hold about ``CENTROID_BYTES``, split by a hash of the vector, so equal
    centroids are scored by the same product and tie exactly.  A pass is written
    before the next block is read: the driver holds one block at a time.
    """
    spark = numbered.sparkSession
    cents = staged(cents.filter(F.col("centroid").isNotNull()))
    n = max(1, math.ceil(_table_bytes(cents) / CENTROID_BYTES))
    schema, path = f"_row long, {cid} long, _s double", _new_folder(spark)
    for i in range(n):
        block = cents.filter(F.pmod(F.xxhash64("centroid"), F.lit(n)) == i).collect()
        if block or i == 0:
            numbered.mapInPandas(_block_pass(sorted(block, key=lambda r: tuple(r)[:-1]), cid, pick),
                                 schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _block_pass(block, cid: str, pick: Callable):
    ids = np.asarray([r[cid] for r in block], dtype=np.int64)
    parents = np.asarray([r["parent_cluster_id"] for r in block]) if block and "parent_cluster_id" in block[0] else None
    m, mn = _matrix([r["centroid"] for r in block])

    def run(it):
        for pdf in it:
            ok, q, qn = _queries(pdf, "_vec")
            if not len(ids) or not ok.any():
                continue
            at = pdf["_row"].to_numpy()[ok]
            if parents is None:
                groups = [(slice(None), slice(None))]
            else:
                mine = pdf["_parent"].to_numpy()[ok]
                groups = [(np.nonzero(mine == p)[0], np.nonzero(parents == p)[0])
                          for p in np.intersect1d(mine, parents)]
            for rows, cols in groups:
                s = _cos_batch(q[rows], qn[rows], m[cols], mn[cols])
                n, j = pick(s)
                yield pd.DataFrame({"_row": at[rows][n], cid: ids[cols][j], "_s": s[n, j]})
    return run


def _all_of_block(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every query (row) with every centroid (column)."""
    return np.repeat(np.arange(s.shape[0]), s.shape[1]), np.tile(np.arange(s.shape[1]), s.shape[0])


def _first_of_block(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each query's highest centroid, the first of equals."""
    return np.arange(s.shape[0]), np.argmax(s, axis=1)


def _best(numbered: DataFrame, cents: DataFrame, cid: str) -> DataFrame:
    """(_row, cid, _s): the highest similarity over all blocks, ties to the smaller
    id; with ``parent_cluster_id`` in ``cents`` only those of the row's ``_parent``."""
    first = F.max_by(F.struct(cid, "_s"), F.struct("_s", -F.col(cid)))
    return _scored(numbered, cents, cid, _first_of_block).groupBy("_row").agg(first.alias("b")).select("_row", "b.*")


def _assign_blocks(queries: DataFrame, top_cents: DataFrame, sub_cents: DataFrame, sizes: DataFrame,
                   id_col: str, vec: str, digits: int) -> DataFrame:
    """``assign`` with centroid tables of any size: best parent of all, best parent
    with a candidate child, best child of that parent, each over blocks."""
    pair = ["parent_cluster_id", "cluster_id"]
    full = sizes.filter(F.col("size") > 0).select(*pair).distinct()
    tops = top_cents.select("cluster_id", "centroid")
    parent_ids = tops.select(F.col("cluster_id").alias("parent_cluster_id"))
    cand = (sub_cents.select(*pair, "centroid").join(full, pair, "left_semi")
            .join(parent_ids, "parent_cluster_id", "left_semi"))
    childless = (parent_ids.join(sub_cents, "parent_cluster_id", "left_anti")
                 .join(full.filter("cluster_id = 0"), "parent_cluster_id", "left_semi").distinct())
    numbered = _numbered(queries, id_col, vec)
    ids = numbered.select("_row", id_col)
    special = (_best(numbered, tops, "cluster_id").withColumnRenamed("cluster_id", "parent_cluster_id")
               .join(childless, "parent_cluster_id", "left_semi"))
    special = special.select("_row", "parent_cluster_id", F.lit(0).cast("long").alias("child_cluster_id"),
                             F.col("_s").alias("ps"), F.lit(0.0).alias("cs"))
    having = tops.join(cand.select(F.col("parent_cluster_id").alias("cluster_id")), "cluster_id", "left_semi")
    parent = _best(numbered, having, "cluster_id").select("_row", F.col("cluster_id").alias("_parent"), F.col("_s").alias("ps"))
    others = staged(numbered.join(special, "_row", "left_anti").join(parent, "_row"))
    child = _best(others, cand, "cluster_id").select("_row", F.col("cluster_id").alias("child_cluster_id"), F.col("_s").alias("cs"))
    found = others.join(child, "_row").select("_row", F.col("_parent").alias("parent_cluster_id"), "child_cluster_id", "ps", "cs")
    return (special.unionByName(found).join(ids, "_row")
            .select(id_col, "parent_cluster_id", "child_cluster_id", F.bround("ps", digits).alias("parent_similarity"),
                    F.bround("cs", digits).alias("child_similarity")))


def nearest(queries: DataFrame, cents: DataFrame, id_col: str = "query_id", vec: str = "embedding",
            cid: str = "cluster_id", digits: int = 6) -> DataFrame:
    """Best centroid per query: highest cosine, lowest id on ties (ids are
    scanned ascending and only a strictly greater similarity replaces)."""
    within = _rows_within_bound(cents.select(cid, "centroid"))
    if within is None:
        numbered = _numbered(queries, id_col, vec)
        return (numbered.select("_row", id_col).join(_best(numbered, cents.select(cid, "centroid"), cid), "_row", "left")
                .select(id_col, cid, F.bround("_s", digits).alias("similarity")))
    rows = sorted(within[0], key=lambda r: r[0])
    ids = np.asarray([r[0] for r in rows])
    m, mn = _matrix([r[1] for r in rows])

    def run(it):
        for pdf in it:
            ok, q, qn = _queries(pdf, vec)
            best = np.full(len(pdf), None, dtype=object)
            sim = np.full(len(pdf), np.nan)
            if len(ids) and ok.any():
                s = _cos_batch(q, qn, m, mn)
                j = np.argmax(s, axis=1)  # first maximum = lowest id
                best[ok] = ids[j]
                sim[ok] = s[np.arange(len(j)), j]
            yield pd.DataFrame({id_col: pdf[id_col], cid: pd.array(best, dtype="Int64"),
                                "similarity": np.round(sim, digits)})
    schema = f"{id_col} long, {cid} long, similarity double"
    return queries.select(id_col, vec).mapInPandas(run, schema)


def ranked(queries: DataFrame, cents: DataFrame, id_col: str = "query_id", vec: str = "embedding",
           cid: str = "cluster_id", exclude: tuple = (), digits: int = 6) -> DataFrame:
    """Every centroid per query by similarity desc (id asc on ties), minus
    ``exclude``; the per-query list is bounded by the number of clusters."""
    if exclude:
        cents = cents.filter(~F.col(cid).isin(*exclude))
    within = _rows_within_bound(cents.select(cid, "centroid"))
    if within is None:
        numbered = _numbered(queries, id_col, vec)
        order = Window.partitionBy("_row").orderBy(F.desc("_s"), cid)
        return (_scored(numbered, cents.select(cid, "centroid"), cid, _all_of_block)
                .withColumn("rank", F.row_number().over(order).cast("long"))
                .join(numbered.select("_row", id_col), "_row")
                .select(id_col, cid, F.bround("_s", digits).alias("similarity"), "rank"))
    rows = sorted(within[0], key=lambda r: r[0])
    ids = np.asarray([r[0] for r in rows])
    m, mn = _matrix([r[1] for r in rows])

    def run(it):
        for pdf in it:
            ok, q, qn = _queries(pdf, vec)
            qids = pdf[id_col].to_numpy()[ok]
            s = _cos_batch(q, qn, m, mn)
            k = len(ids)
            # ids are ascending, so a stable sort on -similarity breaks ties
            # by the lower id
            order = np.argsort(-s, axis=1, kind="stable") if k else np.zeros((len(qids), 0), int)
            yield pd.DataFrame({id_col: np.repeat(qids, k).astype(np.int64),
                                cid: ids[order].reshape(-1).astype(np.int64) if k else np.zeros(0, np.int64),
                                "similarity": np.round(np.take_along_axis(s, order, 1).reshape(-1), digits),
                                "rank": np.tile(np.arange(1, k + 1), len(qids)).astype(np.int64)})
    schema = f"{id_col} long, {cid} long, similarity double, rank long"
    return queries.select(id_col, vec).mapInPandas(run, schema)


def assign(queries: DataFrame, top_cents: DataFrame, sub_cents: DataFrame, sizes: DataFrame,
           id_col: str = "query_id", vec: str = "embedding", digits: int = 6) -> DataFrame:
    """Parent, then child with the non-empty fallback, for a batch of queries.

    Set form of the sequential search: among (parent, child) pairs that have
    a centroid and at least one member, take the first by (parent similarity
    desc, parent id, child similarity desc, child id).  When the best parent
    has no child centroids at all, (best parent, 0) with child similarity 0.0
    wins if that pair has members.  No candidate -> no row.

    ``top_cents`` (cluster_id, centroid), ``sub_cents`` (parent_cluster_id,
    cluster_id, centroid), ``sizes`` (parent_cluster_id, cluster_id, size):
    all bounded by the cluster count; beyond ``CENTROID_BYTES`` they are taken
    in blocks (``_assign_blocks``).
    """
    within = _rows_within_bound(top_cents.select("cluster_id", "centroid"),
                                sub_cents.select("parent_cluster_id", "cluster_id", "centroid"),
                                sizes.filter(F.col("size") > 0).select("parent_cluster_id", "cluster_id"))
    if within is None:
        return _assign_blocks(queries, top_cents, sub_cents, sizes, id_col, vec, digits)
    tops = sorted(within[0], key=lambda r: r[0])
    subs = sorted(within[1], key=lambda r: (r[0], r[1]))
    nonempty = {(r[0], r[1]) for r in within[2]}
    t_ids = np.asarray([r[0] for r in tops])
    tm, tn = _matrix([r[1] for r in tops])
    s_par = np.asarray([r[0] for r in subs])
    s_ids = np.asarray([r[1] for r in subs])
    sm, sn = _matrix([r[2] for r in subs])
    has_children = set(s_par.tolist())
    cand = np.asarray([(p, c) in nonempty for p, c in zip(s_par.tolist(), s_ids.tolist())], dtype=bool)
    par_index = {p: i for i, p in enumerate(t_ids.tolist())}
    cand_par_pos = np.asarray([par_index.get(p, -1) for p in s_par.tolist()])
    cand &= cand_par_pos >= 0

    # Parent position of every sub-centroid, and per parent whether it has
    # any candidate pair; all per-query work below is array arithmetic.
    n_par = len(t_ids)
    children = {p: np.nonzero(cand & (cand_par_pos == p))[0] for p in np.unique(cand_par_pos[cand])}
    par_has_cand = np.zeros(n_par, dtype=bool)
    par_has_cand[list(children)] = True
    special_ok = np.asarray([(p not in has_children) and ((p, 0) in nonempty) for p in t_ids.tolist()],
                            dtype=bool)

    def run(it):
        for pdf in it:
            ok, q, qn = _queries(pdf, vec)
            qids = pdf[id_col].to_numpy()[ok]
            empty = pd.DataFrame({id_col: np.zeros(0, np.int64), "parent_cluster_id": np.zeros(0, np.int64),
                                  "child_cluster_id": np.zeros(0, np.int64),
                                  "parent_similarity": np.zeros(0), "child_similarity": np.zeros(0)})
            if not n_par or not len(qids):
                yield empty
                continue
            ts = _cos_batch(q, qn, tm, tn)                      # queries x parents
            rows = np.arange(len(qids))
            best = np.argmax(ts, axis=1)                        # first max = lowest id
            special = special_ok[best]
            # best parent among those with a candidate pair (ties -> lowest id)
            masked = np.where(par_has_cand[None, :], ts, -np.inf)
            bp = np.argmax(masked, axis=1)
            found = par_has_cand[bp]
            # best candidate child of that parent alone (ties -> lowest child
            # id; sub-centroids are sorted by (parent, child))
            child, csim = np.zeros(len(qids), np.int64), np.zeros(len(qids))
            for p in np.unique(bp[found]):
                mine, kids = np.nonzero(found & (bp == p))[0], children[p]
                cs = _cos_batch(q[mine], qn[mine], sm[kids], sn[kids])
                j = np.argmax(cs, axis=1)
                child[mine], csim[mine] = s_ids[kids][j], cs[np.arange(len(mine)), j]
            keep = special | found
            par = np.where(special, t_ids[best], t_ids[bp])
            chi = np.where(special, 0, child)
            psim = np.where(special, ts[rows, best], ts[rows, bp])
            csim = np.where(special, 0.0, csim)
            yield pd.DataFrame({id_col: qids[keep].astype(np.int64),
                                "parent_cluster_id": np.asarray(par)[keep].astype(np.int64),
                                "child_cluster_id": np.asarray(chi)[keep].astype(np.int64),
                                "parent_similarity": np.round(psim[keep], digits),
                                "child_similarity": np.round(np.asarray(csim, dtype=float)[keep], digits)})
    schema = (f"{id_col} long, parent_cluster_id long, child_cluster_id long, "
              "parent_similarity double, child_similarity double")
    return queries.select(id_col, vec).mapInPandas(run, schema)


def low_confidence(assigned: DataFrame, threshold: float = 0.15) -> DataFrame:
    return assigned.withColumn("low_confidence", F.col("child_similarity") < F.lit(threshold))


def with_labels(assigned: DataFrame, clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """Parent and child labels (blank -> null) and the pair's record count.
    The cluster table is bounded by the cluster count: broadcast."""
    lab = lambda: F.nullif(strip("label"), F.lit(""))
    l1 = clusters.filter(F.col("level") == 1).select(F.col("cluster_id").alias("parent_cluster_id"),
                                                      lab().alias("parent_label"))
    l2 = clusters.filter(F.col("level") == 2).select(
        "parent_cluster_id", F.col("cluster_id").alias("child_cluster_id"), lab().alias("child_label"))
    sz = sizes.select("parent_cluster_id", F.col("cluster_id").alias("child_cluster_id"),
                      F.col("size").alias("record_count"))
    out = assigned.join(F.broadcast(l1), "parent_cluster_id", "left")
    out = out.join(F.broadcast(l2), ["parent_cluster_id", "child_cluster_id"], "left")
    return out.join(F.broadcast(sz), ["parent_cluster_id", "child_cluster_id"], "left").na.fill(
        0, ["record_count"])
