"""Registered vector / centroid / similarity / clustering queries.

Cluster points come from ``embeddings``: top cluster = label, sub cluster =
vec_id mod 3 (the stand-in for stored assignments), text from ``documents``.
Vectors are presented in long form (one row per dimension) so both engines
compare plain doubles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from civiclens.functions.vectors import cosine, parse_vector
from civiclens.operators import clusters as K
from civiclens.operators import layout as N
from civiclens.operators import sampling as S
from civiclens.operators import vectors as V
from civiclens.operators.labels import CLUSTER_KEYS
from civiclens.plans.registry import register
from civiclens.session import configure
from civiclens.sources import files
from civiclens.sources.store import VersionedTable
from civiclens.sources.tables import read_table


def points(spark, sf_dir):
    configure(spark)
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding",
                    F.col("label").cast("int").alias("top_cluster_id"),
                    F.pmod(F.col("vec_id"), F.lit(3)).cast("int").alias("sub_cluster_id"))


def top_centroids(pts):
    return V.centroids(pts, ["top_cluster_id"]).withColumnRenamed("top_cluster_id", "cluster_id")


def sub_centroids(pts):
    return V.centroids(pts, ["top_cluster_id", "sub_cluster_id"]).select(
        F.col("top_cluster_id").alias("parent_cluster_id"),
        F.col("sub_cluster_id").alias("cluster_id"), "centroid")


def pair_sizes(pts):
    return pts.groupBy(F.col("top_cluster_id").alias("parent_cluster_id"),
                       F.col("sub_cluster_id").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"))


def long_form(df, keys, vec="centroid"):
    return df.select(*keys, F.posexplode(vec).alias("dim", "value")).withColumn(
        "dim", F.col("dim").cast("long")).withColumn("value", F.col("value").cast("double"))


_PTS = """
WITH pts AS (SELECT vec_id AS id, embedding, label AS top_cluster_id,
                    CAST(vec_id % 3 AS INTEGER) AS sub_cluster_id FROM embeddings),
ex AS (SELECT id, top_cluster_id, sub_cluster_id,
              unnest(generate_series(0, len(embedding) - 1)) AS dim, unnest(embedding) AS v FROM pts),
c1 AS (SELECT top_cluster_id AS cluster_id, dim, round_even(avg(CAST(v AS DOUBLE)), 6) AS value
       FROM ex GROUP BY 1, 2),
c2 AS (SELECT top_cluster_id AS parent_cluster_id, sub_cluster_id AS cluster_id, dim,
              round_even(avg(CAST(v AS DOUBLE)), 6) AS value FROM ex GROUP BY 1, 2, 3),
c1v AS (SELECT cluster_id, list(value ORDER BY dim) AS centroid FROM c1 GROUP BY 1),
c2v AS (SELECT parent_cluster_id, cluster_id, list(value ORDER BY dim) AS centroid FROM c2 GROUP BY 1, 2),
sizes AS (SELECT top_cluster_id AS parent_cluster_id, sub_cluster_id AS cluster_id, count(*) AS size
          FROM pts GROUP BY 1, 2)"""


_CLUSTERS = _PTS + """,
l1 AS (SELECT cluster_id, CAST(NULL AS INTEGER) AS parent_cluster_id, 1 AS level, count(p.id) AS size
       FROM range(0, 10) r(cluster_id) LEFT JOIN pts p ON p.top_cluster_id = r.cluster_id GROUP BY 1),
l2 AS (SELECT CAST(r.i % 4 AS INTEGER) AS cluster_id, CAST(r.i // 4 AS INTEGER) AS parent_cluster_id,
              2 AS level, count(p.id) AS size
       FROM range(0, 40) r(i) LEFT JOIN pts p
         ON p.top_cluster_id = r.i // 4 AND p.sub_cluster_id = r.i % 4 GROUP BY 1, 2),
cl AS (SELECT CAST(cluster_id AS INTEGER) AS cluster_id, parent_cluster_id, level, size FROM l1
       UNION ALL SELECT * FROM l2)"""


_CLUSTER_ROWS_SQL = _CLUSTERS + """
SELECT cl.level, cl.parent_cluster_id, cl.cluster_id, cl.size,
       coalesce(len(CASE WHEN cl.level = 1 THEN c1v.centroid ELSE c2v.centroid END), -1)::INTEGER AS dims,
       (CASE WHEN cl.level = 1 THEN c1v.centroid ELSE c2v.centroid END)[1] AS first_value
FROM cl LEFT JOIN c1v ON cl.level = 1 AND c1v.cluster_id = cl.cluster_id
LEFT JOIN c2v ON cl.level = 2 AND c2v.cluster_id = cl.cluster_id AND c2v.parent_cluster_id = cl.parent_cluster_id"""


def _cos(a, b):
    a, b = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    na, nb = f"sqrt(list_dot_product({a}, {a}))", f"sqrt(list_dot_product({b}, {b}))"
    return f"(CASE WHEN {na} = 0 OR {nb} = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / ({na} * {nb}) END)"


@register("km_centroid_l1", _PTS + " SELECT cluster_id, CAST(dim AS BIGINT) AS dim, value FROM c1")
def q_centroid_l1(spark, sf_dir):
    return long_form(top_centroids(points(spark, sf_dir)), ["cluster_id"])


@register("km_centroid_l2", _PTS + " SELECT parent_cluster_id, cluster_id, CAST(dim AS BIGINT) AS dim, value FROM c2")
def q_centroid_l2(spark, sf_dir):
    return long_form(sub_centroids(points(spark, sf_dir)), ["parent_cluster_id", "cluster_id"])


@register("km_centroid_parent", _PTS + """
SELECT cluster_id, CAST(dim AS BIGINT) AS dim, value FROM c2 WHERE parent_cluster_id = 1""")
def q_centroid_parent(spark, sf_dir):
    """Sub-cluster centroids of one parent (the operator's argument)."""
    mine = points(spark, sf_dir).filter(F.col("top_cluster_id") == 1)
    return long_form(sub_centroids(mine), ["cluster_id"])


@register("km_rows_centroids", _CLUSTER_ROWS_SQL)
def q_rows_centroids(spark, sf_dir):
    """Cluster rows with their centroids (none for an empty cluster)."""
    rows = V.cluster_sizes(points(spark, sf_dir), k1=10, k2=4, vec="embedding")
    return rows.select("level", "parent_cluster_id", "cluster_id", "size", F.coalesce(F.size("centroid"), F.lit(-1)).alias("dims"),
                       F.get("centroid", F.lit(0)).alias("first_value"))


@register("st_vector_stats", """
SELECT count(*) AS total, count(e.embedding) AS with_embedding, count(e.label) AS with_clusters
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def q_vector_stats(spark, sf_dir):
    """Table totals with the embedded and the clustered rows."""
    from civiclens.operators import ingest as I
    configure(spark)
    d = read_table(spark, sf_dir, "documents", ["doc_id"])
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    rows = d.join(e, d.doc_id == e.vec_id, "left").withColumnRenamed("label", "top_cluster_id")
    return I.request_stats(rows, created=None)


@register("prj_parse_vector", """
SELECT vec_id, CAST(dim - 1 AS BIGINT) AS dim, CAST(v AS DOUBLE) AS value FROM (
  SELECT vec_id, unnest(generate_series(1, len(p))) AS dim, unnest(p) AS v
  FROM (SELECT vec_id, CAST(CAST(embedding AS VARCHAR) AS FLOAT[]) AS p FROM embeddings))""")
def q_parse_vector(spark, sf_dir):
    """Vectors round-tripped through their ``[a, b, ...]`` text form."""
    e = read_table(spark, sf_dir, "embeddings")
    parsed = e.select("vec_id", parse_vector(F.to_json("embedding")).alias("p"))
    return long_form(parsed, ["vec_id"], "p")


@register("sim_cosine", _PTS + f"""
SELECT p.id, p.top_cluster_id, round_even({_cos('p.embedding', 'c.centroid')}, 6) AS cosine
FROM pts p JOIN c1v c ON p.top_cluster_id = c.cluster_id""")
def q_cosine(spark, sf_dir):
    """Each vector against its own top-cluster centroid (an equi-join)."""
    pts = points(spark, sf_dir)
    c = top_centroids(pts).withColumnRenamed("cluster_id", "top_cluster_id")
    return pts.join(c, "top_cluster_id").select(
        "id", "top_cluster_id", F.bround(cosine("embedding", "centroid"), 6).alias("cosine"))


_SIMS = f"""
sims AS (SELECT p.id AS query_id, CAST(c.cluster_id AS BIGINT) AS cluster_id, {_cos('p.embedding', 'c.centroid')} AS s
         FROM pts p, c1v c)"""


@register("sim_nearest", _PTS + "," + _SIMS + """
SELECT query_id, cluster_id, round_even(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cluster_id) AS rk FROM sims)
WHERE rk = 1""")
def q_nearest(spark, sf_dir):
    pts = points(spark, sf_dir)
    return V.nearest(pts.withColumnRenamed("id", "query_id"), top_centroids(pts))


@register("sim_ranked", _PTS + "," + _SIMS + """
SELECT query_id, cluster_id, round_even(s, 6) AS similarity,
       row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cluster_id) AS rank
FROM sims WHERE cluster_id <> 0""")
def q_ranked(spark, sf_dir):
    pts = points(spark, sf_dir)
    return V.ranked(pts.withColumnRenamed("id", "query_id"), top_centroids(pts), exclude=(0,))


@register("jn_centroid_cross", _PTS + "," + _SIMS + """
SELECT query_id, cluster_id, round_even(s, 6) AS similarity,
       row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cluster_id) AS rank FROM sims""")
def q_centroid_cross(spark, sf_dir):
    pts = points(spark, sf_dir)
    return V.ranked(pts.withColumnRenamed("id", "query_id"), top_centroids(pts))


_ASSIGN = _PTS + "," + _SIMS + f""",
bp AS (SELECT query_id, cluster_id AS bp, s AS ps FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cluster_id) AS rk FROM sims)
       WHERE rk = 1),
special AS (SELECT query_id, bp AS parent_cluster_id, 0 AS child_cluster_id, ps, 0.0 AS cs FROM bp
            WHERE bp NOT IN (SELECT parent_cluster_id FROM c2v)
              AND EXISTS (SELECT 1 FROM sizes z WHERE z.parent_cluster_id = bp.bp AND z.cluster_id = 0
                          AND z.size > 0)),
cand AS (SELECT s1.query_id, c2.parent_cluster_id, c2.cluster_id AS child_cluster_id, s1.s AS ps,
                {_cos('p.embedding', 'c2.centroid')} AS cs
         FROM c2v c2 JOIN sizes z ON z.parent_cluster_id = c2.parent_cluster_id AND z.cluster_id = c2.cluster_id
         JOIN sims s1 ON s1.cluster_id = c2.parent_cluster_id
         JOIN pts p ON p.id = s1.query_id
         WHERE z.size > 0),
best AS (SELECT * EXCLUDE (rk) FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id
                                        ORDER BY ps DESC, parent_cluster_id, cs DESC, child_cluster_id) AS rk
           FROM cand) WHERE rk = 1),
pick AS (SELECT * FROM special
         UNION ALL SELECT * FROM best WHERE query_id NOT IN (SELECT query_id FROM special))"""


@register("sim_assign", _ASSIGN + """
SELECT query_id, CAST(parent_cluster_id AS BIGINT) AS parent_cluster_id,
       CAST(child_cluster_id AS BIGINT) AS child_cluster_id,
       round_even(ps, 6) AS parent_similarity, round_even(cs, 6) AS child_similarity FROM pick""")
def q_assign(spark, sf_dir):
    pts = points(spark, sf_dir)
    return V.assign(pts.withColumnRenamed("id", "query_id"), top_centroids(pts), sub_centroids(pts),
                    pair_sizes(pts))


@register("sim_threshold", _ASSIGN + """
SELECT query_id, round_even(cs, 6) AS child_similarity, round_even(cs, 6) < 0.15 AS low_confidence FROM pick""")
def q_threshold(spark, sf_dir):
    pts = points(spark, sf_dir)
    a = V.assign(pts.withColumnRenamed("id", "query_id"), top_centroids(pts), sub_centroids(pts),
                 pair_sizes(pts))
    return V.low_confidence(a).select("query_id", "child_similarity", "low_confidence")


def cluster_table(spark, sf_dir):
    """Cluster rows for k1 = 10 labels x k2 = 4 sub ids (sub id 3 is always
    empty, so sizes of 0 appear as in a real table)."""
    return V.cluster_sizes(points(spark, sf_dir), k1=10, k2=4)


@register("km_sizes", _CLUSTERS + " SELECT * FROM cl")
def q_sizes(spark, sf_dir):
    return cluster_table(spark, sf_dir)


@register("km_stats", _CLUSTERS + """
SELECT count(*) AS total_clusters, count(*) FILTER (WHERE level = 1) AS level1_clusters,
       count(*) FILTER (WHERE level = 2) AS level2_clusters,
       round_even(avg(size) FILTER (WHERE level = 1), 6) AS level1_avg_size,
       min(size) FILTER (WHERE level = 1) AS level1_min_size, max(size) FILTER (WHERE level = 1) AS level1_max_size,
       round_even(avg(size) FILTER (WHERE level = 2), 6) AS level2_avg_size,
       min(size) FILTER (WHERE level = 2) AS level2_min_size, max(size) FILTER (WHERE level = 2) AS level2_max_size
FROM cl""")
def q_stats(spark, sf_dir):
    return V.cluster_stats(cluster_table(spark, sf_dir))


@register("prj_level1_ids", _CLUSTERS + """
SELECT DISTINCT cluster_id FROM cl WHERE level = 1 ORDER BY cluster_id LIMIT 25""")
def q_level1_ids(spark, sf_dir):
    return V.level1_ids(cluster_table(spark, sf_dir), limit=25)


@register("jn_upsert", _CLUSTERS + """,
newer AS (SELECT CAST(top_cluster_id AS INTEGER) AS cluster_id, CAST(NULL AS INTEGER) AS parent_cluster_id,
                 1 AS level, count(*) * 10 AS size FROM pts WHERE top_cluster_id < 5 GROUP BY 1)
SELECT * FROM newer
UNION ALL
SELECT o.* FROM cl o WHERE NOT EXISTS (
  SELECT 1 FROM newer n WHERE n.cluster_id = o.cluster_id AND n.level = o.level
    AND n.parent_cluster_id IS NOT DISTINCT FROM o.parent_cluster_id)""")
def q_upsert(spark, sf_dir):
    """Insert-or-update by (cluster, parent null-safe, level) in a versioned
    table: only the buckets that new rows fall into are written again."""
    pts = points(spark, sf_dir)
    new = (pts.filter(F.col("top_cluster_id") < 5).groupBy(F.col("top_cluster_id").alias("cluster_id"))
              .agg((F.count(F.lit(1)) * 10).alias("size"))
              .select("cluster_id", F.lit(None).cast("int").alias("parent_cluster_id"),
                      F.lit(1).alias("level"), "size"))
    store = stored(cluster_table(spark, sf_dir), "clusters", CLUSTER_KEYS, buckets=8)
    store.upsert(new)
    return store.read()


def stored(df, name, keys, buckets=16):
    """A versioned table of ``df`` in a scratch folder of its own."""
    root = files.scratch_path(df.sparkSession, f"stores/{name}-{uuid.uuid4().hex}")
    return VersionedTable.create(df, root, keys, buckets)


@register("jn_semi_points", _CLUSTERS + """
SELECT id, top_cluster_id, sub_cluster_id FROM pts
WHERE top_cluster_id IN (SELECT cluster_id FROM cl WHERE level = 1 ORDER BY cluster_id LIMIT 25)""")
def q_semi_points(spark, sf_dir):
    pts = points(spark, sf_dir)
    keep = V.level1_ids(cluster_table(spark, sf_dir), limit=25).withColumnRenamed("cluster_id", "top_cluster_id")
    return pts.join(keep, "top_cluster_id", "left_semi").select(
        "id", "top_cluster_id", "sub_cluster_id")


@register("jn_anti_prune", _CLUSTERS + """,
pr AS (SELECT vec_id AS request_id,
                   CASE WHEN vec_id % 7 = 0 THEN NULL ELSE label END AS top_cluster_id FROM embeddings)
SELECT request_id, top_cluster_id FROM pr WHERE top_cluster_id IS NULL
   OR top_cluster_id IN (SELECT cluster_id FROM cl WHERE level = 1 ORDER BY cluster_id LIMIT 3)""")
def q_anti_prune(spark, sf_dir):
    """Projected rows outside the kept clusters go; rows without a cluster stay."""
    e = read_table(spark, sf_dir, "embeddings")
    pr = e.select(F.col("vec_id").alias("request_id"),
                  F.when(F.pmod("vec_id", F.lit(7)) == 0, F.lit(None)).otherwise(F.col("label"))
                  .alias("top_cluster_id"))
    kept = V.level1_ids(cluster_table(spark, sf_dir), limit=3).select(F.col("cluster_id").alias("kept_id"))
    inside = pr.join(kept, pr.top_cluster_id == kept.kept_id, "left")
    return inside.filter(F.col("kept_id").isNotNull() | F.col("top_cluster_id").isNull()).select(*pr.columns)


@register("red_clear", """
SELECT vec_id AS id, CAST(NULL AS INTEGER) AS top_cluster_id, CAST(NULL AS INTEGER) AS sub_cluster_id
FROM embeddings""")
def q_red_clear(spark, sf_dir):
    store = stored(points(spark, sf_dir).select("id", "top_cluster_id", "sub_cluster_id"), "points", ["id"])
    store.set_columns(top_cluster_id=F.lit(None), sub_cluster_id=F.lit(None))
    return store.read()


@register("emb_pending", """
SELECT d.doc_id AS id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
WHERE e.embedding IS NULL""")
def q_pending(spark, sf_dir):
    docs = _doc_table(spark, sf_dir)
    return V.pending(docs).select("id")


def _doc_table(spark, sf_dir):
    configure(spark)
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return d.join(e, d.doc_id == e.vec_id, "left").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("service_type"),
        F.col("text").alias("description"), "embedding")


@register("prj_embedding_text", """
SELECT doc_id AS id, nullif(trim(concat_ws(' | ', nullif(trim(lang), ''), nullif(trim(text), ''))), '') AS text
FROM documents""")
def q_embedding_text(spark, sf_dir):
    return _doc_table(spark, sf_dir).select("id", V.embedding_text().alias("text"))


@register("emb_batch", """
SELECT conv_id, turn, 384 AS dims, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm
FROM conversations""")
def q_emb_batch(spark, sf_dir):
    """Default hashing encoder over every conversation turn (whole texts)."""
    c = read_table(spark, sf_dir, "conversations")
    enc = V.hashing_encoder(c, "text", dim=384)
    return enc.select("conv_id", "turn", F.size("embedding").alias("dims"),
                      F.bround(V_norm("embedding"), 6).alias("norm"))


def V_norm(c):
    from civiclens.functions.vectors import norm
    return norm(c)


@register("emb_merge", """
SELECT d.doc_id AS id, e.embedding IS NULL AS was_pending, 64 AS dims,
       CASE WHEN e.embedding IS NULL THEN 1.0
            ELSE round_even(sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 4)
       END AS norm
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def q_emb_merge(spark, sf_dir):
    """Pending documents get vectors from the encoder (64 dims to match the
    stored ones) and are merged back by id; afterwards no vector is missing."""
    docs = _doc_table(spark, sf_dir)
    todo = V.pending(docs).withColumn("_t", V.embedding_text())
    new = V.hashing_encoder(todo.select("id", "_t"), "_t", dim=64).select("id", "embedding")
    store = stored(docs.select("id", F.col("embedding").isNull().alias("was_pending"), "embedding"), "vectors", ["id"])
    store.upsert(new, how="fill", insert=False)  # vectors that are null leave the stored ones
    return store.read().filter(F.col("embedding").isNotNull()).select(
        "id", "was_pending", F.size("embedding").alias("dims"), F.bround(V_norm("embedding"), 4).alias("norm"))


@register("km_fit")
def q_km_fit(spark, sf_dir):
    pts = points(spark, sf_dir)
    assigned, _ = K.fit_top(pts.drop("top_cluster_id", "sub_cluster_id"), k=25, seed=42, max_iter=100)
    return assigned


@register("km_fit_nearest", """
SELECT vec_id AS id, 25 AS centres, true AS nearest FROM embeddings""")
def q_km_fit_nearest(spark, sf_dir):
    """Every point lies with its nearest returned centroid (distances computed
    apart from the fit)."""
    pts = points(spark, sf_dir).drop("top_cluster_id", "sub_cluster_id")
    assigned, cents = K.fit_top(pts, k=25, seed=42, max_iter=100)
    every = cents.select(F.collect_list(F.struct("cluster_id", "centroid"))).scalar()  # 25 centres
    def distance(c):
        return F.aggregate(F.zip_with("embedding", c["centroid"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, d: a + d)
    far = F.transform("cents", lambda c: F.struct(distance(c).alias("d"), c["cluster_id"].alias("cluster_id")))
    both = pts.join(assigned, "id").withColumn("cents", every).withColumn("far", far)
    mine = F.filter("far", lambda c: c["cluster_id"] == F.col("top_cluster_id"))[0]["d"]
    return both.select("id", F.size("cents").alias("centres"), (mine <= F.array_min("far")["d"] + 1e-9).alias("nearest"))


@register("km_hierarchical")
def q_km_hier(spark, sf_dir):
    pts = points(spark, sf_dir).drop("top_cluster_id", "sub_cluster_id")
    assigned, _, _ = K.hierarchical(pts, k1=25, k2=10, seed=42, max_iter=100)
    return assigned


@register("prj_2d")
def q_prj_2d(spark, sf_dir):
    pts = points(spark, sf_dir)
    return K.project(S.every_nth(pts, "id", 6), k=2)


@register("prj_neighbours", """
SELECT vec_id AS id, least(15, count(*) OVER () - 1) AS neighbours, true AS others, true AS distances
FROM embeddings WHERE vec_id % 6 = 0""")
def q_prj_neighbours(spark, sf_dir):
    """The neighbour graph of the sampled points, one row for each: 15
    neighbours, all different and none itself, at distances computed apart."""
    pts = S.every_nth(points(spark, sf_dir), "id", 6)
    edges = N.neighbours(pts)
    vecs = pts.select("id", "embedding")
    both = edges.join(vecs, "id").join(vecs.select(F.col("id").alias("other"), F.col("embedding").alias("theirs")), "other")
    right = F.abs(1 - cosine("embedding", "theirs") - F.col("d")) < 1e-5
    return both.groupBy("id").agg(
        F.count(F.lit(1)).alias("neighbours"),
        ((F.count_distinct("other") == F.count(F.lit(1))) & F.every(F.col("id") != F.col("other"))).alias("others"),
        F.every(right).alias("distances"))


@register("prj_layout")
def q_prj_layout(spark, sf_dir):
    """The 2-D layout of the sampled points that keeps their neighbour graph."""
    return N.layout(S.every_nth(points(spark, sf_dir), "id", 6))
