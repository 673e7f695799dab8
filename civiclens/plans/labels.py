"""Registered label / keyword / cluster-description queries.

Cluster members: the embedding points joined to their documents; the
service type is built from the document language and source (two shapes,
one of them a long phrase with a connector), the description is the whole
document text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from civiclens.functions.text import CONNECTORS, SKIP_PREFIXES, STOP_WORDS
from civiclens.operators import labels as L
from civiclens.operators import vectors as V
from civiclens.plans.registry import register
from civiclens.plans.vectors import CLUSTER_KEYS, points, stored
from civiclens.sources.tables import read_table


def members_base(spark, sf_dir):
    pts = points(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    stype = F.when(F.pmod(F.col("id"), F.lit(2)) == 0,
                   F.concat_ws(" ", "lang", F.lit("service"), "source")).otherwise(
        F.concat_ws(" ", F.upper("lang"), F.lit("requests and"), "source"))
    return pts.join(docs, pts.id == docs.doc_id, "left").select(
        "id", "top_cluster_id", "sub_cluster_id", stype.alias("service_type"),
        F.col("text").alias("description"))


def cluster_rows(spark, sf_dir):
    return V.cluster_sizes(points(spark, sf_dir), k1=10, k2=4)


# ---------------------------------------------------------------- SQL twins
_CONN = ", ".join(f"'{w}'" for w in CONNECTORS)
_SKIP = ", ".join(f"'{w}'" for w in SKIP_PREFIXES)
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def s_words(s):
    return (f"(CASE WHEN trim({s}) IS NULL OR trim({s}) = '' THEN CAST([] AS VARCHAR[]) "
            f"ELSE string_split_regex(trim({s}), '\\s+') END)")


def s_is_conn(w):
    return f"(regexp_replace(lower({w}), '[.,;:]+$', '') IN ({_CONN}))"


def s_meaningful(ws):
    return f"list_filter({ws}, lambda w: lower(w) NOT IN ({_SKIP}))"


def s_shorten(s, m):
    ws = s_words(s)
    last_real = f"coalesce(list_position(list_reverse(list_transform({ws}, lambda w: {s_is_conn('w')})), false), 0)"
    keep_a = f"(CASE WHEN {last_real} = 0 THEN 0 ELSE len({ws}) - {last_real} + 1 END)"
    short = f"(CASE WHEN {keep_a} > 0 THEN array_to_string(list_slice({ws}, 1, {keep_a}), ' ') ELSE {s} END)"
    mm = s_meaningful(ws)
    src = f"(CASE WHEN len({mm}) >= {m} THEN list_slice({mm}, 1, {m}) ELSE list_slice({ws}, 1, {m}) END)"
    cpos = f"coalesce(list_position(list_transform({src}, lambda w: {s_is_conn('w')}), true), 0)"
    keep_b = f"(CASE WHEN {cpos} = 0 THEN len({src}) ELSE {cpos} - 1 END)"
    long_ = f"(CASE WHEN {keep_b} > 0 THEN array_to_string(list_slice({src}, 1, {keep_b}), ' ') ELSE {s} END)"
    return (f"(CASE WHEN {s} IS NULL OR {s} = '' THEN '' WHEN len({ws}) <= {m} THEN {short} "
            f"ELSE {long_} END)")


def s_is_simple(s):
    ws = s_words(s)
    return f"(len({ws}) BETWEEN 2 AND 3 OR len({s_meaningful(ws)}) BETWEEN 2 AND 3)"


_MEMBERS = """
WITH pts AS (SELECT vec_id AS id, label AS top_cluster_id, CAST(vec_id % 3 AS INTEGER) AS sub_cluster_id
             FROM embeddings),
mb AS (SELECT p.id, p.top_cluster_id, p.sub_cluster_id,
              CASE WHEN p.id % 2 = 0 THEN concat_ws(' ', d.lang, 'service', d.source)
                   ELSE concat_ws(' ', upper(d.lang), 'requests and', d.source) END AS service_type,
              d.text AS description
       FROM pts p LEFT JOIN documents d ON p.id = d.doc_id),
mem AS (SELECT 1 AS level, CAST(NULL AS INTEGER) AS parent_cluster_id, CAST(top_cluster_id AS INTEGER) AS cluster_id,
               service_type, description FROM mb
        UNION ALL
        SELECT 2, CAST(top_cluster_id AS INTEGER), sub_cluster_id, service_type, description FROM mb),
tc AS (SELECT level, parent_cluster_id, cluster_id, service_type, count(*) AS count,
              row_number() OVER (PARTITION BY level, parent_cluster_id, cluster_id
                                 ORDER BY count(*) DESC, service_type) AS type_rank
       FROM mem WHERE service_type IS NOT NULL AND service_type <> ''
       GROUP BY 1, 2, 3, 4),
base AS (SELECT level, parent_cluster_id, cluster_id, count(*) AS examples,
                count(*) FILTER (WHERE service_type IS NOT NULL AND service_type <> '') AS typed,
                sum(CASE WHEN description IS NOT NULL AND description <> '' THEN len(""" + s_words("description") + """) END)
                  / nullif(count(*) FILTER (WHERE description IS NOT NULL AND description <> ''), 0) AS avg_desc_words
         FROM mem GROUP BY 1, 2, 3),
tops AS (SELECT level, parent_cluster_id, cluster_id,
                max(CASE WHEN type_rank = 1 THEN service_type END) AS top_type,
                max(CASE WHEN type_rank = 1 THEN count END) AS top_count,
                max(CASE WHEN type_rank = 2 THEN service_type END) AS second_type,
                count(*) AS n_types,
                string_agg(service_type || ' (' || CAST(count AS VARCHAR) || ')', ', ' ORDER BY type_rank)
                  FILTER (WHERE type_rank <= 3) AS top_service_types
         FROM tc GROUP BY 1, 2, 3),
prof AS (SELECT b.*, t.top_type, t.top_count, t.second_type, t.n_types, t.top_service_types,
                t.top_count / b.typed * 100.0 AS dominance_pct
         FROM base b LEFT JOIN tops t ON b.level = t.level AND b.cluster_id = t.cluster_id
          AND b.parent_cluster_id IS NOT DISTINCT FROM t.parent_cluster_id),
l1 AS (SELECT cluster_id, CAST(NULL AS INTEGER) AS parent_cluster_id, 1 AS level, count(p.id) AS size
       FROM range(0, 10) r(cluster_id) LEFT JOIN pts p ON p.top_cluster_id = r.cluster_id GROUP BY 1),
l2 AS (SELECT CAST(r.i % 4 AS INTEGER) AS cluster_id, CAST(r.i // 4 AS INTEGER) AS parent_cluster_id,
              2 AS level, count(p.id) AS size
       FROM range(0, 40) r(i) LEFT JOIN pts p
         ON p.top_cluster_id = r.i // 4 AND p.sub_cluster_id = r.i % 4 GROUP BY 1, 2),
cl AS (SELECT CAST(cluster_id AS INTEGER) AS cluster_id, parent_cluster_id, level, size FROM l1
       UNION ALL SELECT * FROM l2)"""

_SIMPLE = (f"CASE WHEN dominance_pct >= 70 AND len({s_meaningful(s_words('top_type'))}) BETWEEN 2 AND 3 "
           f"THEN array_to_string({s_meaningful(s_words('top_type'))}, ' ') ELSE top_type END")
_GEN = (f"CASE WHEN dominance_pct >= 40 THEN {s_shorten('top_type', 3)} "
        f"WHEN n_types = 1 THEN {s_shorten('top_type', 2)} "
        f"ELSE array_to_string(list_slice(list_concat(list_slice({s_words(s_shorten('top_type', 2))}, 1, 2), "
        f"list_slice({s_words(s_shorten('second_type', 2))}, 1, 2)), 1, 4), ' ') END")

_LABELS = _MEMBERS + f""",
lt AS (SELECT CASE WHEN c.level = 1 THEN 'Top-level' ELSE 'Sub-cluster' END AS level_name,
              c.level, c.parent_cluster_id, c.cluster_id, coalesce(p.examples, 0) AS examples,
              CASE WHEN coalesce(p.examples, 0) = 0 THEN 'EMPTY'
                   WHEN {s_is_simple('p.top_type')} THEN ({_SIMPLE.replace('top_type', 'p.top_type').replace('dominance_pct', 'p.dominance_pct')})
                   ELSE ({_GEN.replace('second_type', 'p.second_type').replace('top_type', 'p.top_type').replace('dominance_pct', 'p.dominance_pct').replace('n_types', 'p.n_types')}) END AS label,
              coalesce(p.top_service_types, '') AS top_service_types
       FROM cl c LEFT JOIN prof p ON c.level = p.level AND c.cluster_id = p.cluster_id
        AND c.parent_cluster_id IS NOT DISTINCT FROM p.parent_cluster_id)"""


@register("lbl_table", _LABELS + " SELECT * FROM lt")
def q_label_table(spark, sf_dir):
    return L.label_table(cluster_rows(spark, sf_dir), L.memberships(members_base(spark, sf_dir)))


@register("top_k_per_group", _MEMBERS + """
SELECT level, parent_cluster_id, cluster_id, service_type, count, CAST(type_rank AS INTEGER) AS type_rank
FROM tc WHERE type_rank <= 3""")
def q_top_k_per_group(spark, sf_dir):
    return L.top_types(L.memberships(members_base(spark, sf_dir))).select(
        "level", "parent_cluster_id", "cluster_id", "service_type", "count",
        F.col("type_rank").cast("int").alias("type_rank"))


@register("lbl_dominance", _MEMBERS + """
SELECT level, parent_cluster_id, cluster_id, top_type, round_even(dominance_pct, 6) AS dominance_pct FROM prof""")
def q_dominance(spark, sf_dir):
    p = L.cluster_profile(L.memberships(members_base(spark, sf_dir)))
    return p.select("level", "parent_cluster_id", "cluster_id", "top_type",
                    F.bround("dominance_pct", 6).alias("dominance_pct"))


@register("lbl_simple", _MEMBERS + f"""
SELECT level, parent_cluster_id, cluster_id, {s_is_simple('top_type')} AS is_simple,
       ({_SIMPLE}) AS simple_label FROM prof""")
def q_simple(spark, sf_dir):
    from civiclens.functions.text import is_simple
    p = L.cluster_profile(L.memberships(members_base(spark, sf_dir)))
    return p.select("level", "parent_cluster_id", "cluster_id", is_simple(F.col("top_type")).alias("is_simple"),
                    L.simple_label(F.col("top_type"), F.col("dominance_pct")).alias("simple_label"))


@register("lbl_shorten", f"""
WITH st AS (SELECT DISTINCT CASE WHEN vec_id % 2 = 0 THEN concat_ws(' ', d.lang, 'service', d.source)
                   ELSE concat_ws(' ', upper(d.lang), 'requests and', d.source) END AS service_type
            FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id)
SELECT service_type, {s_shorten('service_type', 3)} AS short3, {s_shorten('service_type', 2)} AS short2 FROM st""")
def q_shorten(spark, sf_dir):
    from civiclens.functions.text import shorten
    m = members_base(spark, sf_dir).select("service_type").distinct()
    return m.select("service_type", shorten(F.col("service_type"), 3).alias("short3"),
                    shorten(F.col("service_type"), 2).alias("short2"))


@register("lbl_generate", _MEMBERS + f"""
SELECT level, parent_cluster_id, cluster_id, ({_GEN}) AS generated_label FROM prof""")
def q_generate(spark, sf_dir):
    p = L.cluster_profile(L.memberships(members_base(spark, sf_dir)))
    return p.select("level", "parent_cluster_id", "cluster_id",
                    L.generated_label(F.col("top_type"), F.col("second_type"), F.col("dominance_pct"),
                                      F.col("n_types")).alias("generated_label"))


@register("lbl_needs_review", _MEMBERS + f"""
SELECT level, parent_cluster_id, cluster_id,
       (NOT {s_is_simple('top_type')}) OR dominance_pct < 70 OR coalesce(avg_desc_words > 3, false) AS needs_review
FROM prof""")
def q_needs_review(spark, sf_dir):
    p = L.cluster_profile(L.memberships(members_base(spark, sf_dir)))
    return p.select("level", "parent_cluster_id", "cluster_id", L.needs_review(p).alias("needs_review"))


@register("txt_keywords", f"""
WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS keyword FROM documents)
SELECT keyword, count(*) AS count FROM w
WHERE regexp_full_match(keyword, '[a-z]{{3,}}') AND keyword NOT IN ({_STOP})
GROUP BY 1 ORDER BY count DESC, keyword LIMIT 50""")
def q_keywords(spark, sf_dir):
    """Top 50 keywords over every document, whole texts."""
    return L.keywords(read_table(spark, sf_dir, "documents", ["text"]), "text", k=50)


@register("rank_clusters", _MEMBERS + """
SELECT *, CAST(row_number() OVER (PARTITION BY level, parent_cluster_id ORDER BY size DESC, cluster_id) AS INTEGER)
       AS rank FROM cl""")
def q_rank_clusters(spark, sf_dir):
    return L.rank_clusters(cluster_rows(spark, sf_dir))


@register("clu_examples", """
SELECT vec_id AS id, label AS top_cluster_id, CAST(vec_id % 3 AS INTEGER) AS sub_cluster_id, d.text AS description
FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id
WHERE label = 1 AND vec_id % 3 = 2 ORDER BY vec_id""")
def q_examples(spark, sf_dir):
    """Rows of cluster (1, 2) ordered by id (the cluster chosen is the
    operator's argument, not a cost cut)."""
    m = members_base(spark, sf_dir)
    return (m.filter((F.col("top_cluster_id") == 1) & (F.col("sub_cluster_id") == 2))
             .select("id", "top_cluster_id", "sub_cluster_id", "description").orderBy("id"))


@register("clu_type_dist", _MEMBERS + """,
tot AS (SELECT top_cluster_id, sub_cluster_id, count(*) AS cluster_total FROM mb GROUP BY 1, 2)
SELECT m.top_cluster_id, m.sub_cluster_id, m.service_type, count(*) AS count, max(t.cluster_total) AS cluster_total,
       round_even(count(*) / max(t.cluster_total) * 100.0, 1) AS pct
FROM mb m JOIN tot t ON m.top_cluster_id = t.top_cluster_id AND m.sub_cluster_id = t.sub_cluster_id
WHERE m.service_type IS NOT NULL AND m.service_type <> '' GROUP BY 1, 2, 3""")
def q_type_dist(spark, sf_dir):
    return L.type_distribution(members_base(spark, sf_dir))


@register("jn_label_not_found", """
SELECT 1 AS level, CAST(NULL AS INTEGER) AS parent_cluster_id, 1000 + label AS cluster_id, 'moved' AS label
FROM (SELECT DISTINCT CAST(label AS INTEGER) AS label FROM embeddings)""")
def q_label_not_found(spark, sf_dir):
    """Rows of a label file whose cluster the table does not have: the file
    names every cluster once as it is and once under a number out of use."""
    ids = points(spark, sf_dir).select("top_cluster_id").distinct()
    upd = ids.select(F.explode(F.array(F.lit(0), F.lit(1000))).alias("_by"), "top_cluster_id").select(
        F.lit(1).alias("level"), F.lit(None).cast("int").alias("parent_cluster_id"),
        (F.col("_by") + F.col("top_cluster_id")).cast("int").alias("cluster_id"), F.lit("moved").alias("label"))
    return L.labels_not_found(cluster_rows(spark, sf_dir), upd)


@register("jn_label_update", _LABELS + """,
upd AS (SELECT level, parent_cluster_id, cluster_id, label FROM lt
        WHERE label IS NOT NULL AND trim(label) <> '' AND label <> 'EMPTY')
SELECT c.cluster_id, c.parent_cluster_id, c.level, c.size, u.label AS label, u.label IS NOT NULL AS updated
FROM cl c LEFT JOIN upd u ON c.level = u.level AND c.cluster_id = u.cluster_id
 AND c.parent_cluster_id IS NOT DISTINCT FROM u.parent_cluster_id""")
def q_label_update(spark, sf_dir):
    """The generated label file merged into the cluster table."""
    cl = cluster_rows(spark, sf_dir)
    lt = L.label_table(cl, L.memberships(members_base(spark, sf_dir)))
    store = stored(cl.withColumn("label", F.lit(None).cast("string")), "labels", CLUSTER_KEYS, buckets=8)
    L.store_labels(store, lt.select("level", "parent_cluster_id", "cluster_id", "label"))
    return store.read().withColumn("updated", F.col("label").isNotNull())
