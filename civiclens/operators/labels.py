"""Cluster descriptions and rule-based labels (no model in the loop)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiclens.functions.ranking import rnd, top_k
from civiclens.functions.text import is_simple, keyword_tokens, meaningful, shorten, strip, words
from civiclens.sources.store import VersionedTable

CLUSTER_KEYS = ("level", "parent_cluster_id", "cluster_id")


def memberships(reqs: DataFrame, top: str = "top_cluster_id", sub: str = "sub_cluster_id") -> DataFrame:
    """Counts per cluster and service type: rows, rows with a description and
    their words, for each request's level-1 cluster and its level-2 one.

    The words are counted where the texts are read and one scan is aggregated
    by (top, sub, type); both levels are sums over that small frame, so no text
    and no row is carried twice.
    """
    described = F.col("description").isNotNull() & (F.col("description") != "")
    base = (reqs.filter(F.col(top).isNotNull())
            .groupBy(F.col(top).cast("int").alias("_top"), F.col(sub).cast("int").alias("_sub"), "service_type")
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if(described).alias("described"),
                 F.sum(F.when(described, F.size(words("description")))).alias("desc_words")))
    level1 = F.struct(F.lit(1).alias("level"), F.lit(None).cast("int").alias("parent_cluster_id"),
                      F.col("_top").alias("cluster_id"))
    level2 = F.struct(F.lit(2).alias("level"), F.col("_top").alias("parent_cluster_id"),
                      F.col("_sub").alias("cluster_id"))
    both = base.select(F.explode(F.when(F.col("_sub").isNull(), F.array(level1)).otherwise(F.array(level1, level2)))
                       .alias("_c"), "service_type", "rows", "described", "desc_words")
    return both.groupBy("_c.level", "_c.parent_cluster_id", "_c.cluster_id", "service_type").agg(
        *[F.sum(x).alias(x) for x in ("rows", "described", "desc_words")])


def type_counts(members: DataFrame) -> DataFrame:
    """(cluster, service type) counts over non-empty types (``members`` as made
    by ``memberships``), ranked inside the cluster by count desc then type (T15); the window runs over aggregated
    pairs, at most the number of distinct types per cluster."""
    t = members.filter(F.col("service_type").isNotNull() & (F.col("service_type") != ""))
    c = t.select(*CLUSTER_KEYS, "service_type", F.col("rows").alias("count"))
    w = Window.partitionBy(*CLUSTER_KEYS).orderBy(F.desc("count"), F.asc("service_type"))
    return c.withColumn("type_rank", F.row_number().over(w))


def top_types(members: DataFrame, k: int = 3) -> DataFrame:
    return type_counts(members).filter(F.col("type_rank") <= k)


def cluster_profile(members: DataFrame) -> DataFrame:
    """Per cluster: examples, typed rows, top two types and counts, number of
    distinct types, top-3 text, dominance %, average description words."""
    typed = F.col("service_type").isNotNull() & (F.col("service_type") != "")
    order = Window.partitionBy(*CLUSTER_KEYS).orderBy(F.desc(typed), F.desc("rows"), F.asc("service_type"))
    ranked = members.select("*", typed.alias("_typed"), F.when(typed, F.row_number().over(order)).alias("type_rank"))
    shown = F.struct("type_rank", F.format_string("%s (%d)", F.col("service_type"), F.col("rows")).alias("txt"))
    prof = ranked.groupBy(*CLUSTER_KEYS).agg(
        F.sum("rows").alias("examples"),
        F.coalesce(F.sum(F.when(F.col("_typed"), F.col("rows"))), F.lit(0)).alias("typed"),
        F.try_divide(F.sum("desc_words"), F.sum("described")).alias("avg_desc_words"),
        F.max(F.when(F.col("type_rank") == 1, F.col("service_type"))).alias("top_type"),
        F.max(F.when(F.col("type_rank") == 1, F.col("rows"))).alias("top_count"),
        F.max(F.when(F.col("type_rank") == 2, F.col("service_type"))).alias("second_type"),
        F.nullif(F.count("type_rank"), F.lit(0)).alias("n_types"),
        F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type_rank") <= 3, shown))),
                                          lambda x: x["txt"]), ", "), F.lit("")).alias("top_service_types"))
    return prof.withColumn("dominance_pct", F.try_divide(F.col("top_count"), F.col("typed")) * 100.0)


def simple_label(top_type, pct) -> F.Column:
    m = meaningful(words(top_type))
    return F.when((pct >= 70) & F.size(m).between(2, 3), F.array_join(m, " ")).otherwise(top_type)


def generated_label(top_type, second_type, pct, n_types) -> F.Column:
    both = F.slice(F.concat(F.slice(words(shorten(top_type, 2)), 1, 2),
                            F.slice(words(shorten(second_type, 2)), 1, 2)), 1, 4)
    return (F.when(pct >= 40, shorten(top_type, 3))
             .when(n_types == 1, shorten(top_type, 2))
             .otherwise(F.array_join(both, " ")))


def needs_review(profile: DataFrame) -> F.Column:
    """Not simple, or dominance below 70 %, or descriptions over 3 words."""
    return (~is_simple(F.col("top_type")) | (F.col("dominance_pct") < 70)
            | F.coalesce(F.col("avg_desc_words") > 3, F.lit(False)))


def label_table(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Every cluster row (empty ones included) with its label:
    EMPTY / simple label / generated label; ordered by level, parent (null
    first), cluster."""
    prof = cluster_profile(members)
    c = clusters.select(*CLUSTER_KEYS)
    j = c.join(prof, [c[k].eqNullSafe(prof[k]) for k in CLUSTER_KEYS], "left").select(
        *[c[k] for k in CLUSTER_KEYS], *[prof[x] for x in prof.columns if x not in CLUSTER_KEYS])
    ex = F.coalesce(F.col("examples"), F.lit(0))
    pct = F.col("dominance_pct")
    label = (F.when(ex == 0, F.lit("EMPTY"))
              .when(is_simple(F.col("top_type")), simple_label(F.col("top_type"), pct))
              .otherwise(generated_label(F.col("top_type"), F.col("second_type"), pct, F.col("n_types"))))
    return j.select(
        F.when(F.col("level") == 1, F.lit("Top-level")).otherwise(F.lit("Sub-cluster")).alias("level_name"),
        "level", "parent_cluster_id", "cluster_id", ex.alias("examples"), label.alias("label"),
        F.coalesce(F.col("top_service_types"), F.lit("")).alias("top_service_types"),
    ).orderBy("level", F.asc_nulls_first("parent_cluster_id"), "cluster_id")


def keywords(df: DataFrame, text_col: str = "text", k: int = 5) -> DataFrame:
    """Most common keywords over whole texts: a distributed word count
    (explode + partial aggregation), then the top k by count, word asc."""
    counts = (df.select(F.explode(keyword_tokens(text_col)).alias("keyword"))
                .groupBy("keyword").agg(F.count(F.lit(1)).alias("count")))
    return top_k(counts, k, [F.desc("count"), F.asc("keyword")])


def rank_clusters(clusters: DataFrame) -> DataFrame:
    """Level-1 clusters by size desc (id asc on ties); level-2 inside each
    parent.  The cluster table is small (one row per cluster)."""
    w1 = Window.partitionBy("level", "parent_cluster_id").orderBy(F.desc("size"), F.asc("cluster_id"))
    return clusters.withColumn("rank", F.row_number().over(w1))


def type_distribution(reqs: DataFrame, top: str = "top_cluster_id", sub: str = "sub_cluster_id",
                      digits: int = 1) -> DataFrame:
    """Service-type counts per (top, sub) cluster and their share of all rows
    in the cluster (rows with an empty type count in the total)."""
    tot = reqs.groupBy(top, sub).agg(F.count(F.lit(1)).alias("cluster_total"))
    c = (reqs.filter(F.col("service_type").isNotNull() & (F.col("service_type") != ""))
             .groupBy(top, sub, "service_type").agg(F.count(F.lit(1)).alias("count")))
    return c.join(tot, [top, sub]).withColumn(
        "pct", rnd(F.col("count") / F.col("cluster_total") * 100.0, digits))


def usable_labels(updates: DataFrame) -> DataFrame:
    """Rows of a label file that carry one: blank and "EMPTY" are skipped."""
    return updates.filter(F.col("label").isNotNull() & (strip("label") != "") & (F.col("label") != "EMPTY"))


def apply_label_updates(clusters: DataFrame, updates: DataFrame) -> DataFrame:
    """Labels from a label file merged on (cluster, parent null-safe, level);
    blank and "EMPTY" labels skipped; ``updated`` marks changed rows."""
    u = usable_labels(updates).select(*[F.col(k).alias("_u_" + k) for k in CLUSTER_KEYS],
                                      F.col("label").alias("_new"))
    cond = None
    for k in CLUSTER_KEYS:
        c = clusters[k].eqNullSafe(u["_u_" + k])
        cond = c if cond is None else cond & c
    j = clusters.join(u, cond, "left")
    old = F.col("label") if "label" in clusters.columns else F.lit(None).cast("string")
    return j.select(*[clusters[c] for c in clusters.columns if c != "label"],
                    F.coalesce(F.col("_new"), old).alias("label"),
                    F.col("_new").isNotNull().alias("updated"))


def store_labels(clusters: VersionedTable, updates: DataFrame) -> dict[str, int]:
    """A label file put into the stored cluster table; returns the clusters
    ``updated`` and the rows ``skipped`` because their cluster is not there,
    as the writing job counts them."""
    return clusters.upsert(usable_labels(updates), insert=False)


def labels_not_found(clusters: DataFrame, updates: DataFrame) -> DataFrame:
    cond = None
    for k in CLUSTER_KEYS:
        c = updates[k].eqNullSafe(clusters[k])
        cond = c if cond is None else cond & c
    return updates.join(clusters, cond, "left_anti")
