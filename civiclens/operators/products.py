"""Catalogued data products: a registry of builders, loading with an optional
predicate, and profiles (row/column counts plus first or last rows)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civiclens.operators import backlog as B
from civiclens.operators import closing as CL
from civiclens.operators import fcr as FC
from civiclens.operators import frequency as FQ
from civiclens.operators import geo as G
from civiclens.operators import priority as P
from civiclens.operators import rankings as R
from civiclens.sources.requests import fact_requests


@dataclass(frozen=True)
class Product:
    product_id: str
    description: str
    build: Callable[[DataFrame], DataFrame]
    predicate: str | None = None          # SQL filter applied on load
    use_cases: tuple = field(default_factory=tuple)
    metrics: tuple = field(default_factory=tuple)
    time_series: bool = False
    order: tuple = ()                     # total order for first / last rows


CATALOG: dict[str, Product] = {p.product_id: p for p in (
    Product("backlog_distribution", "Open requests by age bin and category", B.backlog_hist,
            use_cases=("backlog age",), metrics=("count",), order=("age_bin", "service_level_1")),
    Product("backlog_level1_summary", "Backlog age statistics per category", B.backlog_level1,
            metrics=("total_unresolved", "avg_age_days"), order=("service_level_1",)),
    Product("backlog_ranked_list", "Unresolved requests per category pair", B.backlog_ranked,
            metrics=("unresolved_count",), order=("service_level_1", "service_level_2")),
    Product("fcr_by_category", "First-call resolution rate per category", FC.fcr_rate,
            metrics=("fcr_rate",), order=("category",)),
    Product("frequency_over_time", "Monthly requests per category", FQ.frequency_pivot,
            metrics=("count",), time_series=True, order=("Time",)),
    Product("geographic_hot_spots", "Volume, open rows and slow p90 per district", G.geo_metrics,
            metrics=("volume", "unresolved", "slow_p90"), order=("electoral_district",)),
    Product("priority_quadrant", "Volume vs time-to-close quadrant",
            lambda df: P.categorize(P.priority(df)), metrics=("request_count",), order=("group",)),
    Product("seasonality_heatmap", "Average requests per calendar month", FQ.seasonality, time_series=True,
            order=("service_category",)),
    Product("time_to_close", "Time-to-close histogram with percentiles", CL.close_product,
            order=("service_level_1", "time_bin")),
    Product("top10", "Five top-10 rankings", R.top_combined, order=("ranking_type", "rank")),
    *(Product(pid, f"The '{kind}' ranking", R.top_combined, predicate=f"ranking_type = '{kind}'", order=("rank",))
      for pid, kind in zip(("top10_volume_30d", "top10_worst_p90_time", "top10_backlog_age", "top10_trending_up",
                            "top10_geographic_hotspots"), R.RANKING_TYPES, strict=True)),
)}


def listing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(p.product_id, p.description, list(p.use_cases), list(p.metrics)) for p in CATALOG.values()],
        "product_id string, description string, use_cases array<string>, metrics array<string>")


def load(spark: SparkSession, sf_dir: str, product_id: str, reqs: DataFrame | None = None) -> DataFrame | None:
    """Product frame with its predicate applied; unknown id -> None."""
    p = CATALOG.get(product_id)
    if p is None:
        return None
    df = p.build(reqs if reqs is not None else fact_requests(spark, sf_dir))
    return df.filter(p.predicate) if p.predicate else df


def load_many(spark: SparkSession, sf_dir: str, ids) -> dict[str, DataFrame]:
    """Several products over the materialized request table, whose scans keep
    their own pruning and pushdown; unknown ids skipped."""
    reqs = fact_requests(spark, sf_dir)
    out = {}
    for i in ids:
        df = load(spark, sf_dir, i, reqs)
        if df is not None:
            out[i] = df
    return out


def profile(df: DataFrame, order, max_rows: int = 20, from_end: bool = False) -> DataFrame:
    """Row count, column count and names, plus the first (or, for a time
    series, the last) ``max_rows`` rows as JSON text, one output row each."""
    cols = df.columns
    o = [F.desc(c) if from_end else F.asc(c) for c in order]
    rows = df.orderBy(*o).limit(max_rows).select(F.to_json(F.struct(*cols)).alias("row_json"),
                                                 *[F.col(c) for c in order])
    total = df.select(F.count(F.lit(1))).scalar()   # scalar subquery, no collect
    return rows.select(F.lit(len(cols)).alias("column_count"), F.lit(", ".join(cols)).alias("columns"),
                       total.alias("row_count"), "row_json")


#: Products whose jobs run side by side.
AT_ONCE = 4
#: One row per product; ``rows`` holds at most ``max_rows`` rows as JSON text.
PROFILE = ("status string, description string, predicate string, use_cases array<string>, metrics array<string>, "
           "row_count long, columns array<string>, rows array<string>, product_id string")


def write_profiles(reqs: DataFrame, root: str, ids: Iterable[str] | None = None, max_rows: int = 50,
                   strict: bool = False) -> None:
    """Profiles of the named products (default: all) in the table ``root``,
    by product: counts, column names, and the first rows, or the last of a time
    series.  Only the named products' rows are replaced.

    A product is computed and written once, and its slices are read from it;
    ``AT_ONCE`` products are under way together.  One that fails keeps its
    place with the error as its status; for callers that do not show the status
    ``strict`` raises once the others are written.
    """
    spark = reqs.sparkSession
    ids = list(CATALOG if ids is None else ids)
    builds = {CATALOG[pid].build: pid for pid in reversed(ids)}

    def written(build):
        path = f"{root}_products/{builds[build]}-{uuid.uuid4().hex}"
        try:
            build(reqs).write.parquet(path)
            return spark.read.parquet(path)
        except PySparkException as e:
            return e

    with ThreadPoolExecutor(AT_ONCE) as pool:
        built = dict(zip(builds, pool.map(written, builds), strict=True))
    rows, errors = [], {}
    for pid in ids:
        p = CATALOG[pid]
        df = built[p.build]
        if isinstance(df, PySparkException):
            errors[pid] = df
            failed = (f"failed: {type(df).__name__}", p.description, p.predicate, list(p.use_cases), list(p.metrics),
                      None, None, None, pid)
            rows.append(spark.createDataFrame([failed], PROFILE))
        else:
            rows.append(_profile_row(df.filter(p.predicate) if p.predicate else df, p, max_rows))
    if not rows:
        return
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    (out.repartition("product_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("product_id").parquet(root))
    if strict and errors:
        raise RuntimeError(f"products failed: {', '.join(errors)}") from next(iter(errors.values()))


def read_profiles(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(PROFILE).parquet(root)


def _profile_row(df: DataFrame, p: Product, max_rows: int) -> DataFrame:
    order = [F.desc(c) if p.time_series else F.asc(c) for c in p.order]
    few = df.orderBy(*order).limit(max_rows)
    few = few.select(F.row_number().over(Window.orderBy(*order)).alias("place"),  # max_rows rows
                     F.to_json(F.struct(*df.columns)).alias("json"))
    listed = few.select(F.array_sort(F.collect_list(F.struct("place", "json")))["json"]).scalar()
    texts = [F.array(*map(F.lit, v)).cast("array<string>") for v in (p.use_cases, p.metrics, df.columns)]
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit("ok").alias("status"), F.lit(p.description).alias("description"),
        F.lit(p.predicate).cast("string").alias("predicate"), texts[0].alias("use_cases"), texts[1].alias("metrics"),
        "row_count", texts[2].alias("columns"), listed.alias("rows"), F.lit(p.product_id).alias("product_id"))
