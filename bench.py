"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Each query is fully evaluated with the ``noop`` sink (every row produced,
nothing collected to the driver).  Writing the request table and the staged
ingest tables is timed as lines of its own; a query's time is the median of
three runs, of one for the long ones.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "top_combined", "agg_backlog_hist", "agg_backlog_level1", "agg_close_product", "agg_fcr",
    "agg_frequency_pivot", "agg_seasonality", "agg_geo_metrics", "agg_priority_category",
    "ing_clean", "ing_dedupe", "smp_percent", "red_oldest", "km_centroid_l2", "sim_assign",
    "lbl_table", "txt_keywords", "sum_all",
)
LONG = ("km_hierarchical", "str_ingest", "jn_cluster_labels")


def seconds(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from civiclens.plans import ingest, registry
    from civiclens.session import get_spark
    from civiclens.sources.requests import fact_requests
    spark = get_spark(f"local[{cpus}]", app_name="civiclens-bench", shuffle_partitions=cpus * 2)
    spark.sparkContext.setLogLevel("ERROR")
    qs = registry.queries()

    def run(name: str) -> None:
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("txt_keywords")  # warm-up, not timed: class loading and compilation
    times = {"stage_request_table": seconds(lambda: fact_requests(spark, sf_dir)),
             "stage_loaded_table": seconds(lambda: ingest.loaded(spark, sf_dir))}
    for name in sys.argv[1:] or HEADLINE + LONG:
        repeats = 1 if name in LONG else 3
        times[name] = statistics.median(seconds(lambda n=name: run(n)) for _ in range(repeats))
    times = {k: round(v, 3) for k, v in times.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
