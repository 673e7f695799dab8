"""Property tests (hypothesis): bins partition, pivot = long, exact cuts,
first-wins de-duplication."""

import datetime as dt

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civiclens.functions.binning import CLOSE_EDGES, CLOSE_LABELS, bin_label
from civiclens.operators import frequency as FQ
from civiclens.operators import ingest as I
from civiclens.operators import sampling as S

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.integers(min_value=-5, max_value=400), min_size=1, max_size=60))
def test_bins_partition_valid_values(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    got = df.select(bin_label(F.col("v"), CLOSE_EDGES, CLOSE_LABELS).alias("b")).toPandas()
    assert got["b"].notna().sum() == sum(v >= 0 for v in vals)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["A", "B", "C"])), min_size=1, max_size=80))
def test_pivot_sums_equal_long_sums(spark, rows):
    base = dt.datetime(2023, 1, 1)
    df = spark.createDataFrame([(base + dt.timedelta(days=7 * d), c, "t") for d, c in rows],
                               "date_created timestamp_ntz, service_level_1 string, service_type string")
    wide = FQ.frequency_pivot(df).toPandas()
    long = FQ.frequency_long(df).toPandas()
    cats = [c for c in wide.columns if c != "Time"]
    assert int(wide[cats].to_numpy().sum()) == int(long["frequency"].sum()) == len(rows)


@SETTINGS
@given(st.lists(st.integers(0, 50), min_size=1, max_size=120), st.integers(0, 100))
def test_first_n_equals_sort_and_take(spark, keys, pct):
    rows = [(i, k) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "id long, k long")
    n = int(len(rows) * pct / 100)
    got = sorted(r.id for r in S.first_n(df, n, [F.col("k"), F.col("id")]).collect())
    exp = sorted(i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))[:n])
    assert got == exp


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 1000)), min_size=1, max_size=80))
def test_dedupe_first_wins(spark, rows):
    data = [(str(k), o, f"v{o}") for k, o in rows]
    df = spark.createDataFrame(data, "service_request_id string, o long, payload string")
    got = {r.service_request_id: r.o for r in I.dedupe_first(df, "service_request_id", ["o"]).collect()}
    exp = pd.DataFrame(data, columns=["k", "o", "p"]).sort_values("o", kind="stable").drop_duplicates("k")
    assert got == dict(zip(exp["k"], exp["o"]))


def test_dedupe_moves_the_key_once_and_keeps_the_columns_order(spark):
    rows = [("a", 2, None, "x"), ("a", 1, None, None), (None, 4, 1, "z"), (None, 3, 2, "y"), ("b", None, 5, "w"), ("b", 0, 6, "v")]
    df = spark.createDataFrame(rows, "k string, o int, n int, payload string").select("payload", "o", "k", "n")
    first = I.dedupe_first(df, "k", ["o"])
    assert first.columns == df.columns
    assert sorted(first.collect(), key=repr) == sorted([(None, 1, "a", None), ("y", 3, None, 2), ("w", None, "b", 5)], key=repr)
    assert "AS k" not in first._jdf.queryExecution().optimizedPlan().toString()
    assert "k, k#" not in first._jdf.queryExecution().optimizedPlan().toString()


def test_share_cut_with_a_hot_date_is_exact_and_balanced(spark):
    from civiclens.session import checkpoint_dir
    checkpoint_dir(spark)
    n = 3000
    rows = [(i, dt.datetime(2024, 1, 1) if i % 3 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 97 + 1))
            for i in range(n)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz")
    ids = sorted(r.id for r in S.reduce_ids(df, "oldest", 50).collect())
    exp = sorted(i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))[: n // 2])
    assert ids == exp
    keyed = df.repartitionByRange(8, "created_at", "id").groupBy(F.spark_partition_id().alias("p")).count()
    assert max(r["count"] for r in keyed.collect()) < n / 3       # the hot date is split
