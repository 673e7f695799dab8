"""More hand-made frames, one per remaining SURVEY trap."""

import datetime as dt

from pyspark.sql import functions as F

from civiclens.functions import columns as C
from civiclens.functions.text import keyword_tokens
from civiclens.operators import closing as CL
from civiclens.operators import frequency as FQ
from civiclens.operators import metrics as M
from civiclens.operators import rankings as R
from civiclens.operators import report as RP
from civiclens.operators import sampling as S

T = dt.datetime
SCHEMA = ("service_request_id string, service_level_1 string, service_type string, "
          "date_created timestamp_ntz, date_closed timestamp_ntz, status_type string, neighbourhood string")


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_t3_null_keys_dropped_and_t12_denominator(spark):
    now = T(2024, 6, 30)
    rows = [("1", "A", "t", now, None, None, None), ("2", "A", "t", now, None, None, None),
            ("3", None, "t", now, None, None, None), ("4", "B", "t", now, None, None, None)]
    out = {r.category: (r.volume, r.pct_of_total) for r in R.top_volume(_df(spark, rows)).collect()}
    assert out == {"A": (2, 66.67), "B": (1, 33.33)}          # null category neither ranked nor counted


def test_t5_negative_durations_dropped_and_t6_interpolation(spark):
    c = T(2024, 1, 1)
    rows = [(str(i), "A", "t", c, c + dt.timedelta(days=d), "Solved", None)
            for i, d in enumerate([0, 1, 2, 3, 10, -2])] + [("n", "A", "t", c, None, "Solved", None)]
    p = CL.close_percentiles(_df(spark, rows)).collect()[0]
    assert p["count"] == 5                                    # -2 and the undated row are out
    assert (p["median"], p["p75"], p["p90"]) == (2.0, 3.0, 7.2)  # linear interpolation


def test_t10_explicit_as_of_and_t11_inclusive_cutoff(spark):
    rows = [("1", "A", "t", T(2024, 1, 31), None, None, None),   # exactly 30 days before as_of
            ("2", "A", "t", T(2024, 1, 30, 23), None, None, None),
            ("3", "A", "t", T(2024, 3, 15), None, None, None)]
    out = R.top_volume(_df(spark, rows), as_of="2024-03-01 00:00:00").collect()
    assert out[0].volume == 2                                 # 1 and 3 (>= cut-off), not 2


def test_t13_seasonality_averages_existing_cells_and_t14_no_densify(spark):
    rows = [("1", "A", "t", T(2022, 1, 5), None, None, None), ("2", "A", "t", T(2022, 1, 6), None, None, None),
            ("3", "A", "t", T(2023, 1, 7), None, None, None), ("4", "A", "t", T(2023, 3, 1), None, None, None)]
    df = _df(spark, rows)
    heat = FQ.seasonality(df).collect()[0]
    assert heat["January"] == 1.5 and heat["March"] == 1.0 and heat["February"] == 0.0
    months = [r.Time for r in FQ.frequency_pivot(df).collect()]
    assert months == ["2022-01", "2023-01", "2023-03"]        # no empty months added


def test_t15_mode_ties_break_by_value(spark):
    now = T(2024, 6, 30)
    rows = [("1", "B", "t", now, None, None, "N"), ("2", "A", "t", now, None, None, "N"),
            ("3", "C", "t", now, None, None, "M"), ("4", None, "t", now, None, None, "M")]
    out = {r.neighbourhood: r.top_category for r in R.top_geo_hotspots(_df(spark, rows)).collect()}
    assert out == {"N": "A", "M": "C"}


def test_t18_md5_sample_reproducible(spark):
    df = spark.range(0, 200).withColumnRenamed("id", "id")
    a = sorted(r.id for r in S.sample_percent(df, 25, "id", seed=7).collect())
    b = sorted(r.id for r in S.sample_percent(df.repartition(5), 25, "id", seed=7).collect())
    assert a == b and len(a) == 50


def test_t20_growth_only_from_percent_values(spark):
    for order in (["12.5% growth in Trees", "172 requests increase in Trees", "400 recent requests in Trees"],
                  ["172 requests increase in Trees", "12.5% growth in Trees", "400 recent requests in Trees"]):
        df = spark.createDataFrame([(m, i) for i, m in enumerate(order)], "metric string, _row int")
        r = RP.growth_reconcile(M.parse(df)).collect()[0]
        assert (r.category, r.growth, r.increase, r.recent_volume, r.original_value) == \
            ("Trees", 12.5, 172.0, 400.0, 228.0)


def test_t21_keyword_words_are_unicode_aware(spark):
    df = spark.createDataFrame([("Café naïve road_work 3abc abc trees the Trees",)], "text string")
    got = df.select(keyword_tokens("text").alias("k")).collect()[0].k
    assert got == ["abc", "trees", "trees"]


def test_pivot_counts_a_category_it_does_not_name(spark):
    import datetime as dt
    day = dt.datetime(2024, 1, 5)
    rows = [(c, day) for c in ("a", "a", "b", "seventh", "seventh", None)] + [("a", None), ("b", dt.datetime(2024, 2, 1))]
    df = spark.createDataFrame(rows, f"{C.LEVEL1} string, {C.CREATED} timestamp")
    wide = FQ.frequency_pivot(df, values=("a", "b"))
    assert wide.columns == ["Time", "a", "b", "Other"]
    assert [tuple(r) for r in wide.collect()] == [("2024-01", 2, 1, 2), ("2024-02", 0, 1, 0)]
