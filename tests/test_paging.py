"""Deep pages read the slices that hold them and equal OFFSET."""

import re

import pytest
from pyspark.sql import functions as F

from civiclens.operators import paging as PG
from civiclens.operators import points as PT

def order():
    return [F.desc("v"), F.asc_nulls_first("w"), F.asc("id")]


@pytest.fixture(scope="module")
def stored(spark):
    df = spark.range(20_000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1009).alias("v"),  # a third share one value
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), F.col("id") % 11)).alias("w"))
    path = PG.new_folder(spark)
    PG.store_pages(df, order(), path, slice_rows=700)
    return df, path


@pytest.mark.parametrize("page_no, size", [(0, 10), (1, 10), (123, 10), (1999, 10), (2000, 10), (6, 3000), (69, 10), (70, 10), (0, 50_000)])
def test_pages_equal_offset(spark, stored, page_no, size):
    df, path = stored
    got = PG.read_page(spark, path, df.schema, order(), page_no, size).collect()
    assert got == PT.page(df, order(), page_no, size).collect()


def test_all_pages_together_are_the_table(spark, stored):
    df, path = stored
    rows = [r for n in range(8) for r in PG.read_page(spark, path, df.schema, order(), n, 2500).collect()]
    assert rows == df.orderBy(*order()).collect()


def test_a_deep_page_reads_one_slice(spark, stored):
    df, path = stored
    index = spark.read.parquet(path + "/index")
    assert index.count() > 20 and index.agg(F.sum("rows")).first()[0] == 20_000
    assert index.agg(F.max("rows")).first()[0] < 4 * 700  # the hot value is cut by the unique key
    page = PG.read_page(spark, path, df.schema, order(), 1000, 10)
    files = page.inputFiles()
    assert len({re.search("_slice=([0-9]+)", f)[1] for f in files}) <= 2 and len(files) <= 2


def test_empty_table(spark):
    df = spark.range(0).select("id", F.col("id").alias("v"), F.lit("x").alias("w"))
    path = PG.new_folder(spark)
    PG.store_pages(df, order(), path)
    assert PG.read_page(spark, path, df.schema, order(), 0, 10).count() == 0
