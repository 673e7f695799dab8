"""Deep pages without skipping rows: a table stored in slices of a sort order
beside an order-statistics index (rows before each slice).

``store_pages`` range-partitions the rows once and writes each slice in a folder
of its own.  ``read_page`` looks the page's first and last row number up in the
index (one row per slice), reads the one or two slices that hold them and sorts
only those, whatever the page number.  ``OFFSET n LIMIT m`` on the whole table
sorts and passes over all rows before the page instead.

The order must end in a unique key, so that slices cut any group of equal values;
where it does not, equal rows share a slice and come in an arbitrary order, as
with OFFSET.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civiclens.session import checkpoint_dir

#: Rows of a slice, about; slices that one window of the running count takes.
SLICE_ROWS = 100_000
BLOCK = 10_000


def new_folder(spark: SparkSession) -> str:
    """A folder for one stored order under the shared folder."""
    return os.path.join(checkpoint_dir(spark), "civiclens", "pages", uuid.uuid4().hex)


def store_pages(df: DataFrame, order: Sequence[Column], path: str, slice_rows: int = SLICE_ROWS) -> None:
    """Writes ``path/rows/_slice=i`` (sorted) and ``path/index``."""
    spark = df.sparkSession
    slices = max(1, math.ceil(df.count() / slice_rows))
    dealt = df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id())
    (dealt.sortWithinPartitions("_slice", *order).write.partitionBy("_slice").parquet(os.path.join(path, "rows")))
    # Sampled range bounds leave the slices uneven, so what was written is counted.
    counts = (spark.read.schema(f"{_ddl(df)}, _slice int").parquet(os.path.join(path, "rows"))
              .groupBy(F.col("_slice").alias("slice")).agg(F.count(F.lit(1)).alias("rows"))
              .withColumn("block", F.floor(F.col("slice") / BLOCK)))
    blocks = counts.groupBy("block").agg(F.sum("rows").alias("all")).select("block", _before("all", [], "block").alias("b"))
    (counts.select("*", _before("rows", ["block"], "slice").alias("a")).join(blocks, "block")
     .select("slice", "rows", (F.col("a") + F.col("b")).alias("before")).write.parquet(os.path.join(path, "index")))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _before(value: str, groups: Sequence[str], order: str) -> Column:
    earlier = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("slice int, rows long, before long").parquet(os.path.join(path, "index"))


def total_rows(spark: SparkSession, path: str) -> int:
    """Rows of the stored table, from the index alone."""
    return _index(spark, path).agg(F.sum("rows")).first()[0] or 0


def read_page(spark: SparkSession, path: str, schema, order: Sequence[Column], page_no: int, size: int) -> DataFrame:
    """Rows ``page_no * size`` to ``(page_no + 1) * size - 1`` of the order, in
    order; none past the end."""
    first, last = page_no * size, (page_no + 1) * size
    held = (_index(spark, path).filter((F.col("before") < last) & (F.col("before") + F.col("rows") > first) & (F.col("rows") > 0))
            .orderBy("before").collect())  # as many slices as a page spans
    if not held:
        return spark.createDataFrame([], schema)
    folders = [os.path.join(path, "rows", f"_slice={r['slice']}") for r in held]
    return (spark.read.schema(schema).parquet(*folders).orderBy(*order)
            .offset(first - held[0]["before"]).limit(size))
