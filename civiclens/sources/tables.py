"""Parquet table access for the driver-provided test tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Dimension tables whose size is fixed by the schema definition (TPC-H: 25
# nations, 5 regions), so a broadcast of them is bounded at any scale factor.
BOUNDED_TABLES = {"nation": 25, "region": 5}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Read one table; naming ``columns`` makes the scan's ReadSchema narrow."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def storage(spark: SparkSession, path: str):
    """(file system, path) of any storage Spark can read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = storage(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = storage(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose every table as a temp view for ``spark.sql``."""
    for name in TABLES:
        if path_exists(spark, table_path(sf_dir, name)):
            read_table(spark, sf_dir, name).createOrReplaceTempView(name)
