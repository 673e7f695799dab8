"""File sources and sinks: CSV, dated Parquet snapshots, GeoJSON."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civiclens.session import checkpoint_dir
from civiclens.sources import splits

SNAPSHOT_TTL_HOURS = 24


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint directory (never machine-local
    on a cluster: ``spark.checkpoint.dir`` names shared storage)."""
    return os.path.join(checkpoint_dir(spark), "civiclens", name)


# Quotes inside values are doubled, as in the source's files.
_CSV = {"multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header.  With a schema one file is read by many tasks, also
    where values hold line ends (``splits.csv_records``); without one the
    schema is inferred in a pass of its own, one task per file."""
    if schema is None:
        return spark.read.options(header=True, inferSchema=True, **_CSV).csv(path)
    if isinstance(schema, StructType):
        schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    records = splits.csv_records(spark, path).filter("not _header")
    return records.select(F.from_csv("_text", schema, _CSV).alias("_row")).select("_row.*")


#: Rows of a compressed file at most: it is read by one task.
COMPRESSED_ROWS = 500_000


def write_csv(df: DataFrame, path: str, single_file: bool = False, compressed: bool = False) -> None:
    """Product sink.  ``single_file`` (one CSV for a small product) coalesces
    to one partition; never use it for row-level tables.  ``compressed`` writes
    gzip files of ``COMPRESSED_ROWS`` rows."""
    out = df.coalesce(1) if single_file else df
    options = {"compression": "gzip", "maxRecordsPerFile": COMPRESSED_ROWS} if compressed else {}
    out.write.mode("overwrite").options(header=True, **_CSV, **options).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def cached_snapshot(spark: SparkSession, build, root: str, ttl_hours: int = SNAPSHOT_TTL_HOURS,
                    force_refresh: bool = False, now: dt.datetime | None = None) -> DataFrame:
    """Read-through snapshot: reuse the newest ``root/snap=<ts>`` folder when
    younger than the TTL, else run ``build()`` and write a new one.

    Only folder names are listed on the driver (Hadoop FileSystem API), the
    data itself is written and read by executors.
    """
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(conf)
    stamps = []
    if fs.exists(p):
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name.startswith("snap=") and fs.exists(jvm.org.apache.hadoop.fs.Path(
                    st.getPath(), "_SUCCESS")):
                try:
                    stamps.append(dt.datetime.strptime(name[5:], "%Y%m%dT%H%M%S"))
                except ValueError:
                    pass
    if stamps and not force_refresh:
        newest = max(stamps)
        if now - newest < dt.timedelta(hours=ttl_hours):
            return spark.read.parquet(os.path.join(root, "snap=" + newest.strftime("%Y%m%dT%H%M%S")))
    path = os.path.join(root, "snap=" + now.strftime("%Y%m%dT%H%M%S"))
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_geojson(spark: SparkSession, path: str, line_delimited: bool = False) -> DataFrame:
    """Features as rows: ``feature_idx``, ``properties`` (map<string,string>,
    without nulls) and ``geometry`` (JSON text).  A FeatureCollection document
    is cut into its features by many tasks (``splits.json_features``);
    line-delimited GeoJSON (one Feature per line, what ``write_geojson``
    produces) is read in Spark's own splits."""
    if line_delimited:
        raw = spark.read.json(path)
        feats = raw.select(F.monotonically_increasing_id().alias("_mid"), F.struct(*raw.columns).alias("f"))
        feats = feats.select(F.col("f.feature_idx").alias("feature_idx") if "feature_idx" in raw.columns
                             else F.col("_mid").alias("feature_idx"), "f")
        return feats.select(
            F.col("feature_idx").cast("long").alias("feature_idx"),
            F.from_json(F.to_json("f.properties"), "map<string,string>").alias("properties"),
            F.to_json("f.geometry").alias("geometry"))
    parsed = F.from_json("_text", "type string, properties map<string,string>, geometry string")
    feats = splits.json_features(spark, path).select("feature_idx", parsed.alias("f")).filter("f.type = 'Feature'")
    return feats.select("feature_idx", F.map_filter("f.properties", lambda _, v: v.isNotNull()).alias("properties"),
                        F.col("f.geometry").alias("geometry"))
