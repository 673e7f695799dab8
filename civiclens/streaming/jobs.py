"""Structured Streaming versions of the three incremental behaviours.

All three read a table as a file stream (its folder of part files, or the one
file picked out of the data folder by ``pathGlobFilter``), write to a sink under the shared
checkpoint folder and run with ``availableNow`` so a test drives them to
completion; on a cluster the same jobs run with a processing-time trigger.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclens.functions.columns import ROW_ORDER
from civiclens.operators import ingest as I
from civiclens.operators import vectors as V
from civiclens.session import checkpoint_dir
from civiclens.sources.store import VersionedTable
from civiclens.sources.tables import is_folder, table_path


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    path = table_path(sf_dir, name)
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if is_folder(spark, path):
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _run_dir(spark: SparkSession, job: str) -> str:
    return os.path.join(checkpoint_dir(spark), "civiclens-streams", f"{job}-{uuid.uuid4().hex}")


def volume_windows(events: DataFrame, days: int = 7, slide_days: int = 1, delay: str = "1 day",
                   key: str = "event_type") -> DataFrame:
    """Sliding-window counts per key with a watermark: a window is emitted
    once (append mode) when the watermark passes its end; rows later than
    the watermark are dropped."""
    ev = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return (ev.groupBy(F.window("ts", f"{days} days", f"{slide_days} days"), key)
              .agg(F.count(F.lit(1)).alias("count"))
              .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window.end").cast("timestamp_ntz").alias("window_end"), key, "count"))


def run_volume(spark: SparkSession, sf_dir: str, days: int = 7) -> DataFrame:
    out = _run_dir(spark, "volume")
    q = (volume_windows(stream_table(spark, sf_dir, "events"), days)
         .writeStream.outputMode("append").format("parquet")
         .option("path", os.path.join(out, "data"))
         .option("checkpointLocation", os.path.join(out, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(os.path.join(out, "data"))


def ingest_batch(batch: DataFrame, batch_id: int, root: str, buckets: int) -> None:
    """One micro-batch of raw rows: clean, first-wins inside the batch, insert
    the keys the target does not hold (earlier batches win).

    Only the target's buckets that the batch's keys fall into are read and
    rewritten.  The manifest notes the batch, so a batch that is run again after
    a lost driver finds itself done, or nothing of it."""
    store = VersionedTable(batch.sparkSession, root)
    first = I.dedupe_first(I.clean(batch, keep=list(ROW_ORDER)), "service_request_id", list(ROW_ORDER))
    notes = {"batch": str(batch_id)}
    if not store.versions():
        VersionedTable.create(first, root, ["service_request_id"], buckets, notes)
    elif int(store.manifest().notes["batch"]) < batch_id:
        store.upsert(first, update=False, notes=notes)
    else:  # taken in before the driver was lost; its state is still to be kept
        batch.write.format("noop").mode("overwrite").save()


def raw_stream(spark: SparkSession, source: str, max_files: int | None = None,
               redelivery: str | None = "1 day", columns: Sequence[str] | None = None) -> DataFrame:
    """Raw rows of a folder that files land in, or some of their columns: each
    goes through the shuffle before the state store.

    Rows delivered again within ``redelivery`` of their first arrival are
    dropped by the state store, before any look-up in the target.  The event
    time is the arrival, which only grows, so no row is ever late: a watermark
    on the request's own date would drop old requests whole."""
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(source)
    if columns is not None:
        rows = rows.select(*[F.col(f"`{c}`") for c in columns])
    if redelivery is None:
        return rows
    arrived = rows.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", redelivery)
    return arrived.dropDuplicatesWithinWatermark(list(ROW_ORDER)).drop("_arrived")


def run_ingest(spark: SparkSession, source: str, folder: str | None = None, max_files: int | None = None,
               redelivery: str | None = "1 day", buckets: int = 16, on_batch=ingest_batch,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Takes in what has landed in ``source`` and returns the target.  With the
    same ``folder`` a later or repeated run goes on from its checkpoint.
    ``columns`` are those of ``source`` that ``on_batch`` gets (default: all)."""
    out = folder or _run_dir(spark, "ingest")
    target = os.path.join(out, "requests")
    q = (raw_stream(spark, source, max_files, redelivery, columns)
         .writeStream.foreachBatch(lambda df, i: on_batch(df, i, target, buckets))
         .option("checkpointLocation", os.path.join(out, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return VersionedTable(spark, target).read()


def embed_batch(batch: DataFrame, batch_id: int, target: str, stored: DataFrame, dim: int) -> None:
    """Only documents without a stored vector are encoded."""
    todo = batch.join(stored, batch.doc_id == stored.vec_id, "left_anti")
    enc = V.hashing_encoder(todo.select("doc_id", "text"), "text", dim=dim)
    enc.select("doc_id", "embedding").write.mode("overwrite").parquet(
        os.path.join(target, f"batch={batch_id}"))


def run_embed(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    out = _run_dir(spark, "embed")
    target = os.path.join(out, "vectors")
    stored = spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")).select("vec_id")
    docs = stream_table(spark, sf_dir, "documents").select("doc_id", "text")
    q = (docs.writeStream.foreachBatch(lambda df, i: embed_batch(df, i, target, stored, dim))
             .option("checkpointLocation", os.path.join(out, "checkpoint"))
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(target).drop("batch")
