"""Partial states of a table that is partitioned by month, kept by month.

``refresh`` compares the month folders of the source with what the last refresh
saw (files, bytes and newest change of each) and computes the state of new or
changed months only; months that are gone are dropped.  The manifest of a
version names every month's folder, as in ``store``, so a lost refresh leaves
the version before, and readers never see half a refresh.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from civiclens.sources.store import Files
from civiclens.sources.tables import storage

MONTH = "created_month"


@dataclass
class Months:
    """One version: per month what was read and where its state lies."""

    version: int
    schema: str
    seen: dict[str, str]
    folders: dict[str, str]


class MonthlyState:
    """States under ``root``, made by ``partial`` from the rows of months.

    ``partial`` keeps the column ``created_month``, and its result for several
    months is the union of its results for each.
    """

    def __init__(self, spark: SparkSession, root: str, partial: Callable[[DataFrame], DataFrame]):
        self.spark, self.root, self.partial = spark, root.rstrip("/"), partial
        self.files = Files(spark, root)

    def manifest(self) -> Months | None:
        names = sorted(n for n in self.files.names("_manifests") if n.endswith(".json"))
        return Months(**json.loads(self.files.read(f"_manifests/{names[-1]}"))) if names else None

    def months_of(self, source: str) -> dict[str, str]:
        """Month folders of the source with a mark of their files, from the
        storage's listing; no row is read."""
        fs, root = storage(self.spark, source)
        out = {}
        for folder in fs.listStatus(root):
            name = folder.getPath().getName()
            if name.startswith(f"{MONTH}="):
                files = [f for f in fs.listStatus(folder.getPath()) if not f.getPath().getName().startswith(("_", "."))]
                mark = (len(files), sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0))
                out[name.split("=", 1)[1]] = ":".join(map(str, mark))
        return out

    def refresh(self, source: str) -> list[str]:
        """Brings the state up to the source; returns the months computed."""
        now, last = self.months_of(source), self.manifest()
        seen, folders = (last.seen, last.folders) if last else ({}, {})
        new = sorted(m for m in now if seen.get(m) != now[m])
        if last and not new and set(seen) == set(now):
            return []
        data, schema = f"data/{uuid.uuid4().hex}", last.schema if last else None
        if new:
            rows = self.spark.read.option("basePath", source).parquet(*[f"{source}/{MONTH}={m}" for m in new])
            state = self.partial(rows.withColumn(MONTH, rows[MONTH].cast("string")))
            schema = state.schema.json()
            state.withColumn("_month", state[MONTH]).write.partitionBy("_month").parquet(f"{self.root}/{data}")
        there = {n.split("=", 1)[1] for n in self.files.names(data) if n.startswith("_month=")}
        kept = {m: f for m, f in folders.items() if m in now and m not in new}
        kept |= {m: f"{data}/_month={m}" for m in new if m in there}
        following = Months((last.version if last else 0) + 1, schema or "", now, kept)
        self.files.publish(f"_manifests/{following.version:012d}.json", json.dumps(vars(following)))
        return new

    def read(self) -> DataFrame:
        """The states of all months."""
        at = self.manifest()
        if at is None or not at.schema:
            raise ValueError("refresh the state first")
        schema = StructType.fromJson(json.loads(at.schema))
        folders = [f"{self.root}/{f}" for f in at.folders.values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
