"""A keyed table with versions: updates rewrite only the buckets they touch.

Rows lie in ``buckets`` folders by the hash of their key.  A manifest (one small
text file a version) names the folder of every bucket.  An update reads the
buckets its keys fall into, joins them with the new rows, writes those buckets
to new folders and publishes the next manifest, which still names the old
folders of all other buckets.  A manifest is put in place by a rename that
fails if the version exists, so

* a reader sees one whole version, the newest;
* a writer that is lost leaves folders that no manifest names;
* of two writers from one version the later one gets ``ConflictError``.

Keys compare null-safe.  What an update did is counted by ``observe`` in the
job that writes, so no second scan is needed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class ConflictError(RuntimeError):
    """Another writer published this version first."""


class Files:
    """The few file operations a manifest needs, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(self.root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The whole text under its name, or ConflictError if there is one."""
        draft, final = self.path(f"{self.root}/_drafts/{uuid.uuid4().hex}"), self.path(f"{self.root}/{name}")
        self.fs.mkdirs(final.getParent())
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        fc = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf)
        options = self.jvm.org.apache.hadoop.fs.Options
        none = self.gateway.new_array(options.Rename, 0)
        try:
            fc.rename(draft, final, none)
        except Exception as e:
            if self.fs.exists(final):
                raise ConflictError(f"{final} exists") from e
            raise


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


@dataclass
class Manifest:
    """One version: where each bucket's rows lie, and what the writer noted."""

    version: int
    keys: list[str]
    buckets: int
    schema: str
    folders: dict[str, str] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)


class VersionedTable:
    """A keyed table under ``root``; see the module's text."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    @classmethod
    def create(cls, df: DataFrame, root: str, keys: Sequence[str], buckets: int = 64,
               notes: dict[str, str] | None = None) -> VersionedTable:
        """A new table with the rows of ``df`` (one a key) as its first version."""
        table = cls(df.sparkSession, root)
        first = Manifest(0, list(keys), buckets, df.schema.json())
        table._commit(first, df.select("*", table._bucket(first).alias(BUCKET)), list(range(buckets)), notes)
        return table

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.files.names("_manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest; the newest by default."""
        if version is None:
            version = self.versions()[-1]
        return Manifest(**json.loads(self.files.read(self._name(version))))

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of a version, or of some of its buckets only."""
        return self._rows(self.manifest(version), buckets).drop(BUCKET)

    def buckets_of(self, keyed: DataFrame, at: Manifest | None = None) -> list[int]:
        """Buckets that the keys of ``keyed`` fall into: at most ``buckets``
        numbers reach the driver."""
        at = at or self.manifest()
        return sorted(r[0] for r in keyed.select(self._bucket(at).alias("b")).distinct().collect())

    def upsert(self, updates: DataFrame, how: str = "replace", insert: bool = True, update: bool = True,
               notes: dict[str, str] | None = None) -> dict[str, int]:
        """Puts ``updates`` (one row a key; with some of the columns) in.

        ``how``: ``replace`` takes the update's columns, ``fill`` only their
        values that are not null.  ``insert=False`` leaves unknown keys out,
        ``update=False`` leaves known ones as they are (insert if absent).
        Returns how many rows were updated, inserted and skipped.
        """
        at = self.manifest()
        new = self._staged(self._once(updates, at))
        touched = self.buckets_of(new, at)
        schema, have = StructType.fromJson(json.loads(at.schema)), set(updates.columns)
        old = self._rows(at, touched).select(F.lit(True).alias("_old"), F.struct("*").alias("o"))
        new = new.select(F.lit(True).alias("_new"), F.struct("*", self._bucket(at).alias(BUCKET)).alias("n"))
        same = _all(F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in at.keys)
        both = old.join(new, same, "full_outer")
        was, comes = F.col("_old").isNotNull(), F.col("_new").isNotNull()

        def value(c: str) -> Column:
            o = F.col(f"o.`{c}`")
            if c not in have:
                return o
            n = F.col(f"n.`{c}`")
            if not update:
                return F.when(was, o).otherwise(n)
            return F.coalesce(n, o) if how == "fill" else F.when(comes, n).otherwise(o)

        seen = Observation()
        counted = both.observe(
            seen, F.count_if(was & comes & F.lit(update)).alias("updated"),
            F.count_if(~was & F.lit(insert)).alias("inserted"),
            F.count_if((~was & F.lit(not insert)) | (was & comes & F.lit(not update))).alias("skipped"))
        kept = counted if insert else counted.filter(was)
        bucket = F.coalesce(F.col(f"o.{BUCKET}"), F.col(f"n.{BUCKET}")).alias(BUCKET)
        rows = kept.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], bucket)
        self._commit(at, rows, touched, notes)
        return {k: int(v) for k, v in seen.get.items()} if touched else {"updated": 0, "inserted": 0, "skipped": 0}

    def delete(self, gone: DataFrame, notes: dict[str, str] | None = None) -> int:
        """Takes out the rows whose keys are in ``gone``; returns how many."""
        at = self.manifest()
        keys = gone.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(at.keys)]).distinct()
        keys = self._staged(keys)
        touched = self.buckets_of(keys.toDF(*at.keys), at)
        same = _all(F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(at.keys))
        marked = self._rows(at, touched).join(keys.withColumn("_gone", F.lit(True)), same, "left")
        seen = Observation()
        rows = marked.observe(seen, F.count_if(F.col("_gone").isNotNull()).alias("deleted")).filter("_gone is null")
        self._commit(at, rows.select(*[f.name for f in StructType.fromJson(json.loads(at.schema))], BUCKET),
                     touched, notes)
        return int(seen.get["deleted"]) if touched else 0

    def set_columns(self, notes: dict[str, str] | None = None, **values: Column) -> None:
        """Sets columns in every row, which rewrites every bucket."""
        at = self.manifest()
        fields = {f.name: f.dataType for f in StructType.fromJson(json.loads(at.schema))}
        rows = self._rows(at).withColumns({c: v.cast(fields[c]) for c, v in values.items()})
        self._commit(at, rows, list(range(at.buckets)), notes)

    @staticmethod
    def _name(version: int) -> str:
        return f"_manifests/{version:012d}.json"

    def _bucket(self, at: Manifest) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in at.keys]), F.lit(at.buckets)).cast("int")

    def _staged(self, df: DataFrame) -> DataFrame:
        """New rows written beside the table: the buckets they touch and the
        rows that go there must come from one evaluation."""
        path = f"{self.root}/_updates/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _once(self, updates: DataFrame, at: Manifest) -> DataFrame:
        """One row a key: of several the greatest by the other columns."""
        schema = StructType.fromJson(json.loads(at.schema))
        typed = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema if f.name in updates.columns]
        rest = [c for c in schema.names if c in updates.columns and c not in at.keys]
        if not rest:
            return updates.select(*typed).distinct()
        best = F.max(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_best")
        grouped = updates.select(*typed).groupBy(*[F.col(f"`{k}`") for k in at.keys]).agg(best)
        return grouped.select(*[F.col(f"`{k}`") for k in at.keys], "_best.*")

    def _rows(self, at: Manifest, buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = [b for b in (range(at.buckets) if buckets is None else buckets) if str(b) in at.folders]
        schema = StructType.fromJson(json.loads(at.schema)).add(BUCKET, "integer")
        folders = [f"{self.root}/{at.folders[str(b)]}" for b in wanted]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def _commit(self, at: Manifest, rows: DataFrame, touched: Sequence[int],
                notes: dict[str, str] | None = None) -> None:
        """Writes the touched buckets and publishes the next version."""
        data = f"data/{uuid.uuid4().hex}"
        if touched:
            # Sized at run time: small buckets share a task, a large one is split.
            rows.withColumn("_part", F.col(BUCKET)).hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{self.root}/{data}")
        there = {int(n.split("=")[1]) for n in self.files.names(data) if n.startswith("_part=")}
        folders = {b: f for b, f in at.folders.items() if int(b) not in set(touched)}
        folders |= {str(b): f"{data}/_part={b}" for b in sorted(there)}
        following = Manifest(at.version + 1, at.keys, at.buckets, at.schema, folders, at.notes | (notes or {}))
        self.files.publish(self._name(following.version), json.dumps(vars(following)))
