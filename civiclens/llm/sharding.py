"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a row's key hash.  A bucket
whose rows exceed the byte limit splits on one more bit, and only such a
bucket; every other one keeps its prefix.  The leaves do not depend on the
order of the splits, so they are found from byte counts alone: fine cells (a
fixed prefix length, map-side sums) roll up to every shorter prefix, and a
row's shard is its shortest prefix that fits.

Rows alike in id and text share a hash and cannot be told apart by its bits:
a bucket of one key that is too large is cut into numbered pieces.  A row
larger than the limit is a shard of its own.

Defined cases: a null text has no bytes; a null id is a key like any other;
repeated rows stay as many rows; an empty table has no shards; other input
columns are kept, and columns named like an output one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiclens.llm.common import pack_row, saved, unpack_row

#: Bits of the key hash in use, and the bytes a shard may hold.
BITS = 60
LIMIT = 1 << 20


def key_bits(key: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text, as a string of 0 and 1."""
    whole = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return F.lpad(F.conv(F.substring(whole, 1, BITS // 4), 16, 2), BITS, "0")


def leaves(cells: DataFrame, limit: int, shallow: int, depth: int) -> DataFrame:
    """From cells (cell, bytes, one_key) at ``depth`` bits, each cell's bucket:
    the shortest prefix of at least ``shallow`` bits that fits ``limit``."""
    prefixes = cells.select("cell", "bytes", "one_key",
                            F.explode(F.sequence(F.lit(shallow), F.lit(depth))).alias("depth"))
    prefixes = prefixes.select("cell", "depth", "bytes", F.expr("left(cell, depth)").alias("bucket"))
    sums = prefixes.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bucket_bytes"))
    fits = (prefixes.join(sums.filter(F.col("bucket_bytes") <= limit), ["depth", "bucket"])
            .groupBy("cell").agg(F.min(F.struct("depth", "bucket")).alias("leaf")))
    return (cells.join(fits, "cell", "left")
            .select("cell", "one_key", F.col("leaf.bucket").alias("bucket"), F.col("leaf.depth").alias("depth")))


def _pieces(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of one key each cut into shards of whole rows within ``limit``;
    numbered within salts, so that no task gets all rows of a key."""
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(1024)))
    inside = Window.partitionBy("bits", "salt").orderBy("bytes")
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1))))
    piece = F.floor((F.row_number().over(inside) - 1) / per)
    return (salted.withColumn("piece", piece)
            .withColumn("shard", F.concat_ws(".", "bits", "salt", "piece"))
            .withColumn("depth", F.lit(BITS)).drop("salt", "piece"))


def shard(df: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with n_bytes (UTF-8 bytes of the text), shard and depth (bits of
    the shard's prefix).  A shard is named by its prefix; the pieces of a key
    that no bit can split are named by all bits and a number."""
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = pack_row(df, key_bits(k, t).alias("bits"), F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("bytes"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    # Four cells for each shard's worth of bytes; what a cell cannot settle is
    # looked at again, ten bits deeper.
    depth = min(BITS, max(2, math.ceil(math.log2(total / limit + 1)) + 2))
    normal, done, shallow = rows.filter(F.col("bytes") <= limit), [], 0
    while True:
        cells = (normal.groupBy(F.substring("bits", 1, depth).alias("cell"))
                 .agg(F.sum("bytes").alias("bytes"), (F.min("bits") == F.max("bits")).alias("one_key")))
        found = saved(leaves(cells, limit, shallow, depth))
        joined = normal.join(found, F.substring("bits", 1, depth) == F.col("cell"))
        done.append(joined.filter("bucket IS NOT NULL")
                    .select("row", "bytes", F.col("bucket").alias("shard"), "depth"))
        left = found.filter("bucket IS NULL").groupBy("one_key").count().collect()
        stuck = joined.filter(F.col("bucket").isNull())
        if any(r["one_key"] or depth == BITS for r in left):
            done.append(_pieces(stuck.filter(F.col("one_key") | F.lit(depth == BITS))
                                .select("row", "bits", "bytes"), limit).select("row", "bytes", "shard", "depth"))
        if depth == BITS or not any(not r["one_key"] for r in left):
            break
        normal = stuck.filter(~F.col("one_key")).select("row", "bits", "bytes")
        shallow, depth = depth + 1, min(BITS, depth + 10)
    done.append(_pieces(rows.filter(F.col("bytes") > limit), limit).select("row", "bytes", "shard", "depth"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return unpack_row(out, df.columns, n_bytes=F.col("bytes"), shard=F.col("shard"),
                      depth=F.col("depth").cast("int"))


def directory(sharded: DataFrame) -> DataFrame:
    """One row per shard: depth, rows, bytes."""
    return sharded.groupBy("shard", "depth").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; a shard fits one file, so rows meet by shard."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
