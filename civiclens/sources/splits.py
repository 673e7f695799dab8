"""Records that span lines, read out of one file by many tasks.

A file is cut at a short mark (line end, closing brace) by Spark's text reader,
which deals byte ranges ("blocks") of one file to different tasks.  Whether a
piece begins inside a quoted value, and how deep it lies in braces, follows from
sums over all pieces before it: a running sum inside its block, and one row per
block carried along the file.  A block is at most
``spark.sql.files.maxPartitionBytes`` long, which bounds every window here (a
compressed file is one block; the CSV lines go through no window).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_AT = ["_file", "_block"]


def _pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """Text between two marks, with its file, block and order in the block."""
    return spark.read.text(path, lineSep=end).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_n"), F.col("value").alias("_text"))


def _running(value: str | Column, within: list[str], order: str) -> Column:
    rows = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(rows), F.lit(0))


def _before(value: str | Column) -> Column:
    """Sum over the earlier pieces of the block."""
    return _running(value, _AT, "_n")


def _carried(value: str | Column) -> Column:
    """Sum over the earlier blocks of the file."""
    return _running(value, ["_file"], "_block")


def _either(quoted: str, name: str) -> Column:
    """``name0`` if the block begins outside quotes, else ``name1``."""
    return F.when(F.col(quoted) == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))


def _joined(mark: str) -> Column:
    """The texts of a record's pieces in file order."""
    parts = F.array_sort(F.collect_list(F.struct("_block", "_n", "_text")))
    return F.array_join(F.transform(parts, lambda p: p["_text"]), mark)


def _lines_joined(lines: DataFrame) -> DataFrame:
    """Records of lines that come in file order, ``_header`` from their first
    line.  Every task's lines begin and end outside quotes."""
    def joined(batches):
        held, inside = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            quotes = pc.count_substring(batch.column("_text"), '"').to_numpy(zero_copy_only=False)
            after = (np.cumsum(quotes) + inside) % 2
            inside, ends = after[-1], np.flatnonzero(after == 0) + 1
            if not len(ends):
                held.append(batch)
                continue
            bounds = np.concatenate([[0], ends + sum(b.num_rows for b in held)])
            whole = pa.concat_batches([*held, batch.slice(0, ends[-1])])
            held = [batch.slice(ends[-1])]
            texts = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), whole.column("_text"))
            yield pa.record_batch([whole.column("_header").take(pa.array(bounds[:-1])), pc.binary_join(texts, "\n")],
                                  ["_header", "_text"])
        if inside:
            raise ValueError("a block's lines end inside quotes")

    return lines.select("_header", "_text").mapInArrow(joined, "_header boolean, _text string")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``_header`` (whether it is its file's first record) and ``_text`` of every
    CSV record.  Line ends inside quoted values are kept, empty lines between
    records are left out.  Quotes are paired: a value that holds one is quoted
    and doubles it, as writers do.

    A first pass notes one row a block; every task gets these rows.  A record
    inside a block is put together by the task that reads it, and only the lines
    of records that go over a block's end are shuffled.  The passes must cut the
    files alike: a line that the first one saw elsewhere fails the job.
    """
    lines, n = _pieces(spark, path, "\n"), F.col("_n")
    empty = F.col("_text").isin("", "\r")
    odd = (F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit('"')))) % 2 == 1
    blocks = lines.groupBy(*_AT).agg(
        F.min("_n").alias("_from"), F.max("_n").alias("_to"), (F.count_if(odd) % 2).alias("_q"),
        F.min(F.when(odd, n)).alias("_first_odd"), F.max(F.when(odd, n)).alias("_last_odd"),
        F.min(F.when(~empty, n)).alias("_first"))
    blocks = blocks.withColumn("_quoted", _carried("_q") % 2)
    leaves_open = (F.col("_quoted") != F.col("_q")) & F.col("_last_odd").isNotNull()
    blocks = blocks.select(
        *_AT, "_from", "_to",
        F.when(F.col("_quoted") == 1, F.coalesce("_first_odd", "_to")).alias("_lead"),  # of an earlier block's record
        F.when(leaves_open, F.col("_last_odd")).alias("_tail"),                         # of one that goes on
        _carried(leaves_open.cast("long")).alias("_left_open"),
        F.when(_carried(F.col("_first").isNotNull().cast("long")) == 0, F.col("_first")).alias("_head"))
    header = F.coalesce(n == F.col("_head"), F.lit(False)).alias("_header")
    lead, tail = (F.coalesce(c, F.lit(False)) for c in (n <= F.col("_lead"), n >= F.col("_tail")))

    seen = F.coalesce(n.between(F.col("_from"), F.col("_to")), F.lit(False))
    outer = F.when(seen, lead | tail).otherwise(F.raise_error(F.lit(f"{path} was cut in two ways")))
    short = _lines_joined(lines.join(F.broadcast(blocks), _AT, "left").filter(~outer).select(header, "_text"))
    over = lines.join(F.broadcast(blocks.filter("_lead is not null or _tail is not null")), _AT).filter(outer)
    over = over.select(*_AT, "_n", "_text", header, (F.col("_left_open") + tail.cast("int")).alias("_record"))
    long = over.groupBy("_file", "_record").agg(F.max("_header").alias("_header"), _joined("\n").alias("_text"))
    records = short.filter(~empty).unionByName(long.select("_header", "_text"))
    return records.withColumn("_text", F.regexp_replace("_text", "\r\\z", ""))


def json_features(spark: SparkSession, path: str) -> DataFrame:
    """``_file``, ``feature_idx`` (place in its FeatureCollection, from 0) and
    ``_text`` of every feature.  The features are the objects at the second
    brace level that open the ``features`` array or follow a comma there; the
    caller tells them from other arrays' objects by their type."""
    plain = F.split(F.regexp_replace("_text", r"(?s)\\.", ""), '"', -1)

    def opened(side):
        text = F.array_join(F.filter(plain, lambda _, i: i % 2 == side), " ")
        return F.length(text) - F.length(F.replace(text, F.lit("{")))

    pieces = (_pieces(spark, path, "}").withColumn("_q", (F.size(plain) - 1) % 2)
              .withColumn("_deep0", opened(0) - (F.col("_q") == 0).cast("int"))
              .withColumn("_deep1", opened(1) - (F.col("_q") == 1).cast("int"))
              .withColumn("_odd", _before("_q") % 2))
    for quoted in (0, 1):
        change = F.when(F.col("_odd") == quoted, F.col("_deep0")).otherwise(F.col("_deep1"))
        pieces = pieces.withColumn(f"_change{quoted}", change).withColumn(f"_so_far{quoted}", _before(change))
    blocks = pieces.groupBy(*_AT).agg((F.sum("_q") % 2).alias("_q"), F.sum("_change0").alias("_change0"),
                                      F.sum("_change1").alias("_change1"))
    blocks = blocks.withColumn("_quoted", _carried("_q") % 2)
    blocks = blocks.select(*_AT, "_quoted", _carried(_either("_quoted", "_change")).alias("_depth"))
    first, later = r'(?s)\A.*?(?<!\\)"features"\s*:\s*\[\s*\{', r"\A\s*,\s*\{"
    top = (F.col("_depth") + _either("_quoted", "_so_far") <= 1) & (F.col("_odd") == F.col("_quoted"))
    pieces = pieces.join(blocks, _AT).select(*_AT, "_n", "_text", top.cast("long").alias("_top"))
    begins = (F.col("_top") == 1) & (F.col("_text").rlike(first) | F.col("_text").rlike(later))
    pieces = pieces.withColumn("_begins", begins.cast("long"))
    # A piece at the top level ends the feature before it, whether or not it begins one.
    sums = pieces.groupBy(*_AT).agg(F.sum("_top").alias("_top"), F.sum("_begins").alias("_begins"))
    sums = sums.select(*_AT, _carried("_top").alias("_tops"), _carried("_begins").alias("_earlier"))
    pieces = (pieces.withColumn("_top_before", _before("_top")).withColumn("_begins_before", _before("_begins"))
              .join(sums, _AT))
    cut = F.regexp_replace(F.regexp_replace("_text", later, "{"), first, "{")
    pieces = pieces.select(
        *_AT, "_n", "_begins", F.when(begins, cut).otherwise(F.col("_text")).alias("_text"),
        (F.col("_tops") + F.col("_top_before") + F.col("_top")).alias("_part"),
        (F.col("_earlier") + F.col("_begins_before")).alias("feature_idx"))
    parts = pieces.groupBy("_file", "_part").agg(
        _joined("}").alias("_text"), F.max("_begins").alias("_begins"), F.min("feature_idx").alias("feature_idx"))
    return parts.filter("_begins = 1").select("_file", "feature_idx", F.concat("_text", F.lit("}")).alias("_text"))
