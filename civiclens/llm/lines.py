"""Line de-duplication by distinct-site spread.

A line (trimmed of white space) found on ``min_sites`` distinct sites or more
is boilerplate.  Per line hash one aggregation merges HyperLogLog sketches of
its sites; a line whose estimate lies near the threshold gets an exact distinct
count.  Boilerplate lines are then cut from every text but the first that has
them (smallest doc_id, then position), so no passage leaves the corpus
altogether.

Defined cases: a null text stays null and has no lines; lines without a word
are never cut; a null site is a site of its own; rows that agree in doc_id and
text are treated alike; a text that loses all its lines stays as an empty
text; input columns named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclens.llm.common import WHITESPACE, let, pack_row, saved, unpack_row

#: Sites from which on a line counts as boilerplate (one more than the 2 or 3
#: that groups of near copies reach), the sketch's size (2^12 registers: 1.6 %
#: standard error) and the share around the threshold that is counted exactly.
MIN_SITES = 4
LG_REGISTERS = 12
NEAR = 0.25
#: A line on more rows than this, and than one in MOST_HOT of all boilerplate
#: rows, is hot: there are fewer than MOST_HOT such lines at any size.
HOT_ROWS = 1_000
MOST_HOT = 50_000


def _hash(*cols: Column) -> Column:
    """A 128-bit key as two 64-bit hashes."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("line"), *cols).alias("b"))


def _text_lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_table(docs: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per line with a word: doc (doc_id and text hash), pos, line hash, site."""
    base = docs.select(
        F.struct(F.col(f"`{key}`").alias("id"), _hash(F.col(f"`{text}`")).alias("h")).alias("doc"),
        F.col(f"`{site}`").alias("site"), F.posexplode(_text_lines(F.col(f"`{text}`"))).alias("pos", "raw"))
    trimmed = F.btrim(F.col("raw"), F.lit(WHITESPACE))
    return (base.select("doc", "site", "pos", trimmed.alias("line")).filter("line != ''")
            .select("doc", "site", "pos", _hash(F.col("line")).alias("line")))


def _meet(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``lines`` whose line is in ``found`` (line, rows, value), with
    that value.  Hot lines are looked up where they are read, in a broadcast of
    fewer than MOST_HOT rows; their rows then go to any task, the others to
    that of their line."""
    total = found.agg(F.sum("rows")).first()[0] or 0
    hot = F.col("rows") > max(HOT_ROWS, total // MOST_HOT)
    here = found.filter(hot).select(F.col("line").alias("hot_line"), F.col("value").alias("hot_value"))
    there = found.filter(~hot).select(F.col("line").alias("cold_line"), F.col("value").alias("cold_value"))
    marked = lines.join(F.broadcast(here), F.col("line") == F.col("hot_line"), "left")
    at = F.when(F.col("hot_line").isNull(), F.col("line")).otherwise(_hash(F.col("doc"), F.col("pos")))
    both = marked.withColumn("at", at).join(there, F.col("at") == F.col("cold_line"), "left")
    return both.filter("hot_line is not null or cold_line is not null").select(
        *lines.columns, F.when(F.col("hot_line").isNotNull(), F.col("hot_value")).otherwise(
            F.col("cold_value")).alias("value"))


def spread(lines: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """Boilerplate lines: line hash, number of sites (estimated, or exact near
    the threshold), rows, and the first place the line stands."""
    # HyperLogLog skips nulls; the hash of a null site is an ordinary value.
    sketched = saved(
        lines.groupBy("line")
        .agg(F.hll_sketch_agg(F.xxhash64("site"), F.lit(LG_REGISTERS)).alias("sketch"),
             F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc", "pos")).alias("first"))
        .filter(F.col("rows") >= min_sites)
        .select("line", "rows", "first", F.hll_sketch_estimate("sketch").alias("sites")))
    low, high = min_sites * (1 - near) - 1, min_sites * (1 + near) + 1
    close = sketched.filter(F.col("sites").between(low, high)).select("line", "rows", "first")
    exact = (_meet(lines, close.select("line", "rows", F.lit(True).alias("value")))
             .groupBy("line", "site").agg(F.lit(1).alias("one"))
             .groupBy("line").agg(F.count(F.lit(1)).alias("sites")))
    return (sketched.filter(F.col("sites") > high)
            .unionByName(close.join(exact, "line").filter(F.col("sites") >= min_sites)))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text",
                site: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, plus n_lines (all
    lines of the input text) and n_removed."""
    lines = line_table(docs, text, site, key)
    found = saved(spread(lines, min_sites).select("line", "rows", F.col("first").alias("value")))
    cut = (_meet(lines, found).filter(F.struct("doc", "pos") != F.col("value"))
           .groupBy("doc").agg(F.collect_set("pos").alias("cut")))
    rows = pack_row(docs, F.struct(F.col(f"`{key}`").alias("id"), _hash(F.col(f"`{text}`")).alias("h")).alias("doc"))
    cut = cut.select(F.col("doc.h.a").alias("a"), F.col("doc.h.b").alias("b"), F.col("doc.id").alias("id"), "cut")
    joined = rows.join(cut, F.col("doc.id").eqNullSafe(F.col("id")) & (F.col("doc.h.a") == F.col("a"))
                       & (F.col("doc.h.b") == F.col("b")), "left")
    t = F.col("row").getField(text)
    kept = let(_text_lines(t), lambda ls: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("cut")), lambda i: F.get(ls, i)), "\n"))
    return unpack_row(joined, docs.columns,
                      **{text: F.when(F.col("cut").isNull(), t).otherwise(kept),
                         "n_lines": F.coalesce(F.size(_text_lines(t)), F.lit(0)).cast("long"),
                         "n_removed": F.coalesce(F.size("cut"), F.lit(0)).cast("long")})
