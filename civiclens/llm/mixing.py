"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled (order of a hash) and queued up to
``epochs`` times.  A queued copy's virtual finish time is the source's
cumulative words up to its end divided by the source's weight.  All copies are
range-sorted by finish time and cut where their words reach the total budget.
A source that runs dry leaves its share to the others by weight, which is how
the targets are defined.

Only ids, sizes and hashes are sorted.  What the cut leaves is one row per
source (the last copy taken), and joining it marks whole documents without
moving their texts.

Defined cases: a null text has size 0; a null source is a source, last in
order; rows alike in id and text are treated alike; sources without words take
nothing; an empty table gives an empty mix; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclens.llm.common import pack_row, saved, unpack_row, words

#: Weights of the sources in order, repeating; copies of a document at most;
#: rows that one window sorts, about.
WEIGHTS = (1, 2, 3)
EPOCHS = 3
WINDOW_ROWS = 2_000


def shuffle_key(key: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text."""
    whole = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(whole, 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Per source: rank, weight, source_size, rows, target.

    Targets share the words of all sources by weight.  Raising one level for
    all, a source is full at ``epochs`` times its size.  Sorted by the level at
    which they fill, the final level is the first one that does not fill its
    source when those before it are full; later ones of that kind are lower.
    """
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ranked = stats.select("*", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).alias("rank"))
    pick = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(pick, F.pmod(F.col("rank") - 1, F.lit(len(weights)))))
    cap = F.col("source_size") * epochs
    filled = Window.orderBy(cap / F.col("weight"), "rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    budget = F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(onward)
    levels = ranked.select("*", F.when(level <= cap / F.col("weight"), level).alias("level"), budget.alias("budget"))
    final = F.max("level").over(everything)
    return (levels.select("source", "rank", "weight", "source_size", "rows", "budget", final.alias("level"))
            .select("*", F.least(F.col("weight") * F.col("level"), cap.cast("double")).alias("target")))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _sum_before(value: str, groups: Sequence[str], order: str) -> Column:
    """Sum of the earlier rows of the group (none: 0)."""
    earlier = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def finish_times(sized: DataFrame, targets: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Every copy with its virtual finish time.  Running sums are taken in
    slices of the hash order (about WINDOW_ROWS rows each), over the slices of a
    block (WINDOW_ROWS slices) and over the blocks, so a source that holds most
    rows is spread over many tasks and no window sees more rows than that."""
    t = targets.select(F.col("source").alias("t_source"), "rank", "weight", "source_size",
                       F.ceil(F.col("rows") / WINDOW_ROWS).alias("slices"))
    rows = (sized.join(t, _same(F.col("source"), F.col("t_source")))
            .select("rank", "weight", "source_size", "k", "id", "size",
                    F.floor(F.col("k") / F.lit(float(1 << 60)) * F.col("slices")).alias("slice")))
    slices = rows.groupBy("rank", "slice").agg(F.sum("size").alias("words"))
    block = F.floor(F.col("slice") / WINDOW_ROWS)
    slices = slices.select("*", block.alias("block"))
    blocks = slices.groupBy("rank", "block").agg(F.sum("words").alias("words"))
    blocks = blocks.select(F.col("rank").alias("b_rank"), F.col("block").alias("b_block"),
                           _sum_before("words", ["rank"], "block").alias("b_before"))
    slices = (slices.select("*", _sum_before("words", ["rank", "block"], "slice").alias("in_block"))
              .join(blocks, (F.col("rank") == F.col("b_rank")) & (F.col("block") == F.col("b_block")))
              .select(F.col("rank").alias("s_rank"), F.col("slice").alias("s_slice"),
                      (F.col("b_before") + F.col("in_block")).alias("before")))
    inside = (Window.partitionBy("rank", "slice").orderBy("k", "id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = rows.select("*", F.sum("size").over(inside).alias("upto"))
    run = run.join(slices, (F.col("rank") == F.col("s_rank")) & (F.col("slice") == F.col("s_slice")))
    copies = run.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    done = (F.col("epoch") * F.col("source_size") + F.col("before") + F.col("upto")) / F.col("weight")
    return copies.select("rank", "epoch", "k", "id", "size", done.cast("double").alias("finish"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and the running words within it."""
    from pyspark import TaskContext
    part, carried = TaskContext.get().partitionId(), 0
    for b in batches:
        sums = np.cumsum(b.column("size").to_numpy(zero_copy_only=False)) + carried
        carried = int(sums[-1]) if len(sums) else carried
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(b.num_rows, part, "int32")), pa.array(sums.astype("int64"))],
            names=[*b.schema.names, "part", "upto"])


def last_taken(copies: DataFrame, budget: DataFrame) -> DataFrame:
    """Per source rank the last copy inside the budget, as (epoch, k, id, size)."""
    schema = T.StructType([*copies.schema.fields, T.StructField("part", T.IntegerType()),
                           T.StructField("upto", T.LongType())])
    order = ["finish", "rank", "epoch", "k", "id", "size"]
    # One layout for both uses below: a second evaluation could draw other
    # range bounds.
    dealt = saved(copies.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_running, schema))
    sums = dealt.groupBy("part").agg(F.sum("size").alias("words"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    inside = (dealt.join(starts, F.col("part") == F.col("p"))
              .filter(F.col("before") + F.col("upto") <= budget.scalar()))
    return inside.groupBy("rank").agg(F.max(F.struct("epoch", "k", "id", "size")).alias("last"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, key: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` (one row each) with size, source_size, target and copies (how
    often the mix takes the document)."""
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    helper = (F.col(f"`{source}`").alias("source"), shuffle_key(k, t).alias("k"), k.alias("id"),
              F.size(words(t)).cast("long").alias("size"))
    sized = saved(docs.select(*helper))
    targets = saved(source_targets(sized, weights, epochs))
    cut = last_taken(finish_times(sized, targets, epochs), targets.select(F.max("budget")))
    per = targets.join(cut, "rank", "left").select(F.col("source").alias("t_source"), "source_size", "target", "last")
    rows = pack_row(docs, *helper).join(per, _same(F.col("source"), F.col("t_source")))
    here = F.struct("k", "id", "size")
    upto = F.struct("last.k", "last.id", "last.size")
    copies = F.when(F.col("last").isNull(), F.lit(0)).otherwise(
        F.col("last.epoch") + F.when(here <= upto, F.lit(1)).otherwise(F.lit(0)))
    return unpack_row(rows, docs.columns, size=F.col("size"), source_size=F.col("source_size"),
                      target=F.col("target"), copies=copies.cast("int"))


def repeat(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return (mixed.filter("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
            .drop("copy"))
