"""Chat formatting by prefix-target expansion.  DataFrame functions only.

Every assistant turn is an example of its own: all turns before it are the
context and only its text is trainable.  The examples of a conversation share
their prefixes, so writing each context out would take the square of its
length.  ``segments`` renders every turn once and gives it its place in the
conversation's formatted text; ``examples`` is one row per assistant turn:
context ``[0, context_end)``, trainable span ``[loss_start, loss_end)``, all in
code points of that text.  ``materialize`` writes the example texts out, for
conversations short enough to train on whole.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so no text can open or close
a turn, and ``unescape`` gives the text back.

Defined cases: a null role or text is empty; turns go by (turn, role, text),
nulls first, so repeated turns stay as many turns; a null conv_id is a
conversation of its own; turns after the last assistant turn are rendered and
belong to no example; other input columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Markers of the template (fixed values).
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def segments(turns: DataFrame, chunk: int = 1024) -> DataFrame:
    """One row per turn: conv_id, turn_no (from 1), role, segment, seg_start,
    text_start, text_end (code points from the segment's start), is_target and
    example_no (the example whose reply it is).

    Running totals are taken inside chunks of ``chunk`` turn numbers and then
    over the chunks' totals, so one huge conversation is spread over many tasks.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    rendered = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("said"),
        F.floor(F.col("turn") / chunk).alias("chunk"),
        F.concat(head, text, F.lit(CLOSE)).alias("segment"),
        F.length(head).cast("long").alias("text_start"),
        (F.length(head) + F.length(text)).cast("long").alias("text_end"))
    target = F.col("role") == "assistant"
    counted = rendered.select("*", F.length("segment").cast("long").alias("chars"),
                              target.alias("is_target"), target.cast("long").alias("hit"))
    inside = (Window.partitionBy("conv_id", "chunk")
              .orderBy(F.asc_nulls_first("turn"), "role", "said")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = (Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("chunk"))
              .rowsBetween(Window.unboundedPreceding, -1))
    totals = (counted.groupBy("conv_id", "chunk")
              .agg(F.count(F.lit(1)).alias("rows"), F.sum("chars").alias("chars"), F.sum("hit").alias("hits"))
              .select(F.col("conv_id").alias("c_id"), F.col("chunk").alias("c_chunk"),
                      *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before")
                        for x in ("rows", "chars", "hits")]))
    placed = counted.select("*", F.row_number().over(inside).alias("rn"),
                            F.sum("chars").over(inside).alias("upto"), F.sum("hit").over(inside).alias("hits"))
    joined = placed.join(totals, placed.conv_id.eqNullSafe(totals.c_id) & placed.chunk.eqNullSafe(totals.c_chunk))
    return joined.select(
        "conv_id", (F.col("rows_before") + F.col("rn")).alias("turn_no"), "role", "segment",
        (F.col("chars_before") + F.col("upto") - F.col("chars")).alias("seg_start"),
        "text_start", "text_end", "is_target",
        F.when(F.col("is_target"), F.col("hits_before") + F.col("hits")).alias("example_no"))


def examples(segs: DataFrame) -> DataFrame:
    """One row per assistant turn: where its context ends, the reply's own
    rendered text, its trainable span and its length."""
    return segs.filter("is_target").select(
        "conv_id", "example_no", "turn_no", F.col("seg_start").alias("context_end"), F.col("segment").alias("reply"),
        (F.col("seg_start") + F.col("text_start")).alias("loss_start"),
        (F.col("seg_start") + F.col("text_end")).alias("loss_end"),
        (F.col("seg_start") + F.length("segment")).alias("n_chars"))


def materialize(segs: DataFrame) -> DataFrame:
    """The examples written out: conv_id, example_no, context, reply (its whole
    segment), loss_start and loss_end in context + reply.  Takes the square of
    a conversation's length; filter long ones or cut by ``n_chars`` first."""
    upto = (Window.partitionBy("conv_id").orderBy("turn_no")
            .rowsBetween(Window.unboundedPreceding, -1))
    context = F.array_join(F.collect_list("segment").over(upto), "")
    return (segs.select("*", context.alias("context")).filter("is_target")
            .select("conv_id", "example_no", "context", F.col("segment").alias("reply"),
                    (F.col("seg_start") + F.col("text_start")).alias("loss_start"),
                    (F.col("seg_start") + F.col("text_end")).alias("loss_end")))


def read_back(segs: DataFrame, told: DataFrame) -> DataFrame:
    """Per conversation, from the formatted output alone: turns, their digest
    and formatted length from the segments; the text under the loss mask and
    its digest from the spans of its examples ``told``."""
    def between(whole: str, start: Column, end: Column) -> Column:
        return unescape(F.substring(F.col(whole), (start + 1).cast("int"), (end - start).cast("int")))

    parsed = segs.select(
        "conv_id", F.length("segment").cast("long").alias("chars"),
        F.struct("turn_no", between("segment", F.lit(len(OPEN)), F.col("text_start") - 1).alias("role"),
                 between("segment", F.col("text_start"), F.col("text_end")).alias("text")).alias("t"))
    whole = parsed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"),
                                          F.sum("chars").alias("formatted_chars"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    start = F.col("context_end")
    masked = told.select("conv_id", F.struct("example_no", between(
        "reply", F.col("loss_start") - start, F.col("loss_end") - start).alias("text")).alias("x"))
    loss = (masked.groupBy(F.col("conv_id").alias("x_id")).agg(F.sort_array(F.collect_list("x")).alias("x"))
            .select("x_id", F.array_join("x.text", "").alias("loss")))
    joined = whole.join(loss, F.col("conv_id").eqNullSafe(F.col("x_id")), "left").select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.coalesce("loss", F.lit("")).alias("loss"), "formatted_chars")
    return joined.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                         F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
