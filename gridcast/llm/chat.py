"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every turn becomes a segment ``<turn>role<text>text</turn>`` and every assistant
turn an example of its own: its input is the conversation's formatted stream up
to and including that turn, and only the reply's text is under its loss mask.
An example therefore is a prefix of the stream, and is stored as offsets into
it: ``n_context`` turns before it, ``loss_start`` and ``loss_end``. So the output grows with
the turns, not with the square of a conversation's length; ``example_texts``
writes the prefixes out for conversations where that is wanted.

Inside roles and texts a backslash is doubled and ``<`` becomes ``\\l``, so no
text can hold a marker and ``plain`` gives back the text exactly.

Offsets are running sums. A conversation is cut into blocks of turn numbers;
sums run inside a block, and one row a block is ordered along the conversation,
so a conversation that holds a third of all rows is spread over its blocks.

Edge cases: a null text or role is an empty one; a null conv_id is a
conversation of its own; null turns come last; turns with equal numbers are ordered by role, then
text, and repeated rows are turns of their own; a conversation without an
assistant has no example; an empty table gives empty results; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<turn>", "<text>", "</turn>"
ASSISTANT = "assistant"
BLOCK_TURNS = 128


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def plain(text: Column) -> Column:
    """The inverse of ``escaped``: doubled backslashes separate the parts in which ``\\l`` stands for ``<``."""
    parts = F.split(text, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\l"), F.lit("<"))), "\\")


def segments(turns: DataFrame) -> DataFrame:
    """One row a turn: its place in the conversation, its segment, and the segment's offsets in the stream.

    ``start`` and ``end`` are code points; ``text_start`` and ``text_end`` bound the escaped text.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"),
    )
    cut = (
        rows.withColumn("head", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT)))
        .withColumn("inner", escaped(F.col("body")))
        .withColumn("segment", F.concat("head", "inner", F.lit(END)))
        .withColumn("size", F.length("segment").cast("long"))
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(2**62)))
    )
    along = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("conv_id", "block")
        .agg(F.sum("size").alias("chars"), F.count("*").alias("rows"))
        .select(
            F.col("conv_id").alias("_conv"),
            F.col("block").alias("_block"),
            F.coalesce(F.sum("chars").over(along), F.lit(0)).alias("chars_before"),
            F.coalesce(F.sum("rows").over(along), F.lit(0)).alias("rows_before"),
        )
    )
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "body")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumn("n", F.row_number().over(inside)).withColumn("sum", F.sum("size").over(running))
    joined = placed.join(offsets, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    start = F.col("chars_before") + F.col("sum") - F.col("size")
    return joined.select(
        "conv_id",
        (F.col("rows_before") + F.col("n") - 1).alias("place"),
        "role",
        "segment",
        start.alias("start"),
        (start + F.col("size")).alias("end"),
        (start + F.length("head")).alias("text_start"),
        (start + F.length("head") + F.length("inner")).alias("text_end"),
    )


def examples(placed: DataFrame) -> DataFrame:
    """One row an assistant turn: the prefix of the stream that is its input, and its loss span."""
    return placed.where(F.col("role") == ASSISTANT).select(
        "conv_id",
        F.col("place").alias("n_context"),
        F.col("start").alias("context_end"),
        F.col("end").alias("input_end"),
        F.col("text_start").alias("loss_start"),
        F.col("text_end").alias("loss_end"),
    )


def streams(placed: DataFrame) -> DataFrame:
    """(conv_id, formatted): the whole formatted stream of each conversation in one row."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "segment")))
    return placed.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda s: s["segment"]), "").alias("formatted"))


def example_texts(placed: DataFrame) -> DataFrame:
    """Examples written out: ``input`` holds all preceding turns and the reply, the loss span counts in it.

    This is as long as the sum of all prefixes, so quadratic in a conversation's turns.
    """
    texts = streams(placed).withColumnRenamed("conv_id", "_conv")
    joined = examples(placed).join(texts, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return joined.withColumn("input", F.substring("formatted", F.lit(1), F.col("input_end").cast("int"))).drop("formatted", "_conv")


def digests(placed: DataFrame) -> DataFrame:
    """Per conversation, read back from its stream and its examples: turns, texts under the loss mask, digests.

    A digest over a whole conversation needs the conversation in one row.
    """
    spans = examples(placed).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("loss_start", "loss_end"))).alias("spans"))
    spans = spans.withColumnRenamed("conv_id", "_conv")
    whole = streams(placed).join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    # The piece after the last end marker is empty.
    pieces = F.filter(F.split("formatted", END), lambda p: p != "")
    read = F.transform(
        pieces,
        lambda p: F.concat(
            plain(F.substring_index(F.substring(p, len(TURN) + 1, 2**31 - 1), TEXT, 1)),
            F.lit("\n"),
            plain(F.substring_index(p, TEXT, -1)),
            F.lit("\n"),
        ),
    )
    masked = F.transform(
        F.coalesce("spans", F.array()),
        lambda s: plain(F.substring(F.col("formatted"), (s["loss_start"] + 1).cast("int"), (s["loss_end"] - s["loss_start"]).cast("int"))),
    )
    loss = F.array_join(masked, "")
    return whole.select(
        "conv_id",
        F.size(pieces).cast("long").alias("n_turns"),
        F.sha2(F.array_join(read, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_examples"),
    )
