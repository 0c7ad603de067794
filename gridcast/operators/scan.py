"""Ordered operators that never hold a whole series in one task.

A window partitioned by station alone puts that station's full history in one
task. Here a series is cut into fixed-length time blocks first: the heavy work
runs per ``(keys, block)`` and only one summary row per block is ordered along
the whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridcast.functions.convert import epoch_hours

BLOCK_HOURS = 720
BLOCK = "_block"
CORE = "_core"


def time_block(ts: Column | str, block_hours: int = BLOCK_HOURS) -> Column:
    return F.floor(epoch_hours(ts) / F.lit(block_hours)).cast("long")


def with_halo(df: DataFrame, ts: str, before: int, after: int, block_hours: int = BLOCK_HOURS) -> DataFrame:
    """Place each row in its block, and copy it to blocks that must look at it.

    ``before`` / ``after`` are the hours a block needs beyond its own edges.
    Rows owned by the block carry ``_core = true``; the copies are dropped by
    the caller once its windows are evaluated.
    """
    hour = epoch_hours(ts)
    first = F.floor((hour - F.lit(after)) / F.lit(block_hours)).cast("long")
    last = F.floor((hour + F.lit(before)) / F.lit(block_hours)).cast("long")
    # The range is never empty; the outer form keeps Spark from testing it a second time.
    placed = df.withColumn(BLOCK, F.explode_outer(F.sequence(first, last)))
    return placed.withColumn(CORE, F.col(BLOCK) == time_block(ts, block_hours))


def positions(df: DataFrame, keys: Sequence[str], ts: str, out: str = "position", block_hours: int = BLOCK_HOURS) -> DataFrame:
    """Zero-based row position along each series.

    Block sizes are summed along the series (one row per block); the in-block
    row number is added to the offset of its block.
    """
    blocked = df.withColumn(BLOCK, time_block(ts, block_hours))
    along = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys, BLOCK)
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(along), F.lit(0)))
        .drop("_size")
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(ts)
    return (
        blocked.join(offsets, [*keys, BLOCK])
        .withColumn(out, (F.col("_offset") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_offset", BLOCK)
    )


def following(df: DataFrame, keys: Sequence[str], order: str, out: str, block_size: int) -> DataFrame:
    """The next larger ``order`` value along each series, null at its end.

    Blocks are ranges of ``order`` itself; the last row of a block takes the
    first value of the next non-empty block.
    """
    blocked = df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(block_size)).cast("long"))
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    heads = (
        blocked.groupBy(*keys, BLOCK)
        .agg(F.min(order).alias("_head"))
        .withColumn("_next_head", F.lead("_head").over(along))
        .drop("_head")
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(order)
    return (
        blocked.join(heads, [*keys, BLOCK])
        .withColumn(out, F.coalesce(F.lead(order).over(inside), F.col("_next_head")))
        .drop("_next_head", BLOCK)
    )
