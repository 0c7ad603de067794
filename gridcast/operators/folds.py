"""Backtest folds as data, and additive statistics carried across them.

Refitting per fold by rescanning its history costs folds x history. Instead
every history row is given the segment between two consecutive cutoffs it
falls in; statistics that add up (sums, counts, extremes, cross products) are
aggregated per segment once, and a running total over the few segments of a
series gives every fold's training statistics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridcast.functions.convert import plus_hours
from gridcast.functions.vocabulary import CUTOFF, DS, FOLDS, HORIZON_HOURS, MIN_TRAINING_DAYS, ROLLING_STEP_DAYS
from gridcast.operators.intervals import in_window
from gridcast.operators.scan import positions
from gridcast.session import spread

ORDINAL = "_fold"
SEGMENT = "_segment"
EDGES = ("_until", "_from", "_to")


def split(frame: DataFrame, cutoff: Column, ds: str = DS) -> tuple[DataFrame, DataFrame]:
    """Rows strictly before the cutoff, and rows at or after it."""
    return frame.filter(F.col(ds) < cutoff), frame.filter(F.col(ds) >= cutoff)


def _bounds(frame: DataFrame, keys: Sequence[str], step_hours: int) -> DataFrame:
    span = frame.groupBy(*keys).agg(F.min(DS).alias("_first"), F.max(DS).alias("_last"))
    return span.withColumn("_end", plus_hours(F.col("_last"), step_hours))


def rolling_cutoffs(
    frame: DataFrame,
    keys: Sequence[str] = (),
    horizon_hours: int = HORIZON_HOURS,
    step_days: int = ROLLING_STEP_DAYS,
    min_days: int = MIN_TRAINING_DAYS,
    step_hours: int = 1,
) -> DataFrame:
    """A cutoff every ``step_days``, from one year in to one horizon before the end."""
    span = _bounds(frame, keys, step_hours)
    first = plus_hours(F.col("_first"), 24 * min_days)
    last = plus_hours(F.col("_end"), -horizon_hours)
    steps = F.when(first <= last, F.sequence(first, last, F.expr(f"INTERVAL {24 * step_days} HOURS")))
    return span.select(*keys, F.lit("rolling").alias(FOLDS), F.explode(steps).alias(CUTOFF))


def seasonal_cutoffs(
    frame: DataFrame,
    cutoff: Column,
    keys: Sequence[str] = (),
    horizon_hours: int = HORIZON_HOURS,
    min_days: int = MIN_TRAINING_DAYS,
    step_hours: int = 1,
) -> DataFrame:
    """Anniversaries of ``cutoff`` with a year before and a full horizon inside the data."""
    span = _bounds(frame, keys, step_hours)
    # One year is taken off first: a leap-day cutoff moves to the 28th and stays there.
    back = cutoff - F.expr("INTERVAL 1 YEAR")
    years = F.greatest(F.year(back) - F.year("_first"), F.lit(0))
    listed = span.withColumn("_n", F.explode(F.sequence(F.lit(0), years)))
    candidate = back - F.make_ym_interval(F.col("_n"), F.lit(0))
    dated = listed.withColumn(CUTOFF, candidate)
    kept = dated.filter(
        (F.col(CUTOFF) >= plus_hours(F.col("_first"), 24 * min_days)) & (plus_hours(F.col(CUTOFF), horizon_hours) <= F.col("_end"))
    )
    return kept.select(*keys, F.lit("seasonal").alias(FOLDS), CUTOFF)


def future_frame(folds: DataFrame, hours: int = HORIZON_HOURS, step_hours: int = 1) -> DataFrame:
    """The rows to predict: ``hours`` from each cutoff on, one per step."""
    last = plus_hours(F.col(CUTOFF), hours - step_hours)
    scattered = spread(folds, *[c for c in folds.columns if not c.startswith("_")])
    return scattered.withColumn(DS, F.explode_outer(F.sequence(F.col(CUTOFF), last, F.expr(f"INTERVAL {step_hours} HOURS"))))


def number_folds(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each fold's ordinal in its series and set (from 1), the next cutoff, and the first and last cutoff.

    A series has few folds. A table that carries these columns already (a
    prepared and written one) is used as it is.
    """
    if ORDINAL in folds.columns:
        return folds.select(*keys, FOLDS, CUTOFF, ORDINAL, *EDGES)
    order = Window.partitionBy(*keys, FOLDS).orderBy(CUTOFF)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return folds.select(*keys, FOLDS, CUTOFF).distinct().withColumns(
        {
            ORDINAL: F.row_number().over(order),
            EDGES[0]: F.lead(CUTOFF).over(order),
            EDGES[1]: F.first(CUTOFF).over(whole),
            EDGES[2]: F.last(CUTOFF).over(whole),
        }
    )


def assign_segments(
    history: DataFrame, folds: DataFrame, keys: Sequence[str], ds: str = DS, bucket_hours: int = HORIZON_HOURS
) -> DataFrame:
    """History rows per fold set with ``_segment`` = number of cutoffs at or before them.

    Fold k trains on exactly the segments below k. Rows after the last cutoff
    train no fold and are left out.
    """
    size = bucket_hours * 3600
    until, first, last = EDGES

    def bucket(ts: Column) -> Column:
        return F.floor(F.unix_seconds(ts) / F.lit(size)).cast("long")

    numbered = number_folds(folds, keys)
    # One row per series and fold set carries its last cutoff.
    sets = numbered.filter(F.col(ORDINAL) == 1).select(*keys, FOLDS, last)
    placed = (
        history.join(sets, list(keys)).filter(F.col(ds) < F.col(last)).drop(last).withColumn("_bucket", bucket(F.col(ds)))
    )
    shared = (*keys, FOLDS, "_bucket")
    windows = (
        numbered.filter(F.col(until).isNotNull())
        .withColumn("_bucket", F.explode(F.sequence(bucket(F.col(CUTOFF)), bucket(F.col(until)))))
        .select(*[F.col(c).alias(f"_w_{c}") for c in shared], F.col(CUTOFF).alias("_since"), until, ORDINAL)
    )
    condition = (F.col(ds) >= F.col("_since")) & (F.col(ds) < F.col(until))
    for name in shared:
        condition = (F.col(name) == F.col(f"_w_{name}")) & condition
    joined = placed.join(windows, condition, "left")
    return joined.select(*history.columns, FOLDS, F.coalesce(ORDINAL, F.lit(0)).alias(SEGMENT))


def fold_totals(
    stats: DataFrame,
    folds: DataFrame,
    keys: Sequence[str] = (),
    sums: Sequence[str] = (),
    minima: Sequence[str] = (),
    maxima: Sequence[str] = (),
) -> DataFrame:
    """Running totals of per-segment statistics: one row per fold with its training statistics."""
    every = [*sums, *minima, *maxima]
    slots = number_folds(folds, keys).select(*keys, FOLDS, CUTOFF, ORDINAL, (F.col(ORDINAL) - 1).alias(SEGMENT))
    rows = stats.select(*keys, FOLDS, SEGMENT, *every).unionByName(slots, allowMissingColumns=True)
    # Within a segment its statistics come before the fold that may use them.
    order = Window.partitionBy(*keys, FOLDS).orderBy(SEGMENT, F.col(CUTOFF).isNotNull())
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    running: Mapping[str, Column] = (
        {c: F.sum(c).over(so_far) for c in sums}
        | {c: F.min(c).over(so_far) for c in minima}
        | {c: F.max(c).over(so_far) for c in maxima}
    )
    return rows.withColumns(dict(running)).filter(F.col(CUTOFF).isNotNull()).drop(SEGMENT)


def before_cutoff(
    history: DataFrame, folds: DataFrame, hours: int, keys: Sequence[str] = (), ds: str = DS
) -> DataFrame:
    """History rows in the last ``hours`` before each cutoff, tagged with their fold."""
    windows = folds.withColumns({"_since": plus_hours(F.col(CUTOFF), -hours), "_until": F.col(CUTOFF)})
    return in_window(history, windows, ds, "_since", "_until", keys, bucket_hours=hours).drop("_since", "_until")


def position_folds(
    frame: DataFrame, initial: int, horizon: int, step: int | None = None, keys: Sequence[str] = (), ds: str = DS
) -> tuple[DataFrame, DataFrame]:
    """Expanding-window folds by row position, overlap allowed when ``step < horizon``.

    Returns the fold table (origin position, training and validation rows) and
    the validation rows of every fold with their lead position.
    """
    stride = horizon if step is None else step
    if min(initial, horizon, stride) < 1:
        raise ValueError(f"Fold sizes count rows, from 1: initial={initial}, horizon={horizon}, step={step}.")
    placed = positions(frame, keys, ds)
    sizes = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    starts = F.when(
        F.lit(initial + horizon) <= F.col("_n"), F.sequence(F.lit(initial).cast("long"), F.col("_n") - horizon, F.lit(stride).cast("long"))
    )
    folds = sizes.select(*keys, F.posexplode(starts).alias("fold", "origin")).select(
        *keys,
        (F.col("fold") + 1).alias("fold"),
        "origin",
        F.col("origin").alias("train_rows"),
        F.lit(horizon).cast("long").alias("validation_rows"),
    )
    # Bucket positions by horizon: a fold's block touches at most two buckets. Folds are generated
    # from one row per series, whose size says nothing about theirs: no broadcast.
    bucketed = folds.withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor(F.col("origin") / horizon), F.floor((F.col("origin") + horizon - 1) / horizon))),
    )
    points = placed.withColumn("_bucket", F.floor(F.col("position") / horizon))
    validation = (
        points.join(bucketed.hint("merge"), [*keys, "_bucket"])
        .filter((F.col("position") >= F.col("origin")) & (F.col("position") < F.col("origin") + horizon))
        .withColumn("lead_position", F.col("position") - F.col("origin"))
        .drop("_bucket")
    )
    return folds, validation
