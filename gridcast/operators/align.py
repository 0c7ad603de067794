"""Hour collapse, gap-preserving hourly grid and ordered multi-source coalescing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridcast.functions.convert import hour_floor, to_local
from gridcast.functions.vocabulary import MEASURES, SOURCE, STATION, TARGET_COLUMNS, TS, TS_LOCAL, VALUE_SOURCE
from gridcast.session import spread


def last_known(value: Column | str, order: Column) -> Column:
    """Newest non-null value: the order is hidden wherever the value is null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.max_by(v, F.when(v.isNotNull(), order))


def _order(ts: str, tiebreak: Sequence[str]) -> Column:
    return F.struct(F.col(ts), *[F.col(c) for c in tiebreak]) if tiebreak else F.col(ts)


def _present_measures(df: DataFrame, measures: Sequence[str] | None) -> list[str]:
    return [c for c in df.columns if c in MEASURES] if measures is None else list(measures)


def collapse(
    readings: DataFrame,
    measures: Sequence[str] | None = None,
    keys: Sequence[str] = (SOURCE, STATION),
    ts: str = TS,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """One row per (keys, hour): the last non-missing reading of each measure.

    A plain aggregate, so every map task reduces its rows before the shuffle
    and a station holding most of the input still spreads by hour.
    """
    names = _present_measures(readings, measures)
    order = _order(ts, tiebreak)
    return readings.groupBy(*keys, hour_floor(ts).alias("_hour")).agg(
        *[last_known(c, order).alias(c) for c in names]
    ).withColumnRenamed("_hour", ts)


def hours(start: Column, end: Column, step: str = "1 hour") -> Column:
    """Array of the half-open grid ``[start, end)``."""
    interval = F.expr(f"INTERVAL {step}")
    return F.when(start < end, F.sequence(start, end - F.expr("INTERVAL 1 MICROSECOND"), interval))


def grid(stations: DataFrame, start: Column, end: Column, ts: str = TS, step: str = "1 hour") -> DataFrame:
    """Every station row repeated for every grid hour (a generator, not a join)."""
    return stations.withColumn(ts, F.explode(hours(start, end, step)))


def align(
    readings: DataFrame,
    start: Column,
    end: Column,
    measures: Sequence[str] | None = None,
    keys: Sequence[str] = (SOURCE, STATION),
    ts: str = TS,
    tiebreak: Sequence[str] = (),
    stations: DataFrame | None = None,
) -> DataFrame:
    """Collapse onto the grid: every station x every hour, gaps left null.

    Empty grid rows are unioned in ahead of the collapse. Null values never win
    the collapse, so one aggregate yields readings and gaps together and no
    join against the grid is needed. Stations default to those with any row,
    also rows outside the grid.
    """
    names = _present_measures(readings, measures)
    known = readings.select(*keys).distinct() if stations is None else stations.select(*keys)
    order = _order(ts, tiebreak)
    inside = readings.filter((F.col(ts) >= start) & (F.col(ts) < end)).select(
        *keys, hour_floor(ts).alias("_hour"), order.alias("_order"), *names
    )
    skeleton = grid(spread(known, *keys), start, end, "_hour")
    both = inside.unionByName(skeleton, allowMissingColumns=True)
    return both.groupBy(*keys, "_hour").agg(
        *[last_known(c, F.col("_order")).alias(c) for c in names]
    ).withColumnRenamed("_hour", ts)


def coalesce_sources(
    panel: DataFrame,
    priority: Sequence[str],
    value: str = "temperature_c",
    keys: Sequence[str] = (STATION,),
    ts: str = TS,
    zone: str = "UTC",
    skeleton: DataFrame | None = None,
) -> DataFrame:
    """First source of ``priority`` with a reading wins each hour; provenance kept.

    ``skeleton`` (keys and ts) adds hours that no source lists at all. Hours
    without a reading stay null: the target is a measurement.
    """
    rank = F.lit(None).cast("int")
    for place, name in reversed(list(enumerate(priority))):
        rank = F.when(F.col(SOURCE) == name, place).otherwise(rank)
    usable = F.when(F.col(value).isNotNull(), rank)
    rows = panel.select(*keys, ts, SOURCE, value)
    if skeleton is not None:
        rows = rows.unionByName(skeleton.select(*keys, ts), allowMissingColumns=True)
    merged = rows.groupBy(*keys, ts).agg(
        F.min_by(F.when(rank.isNotNull(), F.col(value)), usable).alias(value),
        F.min_by(F.when(usable.isNotNull(), F.col(SOURCE)), usable).alias(VALUE_SOURCE),
    )
    return merged.withColumn(TS_LOCAL, to_local(ts, zone))


def target_series(panel: DataFrame, station: str, priority: Sequence[str], start: Column, end: Column, zone: str) -> DataFrame:
    """The target of one station over the whole grid, in target column order."""
    spark = panel.sparkSession
    skeleton = grid(spark.range(1).select(F.lit(station).alias(STATION)), start, end)
    chosen = panel.filter((F.col(STATION) == station) & F.col(SOURCE).isin(*priority))
    return coalesce_sources(chosen, priority, zone=zone, skeleton=skeleton).select(*TARGET_COLUMNS)


def coverage(target: DataFrame, value: str = "temperature_c", by: Sequence[str] = ()) -> DataFrame:
    """Covered hours, all hours and the covered share."""
    return target.groupBy(*by).agg(
        F.count(value).alias("covered_hours"),
        F.count(F.lit(1)).alias("hours"),
        (F.count(value) / F.count(F.lit(1))).alias("covered_share"),
    )
