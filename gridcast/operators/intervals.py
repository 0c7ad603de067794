"""Point-in-window joins written as equi-joins on time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridcast.functions.vocabulary import HORIZON_HOURS


def _bucket(ts: Column, size: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(size)).cast("long")


def in_window(
    points: DataFrame,
    windows: DataFrame,
    point: str,
    start: str,
    end: str,
    keys: Sequence[str] = (),
    bucket_hours: int = HORIZON_HOURS,
) -> DataFrame:
    """Pairs with ``start <= point < end`` on equal ``keys``.

    Each window is listed under every bucket it touches and each point under
    one, so the join is a hash join on ``(keys, bucket)``: broadcast when Spark
    measures the windows as small, shuffled (with skew splitting) otherwise.
    A ``start <= point`` comparison alone would compare every pair.
    """
    size = bucket_hours * 3600
    last = F.col(end) - F.expr("INTERVAL 1 MICROSECOND")
    listed = windows.filter(F.col(start) < F.col(end)).withColumn(
        "_bucket", F.explode(F.sequence(_bucket(F.col(start), size), _bucket(last, size)))
    )
    placed = points.withColumn("_bucket", _bucket(F.col(point), size))
    return (
        placed.join(listed, [*keys, "_bucket"])
        .filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end)))
        .drop("_bucket")
    )
