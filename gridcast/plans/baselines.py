"""Models without a fit per fold: climatology, persistence and the raw forecast.

Every model here is a function ``(history, folds, ...) -> predictions`` that
covers all series and all folds in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridcast.functions.convert import to_local
from gridcast.functions.vocabulary import (
    CUTOFF,
    DS,
    FOLDS,
    HORIZON_HOURS,
    MODEL,
    PREFIX,
    STATION,
    TS_LOCAL,
    VALID,
    Y,
)
from gridcast.operators.covariates import forecast_window
from gridcast.operators.folds import (
    ORDINAL,
    SEGMENT,
    assign_segments,
    before_cutoff,
    fold_totals,
    future_frame,
    number_folds,
)

DAYS_IN_YEAR = 366
WINDOW_DAYS = 7
LOOKBACK_HOURS = 72


def shape(
    rows: DataFrame, model: str, yhat: Column, keys: Sequence[str], lower: Column | None = None, upper: Column | None = None, zone: str | None = None
) -> DataFrame:
    """Prediction rows; null bounds mean that no interval was estimated."""
    none = F.lit(None).cast("double")
    out = [
        *keys,
        F.lit(model).alias(MODEL),
        FOLDS,
        CUTOFF,
        DS,
        yhat.cast("double").alias("yhat"),
        (none if lower is None else lower).alias("yhat_lower"),
        (none if upper is None else upper).alias("yhat_upper"),
    ]
    if zone:
        out.append(to_local(DS, zone).alias(TS_LOCAL))
    return rows.select(*out)


def climatology(
    history: DataFrame,
    folds: DataFrame,
    hours: int = HORIZON_HOURS,
    keys: Sequence[str] = (STATION,),
    step_hours: int = 1,
    window_days: int = WINDOW_DAYS,
) -> DataFrame:
    """Mean of this hour over a window of days of the year, from data before each cutoff.

    Cell sums are aggregated per segment once and smoothed by repeating each
    cell for the days it contributes to (the year wraps); a fold adds up the
    smoothed cells of the segments before it. A cell without data falls back
    to the fold's overall mean.
    """
    observed = assign_segments(history.filter(F.col(Y).isNotNull()), folds, keys)
    cells = observed.groupBy(
        *keys, FOLDS, SEGMENT, (F.dayofyear(DS) - 1).alias("_day"), F.hour(DS).alias("_hour")
    ).agg(F.sum(Y).alias("_total"), F.count(Y).alias("_count"))
    days = F.transform(
        F.sequence(F.lit(-window_days), F.lit(window_days)), lambda o: F.pmod(F.col("_day") + o, F.lit(DAYS_IN_YEAR))
    )
    smoothed = (
        cells.withColumn("_day", F.explode(days))
        .groupBy(*keys, FOLDS, SEGMENT, "_day", "_hour")
        .agg(F.sum("_total").alias("_total"), F.sum("_count").alias("_count"))
    )
    means = fold_totals(
        cells.groupBy(*keys, FOLDS, SEGMENT).agg(F.sum("_total").alias("_all"), F.sum("_count").alias("_n")),
        folds,
        keys,
        ("_all", "_n"),
    ).select(*keys, FOLDS, CUTOFF, (F.col("_all") / F.col("_n")).alias("_fallback"))
    wanted = future_frame(number_folds(folds, keys).select(*keys, FOLDS, CUTOFF, ORDINAL), hours, step_hours).withColumns(
        {"_day": F.dayofyear(DS) - 1, "_hour": F.hour(DS)}
    )
    cell = (*keys, FOLDS, "_day", "_hour")
    named = smoothed.select(*[F.col(c).alias(f"_c_{c}") for c in cell], SEGMENT, "_total", "_count")
    earlier = F.col(SEGMENT) < F.col(ORDINAL)
    for name in cell:
        earlier = (F.col(name) == F.col(f"_c_{name}")) & earlier
    met = wanted.join(named, earlier, "left").groupBy(*keys, FOLDS, CUTOFF, DS).agg((F.sum("_total") / F.sum("_count")).alias("_mean"))
    rows = met.join(means, [*keys, FOLDS, CUTOFF], "left")
    return shape(rows, "climatology", F.coalesce("_mean", "_fallback"), keys)


def persistence(
    history: DataFrame,
    folds: DataFrame,
    hours: int = HORIZON_HOURS,
    keys: Sequence[str] = (STATION,),
    step_hours: int = 1,
    lookback_hours: int = LOOKBACK_HOURS,
) -> DataFrame:
    """Repeat the last value observed at each hour of the day within the lookback.

    An hour without one takes the last value observed at all.
    """
    recent = before_cutoff(history.filter(F.col(Y).isNotNull()).select(*keys, DS, Y), folds.select(*keys, FOLDS, CUTOFF), lookback_hours, keys)
    by_hour = recent.groupBy(*keys, FOLDS, CUTOFF, F.hour(DS).alias("_hour")).agg(
        F.max_by(Y, DS).alias("_value"), F.max(DS).alias("_at")
    )
    last = by_hour.groupBy(*keys, FOLDS, CUTOFF).agg(F.max_by("_value", "_at").alias("_fallback"))
    wanted = future_frame(folds.select(*keys, FOLDS, CUTOFF), hours, step_hours).withColumn("_hour", F.hour(DS))
    rows = wanted.join(by_hour.drop("_at"), [*keys, FOLDS, CUTOFF, "_hour"], "left").join(last, [*keys, FOLDS, CUTOFF], "left")
    return shape(rows, "persistence", F.coalesce("_value", "_fallback"), keys)


def raw_forecast(
    panel: DataFrame,
    folds: DataFrame,
    hours: int = HORIZON_HOURS,
    keys: Sequence[str] = (STATION,),
    tiebreak: Sequence[str] = (),
    name: str = "raw_gfs",
) -> DataFrame:
    """The freshest legitimate forecast, uncorrected."""
    rows = forecast_window(panel, folds, hours, keys, tiebreak).withColumnRenamed(VALID, DS)
    return shape(rows, name, F.col(PREFIX + "temperature_c"), keys)
