"""Joining forecasts to observations without looking past a cutoff.

A run may be used at a cutoff only if it was issued strictly before it, and an
observation may be trained on only if its hour lies strictly before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridcast.functions.convert import plus_hours
from gridcast.functions.vocabulary import (
    COVARIATES,
    CUTOFF,
    DS,
    FOLDS,
    HORIZON_HOURS,
    INIT,
    INTERPOLATED,
    LEAD,
    MIN_TRAINING_DAYS,
    OBSERVED,
    PREFIX,
    STATION,
    TS,
    VALID,
    Y,
)
from gridcast.operators.align import last_known
from gridcast.operators.folds import SEGMENT, assign_segments, fold_totals
from gridcast.operators.intervals import in_window


def prefixed(panel: DataFrame, keep: Sequence[str] = (STATION,)) -> DataFrame:
    """Forecast measures renamed so they never collide with observed columns."""
    carried = [c for c in (*keep, INIT, VALID, LEAD, INTERPOLATED) if c in panel.columns]
    return panel.select(*carried, *[F.col(c).alias(PREFIX + c) for c in COVARIATES if c in panel.columns])


def regressors(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(PREFIX)]


def freshest(panel: DataFrame, by: Sequence[str], tiebreak: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` key, each column's last non-null value in order of issue time.

    Column by column: a value the newest run lacks comes from an older run,
    while issue time and lead are the newest run's.
    """
    order = F.struct(INIT, *tiebreak) if tiebreak else F.col(INIT)
    rest = [c for c in panel.columns if c not in (*by, INIT, *tiebreak)]
    return panel.groupBy(*by).agg(F.max(INIT).alias(INIT), *[last_known(c, order).alias(c) for c in rest])


def freshest_rows(panel: DataFrame, by: Sequence[str], tiebreak: Sequence[str] = ()) -> DataFrame:
    """The whole row of the latest run per ``by`` key.

    An aggregate over a struct, not a ranked window: map tasks reduce first,
    and no key's rows are gathered and sorted.
    """
    rest = [c for c in panel.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(INIT, *tiebreak))
    return panel.groupBy(*by).agg(best.alias("_row")).select(*by, "_row.*")


def _legitimate(rows: DataFrame, folds: DataFrame, hours: int, keys: Sequence[str]) -> DataFrame:
    """Panel rows inside each fold's window that were issued before its cutoff."""
    windows = folds.select(*keys, FOLDS, CUTOFF).withColumn("_until", plus_hours(F.col(CUTOFF), hours))
    met = in_window(rows, windows, VALID, CUTOFF, "_until", keys)
    return met.filter(F.col(INIT) < F.col(CUTOFF)).drop("_until")


def forecast_window(
    panel: DataFrame,
    folds: DataFrame,
    hours: int = HORIZON_HOURS,
    keys: Sequence[str] = (STATION,),
    tiebreak: Sequence[str] = (),
    rowwise: bool = False,
) -> DataFrame:
    """Freshest legitimate forecast for every hour of every fold's window, prefixed.

    One plan for all folds: panel rows meet the windows covering their valid
    hour through a bucketed equi-join, rows issued at or after the cutoff go.
    """
    met = _legitimate(prefixed(panel, (*keys, *tiebreak)), folds, hours, keys)
    by = (*keys, FOLDS, CUTOFF, VALID)
    return freshest_rows(met, by, tiebreak) if rowwise else freshest(met, by, tiebreak)


def forecast_at(panel: DataFrame, cutoff: Column, hours: int = HORIZON_HOURS, keys: Sequence[str] = (STATION,), tiebreak: Sequence[str] = ()) -> DataFrame:
    """The same for one cutoff, as a pushed-down filter."""
    end = plus_hours(cutoff, hours)
    rows = panel.filter((F.col(INIT) < cutoff) & (F.col(VALID) >= cutoff) & (F.col(VALID) < end))
    return freshest(prefixed(rows, (*keys, *tiebreak)), (*keys, VALID), tiebreak)


def require_forecast(panel: DataFrame, cutoff: Column) -> None:
    if panel.filter(F.col(INIT) < cutoff).isEmpty():
        raise ValueError("No run in the panel was issued before the cutoff.")


def training_pairs(
    panel: DataFrame,
    target: DataFrame,
    cutoff: Column | None = None,
    keys: Sequence[str] = (STATION,),
    ts: str = TS,
    value: str = "temperature_c",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Every forecast hour with a measured value before the cutoff, at every lead."""
    rows = panel if cutoff is None else panel.filter((F.col(INIT) < cutoff) & (F.col(VALID) < cutoff))
    seen = target.filter(F.col(value).isNotNull()).select(*keys, F.col(ts).cast("timestamp").alias(VALID), F.col(value).alias(OBSERVED))
    return prefixed(rows, (*keys, *extra)).join(seen, [*keys, VALID])


def forecast_error(forecast: str = PREFIX + "temperature_c", observed: str = OBSERVED) -> Column:
    """Positive means the forecast was too high."""
    return F.col(forecast) - F.col(observed)


def attach_available(
    history: DataFrame, panel: DataFrame, cutoff: Column | None = None, keys: Sequence[str] = (STATION,), tiebreak: Sequence[str] = ()
) -> DataFrame:
    """History with the freshest covariates there are; the rest stays null.

    Without a cutoff this is computed once for all folds. That is exact when
    no lead is negative: every run covering an hour before a cutoff was then
    issued before that cutoff as well.
    """
    rows = panel if cutoff is None else panel.filter(F.col(INIT) < cutoff)
    best = freshest(prefixed(rows, (*keys, *tiebreak)), (*keys, VALID), tiebreak)
    return history.join(best.withColumnRenamed(VALID, DS), [*keys, DS], "left")


def attach_complete(frame: DataFrame, covariates: DataFrame, keys: Sequence[str] = (STATION,)) -> DataFrame:
    """Left join that must cover every row; otherwise an error with the count."""
    by = [*keys, DS] + [c for c in (FOLDS, CUTOFF) if c in frame.columns and c in covariates.columns]
    joined = frame.join(covariates.withColumnRenamed(VALID, DS), by, "left")
    gap = F.lit(False)
    for name in regressors(covariates):
        gap = gap | F.col(name).isNull()
    counts = joined.agg(F.count_if(gap).alias("missing"), F.count(F.lit(1)).alias("rows")).first()
    if counts["missing"]:
        raise ValueError(f"{counts['missing']} of {counts['rows']} rows have no forecast covariate.")
    return joined


def covered_folds(
    panel: DataFrame,
    folds: DataFrame,
    hours: int = HORIZON_HOURS,
    keys: Sequence[str] = (STATION,),
    step_hours: int = 1,
) -> DataFrame:
    """Folds whose whole window has a legitimate forecast with no missing value."""
    source = prefixed(panel, keys)
    measured = [c for c in source.columns if c not in (*keys, INIT, VALID)]
    met = _legitimate(source, folds, hours, keys)
    # A column of the freshest forecast is null only if no run has it, so presence is enough.
    present = met.groupBy(*keys, FOLDS, CUTOFF, VALID).agg(
        *[F.max(F.col(c).isNotNull()).alias(c) for c in measured]
    )
    complete = F.lit(True)
    for name in measured:
        complete = complete & F.col(name)
    tally = present.groupBy(*keys, FOLDS, CUTOFF).agg(F.count_if(complete).alias("_full"), F.count(F.lit(1)).alias("_rows"))
    need = hours // step_hours
    return tally.filter((F.col("_rows") == need) & (F.col("_full") == need)).select(*keys, FOLDS, CUTOFF)


def covariate_history(
    history: DataFrame, panel: DataFrame, cutoff: Column | None = None, keys: Sequence[str] = (STATION,), tiebreak: Sequence[str] = ()
) -> DataFrame:
    """History rows that have both an observation and a forecast."""
    rows = history if cutoff is None else history.filter(F.col(DS) < cutoff)
    return attach_available(rows, panel, cutoff, keys, tiebreak).na.drop(subset=[PREFIX + "temperature_c", Y])


def usable_span(history: DataFrame, panel: DataFrame, folds: DataFrame, keys: Sequence[str] = (STATION,)) -> DataFrame:
    """First and last usable training hour, and their count, before every cutoff."""
    # Whether an hour has a forecast needs no freshest value: one non-null run is enough.
    forecast = panel.filter(F.col("temperature_c").isNotNull()).select(*keys, F.col(VALID).alias(DS)).distinct()
    usable = history.filter(F.col(Y).isNotNull()).select(*keys, DS).join(forecast, [*keys, DS], "left_semi")
    placed = assign_segments(usable, folds, keys)
    stats = placed.groupBy(*keys, FOLDS, SEGMENT).agg(
        F.min(DS).alias("first_usable"), F.max(DS).alias("last_usable"), F.count(F.lit(1)).alias("usable_hours")
    )
    totals = fold_totals(stats, folds, keys, ("usable_hours",), ("first_usable",), ("last_usable",))
    return totals.filter(F.col("usable_hours") > 0).select(*keys, FOLDS, CUTOFF, "first_usable", "last_usable", "usable_hours")


def trainable_folds(
    history: DataFrame,
    panel: DataFrame,
    folds: DataFrame,
    hours: int = HORIZON_HOURS,
    min_days: int = MIN_TRAINING_DAYS,
    keys: Sequence[str] = (STATION,),
    step_hours: int = 1,
) -> DataFrame:
    """Covered folds whose usable history also spans an annual cycle."""
    covered = covered_folds(panel, folds, hours, keys, step_hours)
    span = usable_span(history, panel, folds, keys)
    joined = covered.join(span, [*keys, FOLDS, CUTOFF])
    return joined.filter(F.col("last_usable") >= plus_hours(F.col("first_usable"), 24 * min_days)).select(*keys, FOLDS, CUTOFF)


def latest_run_block(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Flag the rows of the latest run (per ``by``): the validation block of a holdout.

    The maximum is one aggregate row per group joined back, so no group is
    gathered in a window.
    """
    if by:
        latest = rows.groupBy(*by).agg(F.max(INIT).alias("_latest"))
        return rows.join(latest, list(by)).withColumn("is_validation", F.col(INIT) == F.col("_latest")).drop("_latest")
    latest = rows.agg(F.max(INIT)).first()[0]
    return rows.withColumn("is_validation", F.col(INIT) == F.lit(latest))
