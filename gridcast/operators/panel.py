"""Two-clock forecast panel: raw runs to hourly rows keyed by issue and valid time."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridcast.functions import convert as C
from gridcast.functions.vocabulary import (
    FORECAST_IDENTITY,
    INIT,
    INTERPOLATED,
    LEAD,
    PANEL_COLUMNS,
    SOURCE,
    STATION,
    VALID,
)
from gridcast.operators.screen import FORECAST_SCREEN, Screen, strip_flags

EASTWARD = "wind_eastward_ms"
NORTHWARD = "wind_northward_ms"

# Published field, canonical column, conversion.
RUN_FIELDS: Mapping[str, tuple[str, Callable[[Column], Column] | None]] = {
    "TMP": ("temperature_c", C.kelvin_to_celsius),
    "DPT": ("dewpoint_c", C.kelvin_to_celsius),
    "PRATE": ("precipitation_mm", C.rate_to_mm_per_hour),
    "TCDC": ("cloud_cover_pct", None),
    "UGRD": (EASTWARD, None),
    "VGRD": (NORTHWARD, None),
}
FILLED = tuple(name for name, _ in RUN_FIELDS.values())
RUN = (SOURCE, STATION, INIT)


def normalize_runs(raw: DataFrame) -> DataFrame:
    """Published names and units to the canonical vocabulary; both clocks and the lead kept."""
    fields = []
    for raw_name, (name, convert) in RUN_FIELDS.items():
        if raw_name in raw.columns:
            value = C.number(raw_name)
            fields.append((convert(value) if convert else value).alias(name))
    return raw.select(
        SOURCE,
        STATION,
        F.col(INIT).cast("timestamp").alias(INIT),
        F.col(VALID).cast("timestamp").alias(VALID),
        F.col(LEAD).cast("int").alias(LEAD),
        *fields,
    )


def to_hourly(runs: DataFrame, columns: Sequence[str] | None = None, run: Sequence[str] = RUN) -> DataFrame:
    """Hourly rows inside each run's own span, gaps filled linearly in time.

    Windows run over published rows of one run only (its lead schedule bounds
    them), then each row generates the hours up to the next one. No grid is
    built and nothing is joined. Values are never extrapolated: an hour with no
    known value on one side stays null.
    """
    names = [c for c in (columns or FILLED) if c in runs.columns]
    up = Window.partitionBy(*run).orderBy(VALID)
    down = Window.partitionBy(*run).orderBy(F.col(VALID).desc())
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(VALID).alias("t"), F.col(c).alias("v"))) for c in names}
    anchors = {
        f"_left:{c}": F.last(k, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
        for c, k in known.items()
    }
    targets = {
        f"_right:{c}": F.last(k, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
        for c, k in known.items()
    }
    hour = F.expr("INTERVAL 1 HOUR")
    until = F.greatest(F.col(VALID), F.coalesce(F.col("_next") - hour, F.col(VALID)))
    spread = (
        runs.select(*run, VALID, *names)
        .withColumns(anchors | {"_next": F.lead(VALID).over(up)})
        .withColumns(targets)
        .withColumn("_at", F.explode_outer(F.sequence(F.col(VALID), until, hour)))
    )
    blended = []
    for c in names:
        left, right = F.col(f"`_left:{c}`"), F.col(f"`_right:{c}`")
        span = F.unix_micros(right["t"]) - F.unix_micros(left["t"])
        gone = F.unix_micros("_at") - F.unix_micros(left["t"])
        line = left["v"] + (right["v"] - left["v"]) / span * gone
        blended.append(F.when(left["t"] == F.col("_at"), left["v"]).otherwise(line).alias(c))
    return spread.select(
        *run,
        F.col("_at").alias(VALID),
        C.hours_between(INIT, "_at").cast("int").alias(LEAD),
        *blended,
        (F.col("_at") != F.col(VALID)).alias(INTERPOLATED),
    )


def derive_wind(df: DataFrame) -> DataFrame:
    """Speed and bearing from components, after the fill: a bearing cannot be interpolated across north."""
    if not {EASTWARD, NORTHWARD} <= set(df.columns):
        return df
    return df.withColumns(
        {"wind_speed_ms": C.wind_speed(EASTWARD, NORTHWARD), "wind_direction_deg": C.wind_direction(EASTWARD, NORTHWARD)}
    ).drop(EASTWARD, NORTHWARD)


def flag_forecasts(raw: DataFrame, screen: Screen = FORECAST_SCREEN) -> DataFrame:
    return screen.flag(derive_wind(to_hourly(normalize_runs(raw))))


def clean_forecasts(raw: DataFrame, screen: Screen = FORECAST_SCREEN) -> tuple[DataFrame, DataFrame]:
    """Hourly screened panel and its screening report."""
    flagged = flag_forecasts(raw, screen)
    kept = [c for c in PANEL_COLUMNS if c in flagged.columns]
    return strip_flags(flagged).select(*kept), screen.report(flagged)


def panel_summary(panel: DataFrame) -> DataFrame:
    """Runs, hours, interpolated hours and their share."""
    return panel.agg(
        F.count_distinct(SOURCE, STATION, INIT).alias("runs"),
        F.count(F.lit(1)).alias("hours"),
        F.count_if(INTERPOLATED).alias("interpolated_hours"),
        F.avg(F.col(INTERPOLATED).cast("int")).alias("interpolated_share"),
    )


def require_panel(panel: DataFrame) -> DataFrame:
    missing = sorted(set(FORECAST_IDENTITY) - set(panel.columns))
    if missing:
        raise ValueError(f"Forecast panel lacks columns: {missing}.")
    return panel
