"""Canonical column names, table schemas and fixed lookup values."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCE = "source"
STATION = "station_id"
TS = "timestamp_utc"
TS_LOCAL = "timestamp_local"
VALUE_SOURCE = "temperature_source"

INIT = "init_time_utc"
VALID = "valid_time_utc"
LEAD = "lead_hours"
INTERPOLATED = "interpolated"

DS = "ds"
Y = "y"
CUTOFF = "cutoff"
FOLDS = "folds"
MODEL = "model"

IDENTITY = (SOURCE, STATION, TS)
FORECAST_IDENTITY = (SOURCE, STATION, INIT, VALID, LEAD)

MEASURES = (
    "temperature_c",
    "dewpoint_c",
    "relative_humidity_pct",
    "wind_speed_ms",
    "wind_direction_deg",
    "wind_gust_ms",
    "pressure_hpa",
    "sea_level_pressure_hpa",
    "precipitation_mm",
    "cloud_cover_pct",
    "visibility_m",
    "shortwave_radiation_wm2",
)

CANONICAL = IDENTITY + MEASURES
TARGET_COLUMNS = (TS, TS_LOCAL, STATION, "temperature_c", VALUE_SOURCE)

# Forecast measures, in the fixed order of every feature matrix.
COVARIATES = (
    "temperature_c",
    "dewpoint_c",
    "wind_speed_ms",
    "wind_direction_deg",
    "cloud_cover_pct",
    "precipitation_mm",
)
PANEL_COLUMNS = FORECAST_IDENTITY + COVARIATES + (INTERPOLATED,)
PREFIX = "gfs_"
OBSERVED = "observed_temperature_c"

HORIZON_HOURS = 336
MIN_TRAINING_DAYS = 365
ROLLING_STEP_DAYS = 14

OBSERVATION_SCHEMA = T.StructType(
    [T.StructField(SOURCE, T.StringType()), T.StructField(STATION, T.StringType()), T.StructField(TS, T.TimestampType())]
    + [T.StructField(name, T.DoubleType()) for name in MEASURES]
)

# Percent of sky covered for each reported sky code.
SKY_COVER_PCT = {
    "SKC": 0.0,
    "CLR": 0.0,
    "NCD": 0.0,
    "NSC": 0.0,
    "FEW": 18.75,
    "SCT": 43.75,
    "BKN": 75.0,
    "OVC": 100.0,
    "VV": 100.0,
}

# Inclusive plausible bounds per measurement.
PLAUSIBLE = {
    "temperature_c": (-30.0, 50.0),
    "dewpoint_c": (-40.0, 35.0),
    "relative_humidity_pct": (0.0, 100.0),
    "wind_speed_ms": (0.0, 60.0),
    "wind_direction_deg": (0.0, 360.0),
    "wind_gust_ms": (0.0, 90.0),
    "pressure_hpa": (900.0, 1100.0),
    "sea_level_pressure_hpa": (900.0, 1100.0),
    "precipitation_mm": (0.0, 250.0),
    "cloud_cover_pct": (0.0, 100.0),
    "visibility_m": (0.0, 40000.0),
    "shortwave_radiation_wm2": (0.0, 1400.0),
}

# Measurements that never legitimately hold still for a day.
FLATLINE_MEASURES = ("temperature_c", "dewpoint_c", "pressure_hpa", "sea_level_pressure_hpa")

# Quality codes that keep a reading, and the highest grade kept.
ACCEPTED_QUALITY_CODES = ("0", "1", "4", "5", "9")
MAX_GRADE = 1

# Months (UTC) of each season flag.
SEASON_MONTHS = {
    "is_winter": (12, 1, 2),
    "is_spring": (3, 4, 5),
    "is_summer": (6, 7, 8),
    "is_autumn": (9, 10, 11),
}
