"""Column expressions: coercion, unit conversion, code lookups and clocks.

Every function maps ``Column -> Column`` with built-in expressions only, so it
stays inside whole-stage code generation and a null input gives a null output.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridcast.functions.vocabulary import SKY_COVER_PCT

# Unit conversion factors.
KNOT_MS = 1852.0 / 3600.0
INCH_MERCURY_HPA = 33.863886667
INCH_MM = 25.4
MILE_M = 1609.344
KILOMETRE_M = 1000.0
ZERO_CELSIUS_K = 273.15
HOUR_SECONDS = 3600.0


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(raw: Column | str) -> Column:
    """Coerce to double; unreadable text and NaN become null."""
    value = _col(raw).try_cast("double")
    return F.when(~F.isnan(value), value)


def instant(raw: Column | str) -> Column:
    """Parse ISO text to a UTC instant; seconds and fractions are optional, bad text is null."""
    text = F.trim(_col(raw).cast("string"))
    zoned = "yyyy-MM-dd['T'][' ']HH:mm[:ss][.SSSSSS][.SSS]XXX"
    plain = "yyyy-MM-dd['T'][' ']HH:mm[:ss][.SSSSSS][.SSS]"
    return F.coalesce(
        F.try_to_timestamp(text, F.lit(zoned)),
        F.try_to_timestamp(text, F.lit(plain)),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
    )


def hour_floor(ts: Column | str) -> Column:
    return F.date_trunc("hour", _col(ts))


def fahrenheit_to_celsius(v: Column) -> Column:
    return (v - 32.0) * 5.0 / 9.0


def kelvin_to_celsius(v: Column) -> Column:
    return v - ZERO_CELSIUS_K


def rate_to_mm_per_hour(v: Column) -> Column:
    """One kilogram of water per square metre is one millimetre deep."""
    return v * HOUR_SECONDS


def knots_to_ms(v: Column) -> Column:
    return v * KNOT_MS


def inches_mercury_to_hpa(v: Column) -> Column:
    return v * INCH_MERCURY_HPA


def inches_to_mm(v: Column) -> Column:
    return v * INCH_MM


def miles_to_m(v: Column) -> Column:
    return v * MILE_M


def kilometres_to_m(v: Column) -> Column:
    return v * KILOMETRE_M


def wind_speed(eastward: Column | str, northward: Column | str) -> Column:
    return F.hypot(_col(eastward), _col(northward))


def wind_direction(eastward: Column | str, northward: Column | str) -> Column:
    """Bearing the wind blows from: 270 is a westerly."""
    return F.pmod(270.0 - F.degrees(F.atan2(_col(northward), _col(eastward))), F.lit(360.0))


def sky_cover_pct(code: Column | str) -> Column:
    """Percent of sky for one layer code; an unknown code is null, never clear sky."""
    entries = [F.lit(item) for pair in SKY_COVER_PCT.items() for item in pair]
    return F.try_element_at(F.create_map(*entries), F.upper(F.trim(_col(code))))


def total_sky_cover(codes: list[str]) -> Column:
    """Layers are cumulative, so the largest readable layer is the total."""
    layers = [sky_cover_pct(code) for code in codes]
    return layers[0] if len(layers) == 1 else F.greatest(*layers)


def quality_code(raw: Column | str) -> Column:
    """Code as trimmed text, with a float-typed ``4.0`` read as ``4``."""
    text = F.trim(_col(raw).cast("string"))
    value = number(text)
    whole = value.isNotNull() & (value % 1 == 0) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("long").cast("string")).otherwise(text)


def to_local(ts: Column | str, zone: str) -> Column:
    """Wall clock of ``zone`` as a timestamp without zone."""
    ntz = _col(ts).cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ntz)


def iso_utc(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_local(ts: Column | str, zone: str) -> Column:
    """Local wall clock with its UTC offset, so the repeated autumn hour stays distinct."""
    utc = _col(ts).cast("timestamp_ntz")
    local = to_local(ts, zone)
    minutes = F.timestamp_diff("MINUTE", utc, local)
    size = F.abs(minutes)
    offset = F.concat(
        F.when(minutes < 0, "-").otherwise("+"),
        F.lpad((size / 60).cast("int").cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def run_slug(init: Column | str) -> Column:
    return F.date_format(_col(init), "yyyyMMdd'T'HHmm'Z'")


def lead_label(lead: Column | str) -> Column:
    return F.concat(F.lit("f"), F.lpad(_col(lead).cast("string"), 3, "0"))


def epoch_hours(ts: Column | str) -> Column:
    """Whole hours since the epoch, the integer clock used for blocks and frames."""
    return F.floor(F.unix_seconds(_col(ts)) / 3600).cast("long")


def hours_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("HOUR", _col(start), _col(end))


def plus_hours(ts: Column | str, hours: Column | int) -> Column:
    n = F.lit(hours) if isinstance(hours, int) else hours
    return F.timestamp_add("HOUR", n.cast("int"), _col(ts))


def nan_to_null(df, columns=None):
    """NaN is missing everywhere here, and Spark would sort it above every number."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    wanted = set(columns) if columns is not None else set(names)
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names if n in wanted})


def register_sql(spark) -> None:
    """SQL names for the column functions, as temporary SQL functions (no Python at run time)."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION wind_direction(eastward DOUBLE, northward DOUBLE) RETURNS DOUBLE "
        "RETURN pmod(270 - degrees(atan2(northward, eastward)), 360)"
    )
    entries = ", ".join(f"'{code}', {pct}D" for code, pct in SKY_COVER_PCT.items())
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION sky_cover_pct(code STRING) RETURNS DOUBLE "
        f"RETURN try_element_at(map({entries}), upper(trim(code)))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION hour_grid(start_at TIMESTAMP, end_at TIMESTAMP) RETURNS TABLE (hour TIMESTAMP) "
        "RETURN SELECT explode(sequence(start_at, end_at - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS hour"
    )
