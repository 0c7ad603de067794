from __future__ import annotations

import math

import pytest
from conftest import ts
from pyspark.sql import functions as F

from gridcast.functions import convert as C


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(("f", "c"), [(32.0, 0.0), (212.0, 100.0), (-40.0, -40.0), (98.6, 37.0)])
def test_fahrenheit(spark, f, c):
    assert one(spark, C.fahrenheit_to_celsius(F.lit(f))) == pytest.approx(c)


def test_linear_units(spark):
    values = {
        C.kelvin_to_celsius: (273.15, 0.0),
        C.rate_to_mm_per_hour: (0.001, 3.6),
        C.knots_to_ms: (1.0, 0.514444),
        C.inches_mercury_to_hpa: (29.92, 1013.2075),
        C.inches_to_mm: (2.0, 50.8),
        C.miles_to_m: (10.0, 16093.44),
        C.kilometres_to_m: (1.5, 1500.0),
    }
    for convert, (given, expected) in values.items():
        assert one(spark, convert(F.lit(given))) == pytest.approx(expected, rel=1e-5)
        assert one(spark, convert(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize(("u", "v", "bearing"), [(1, 0, 270), (-1, 0, 90), (0, 1, 180), (0, -1, 0), (1, 1, 225)])
def test_wind_direction_is_where_it_blows_from(spark, u, v, bearing):
    assert one(spark, C.wind_direction(F.lit(float(u)), F.lit(float(v)))) == pytest.approx(bearing)
    assert one(spark, C.wind_speed(F.lit(3.0), F.lit(4.0))) == pytest.approx(5.0)


def test_sky_cover(spark):
    assert one(spark, C.sky_cover_pct(F.lit(" bkn "))) == 75.0
    assert one(spark, C.sky_cover_pct(F.lit("???"))) is None
    layers = spark.createDataFrame([("FEW", "OVC"), ("SCT", None), ("X", None)], "a string, b string")
    assert [r[0] for r in layers.select(C.total_sky_cover(["a", "b"])).collect()] == [100.0, 43.75, None]


def test_quality_code(spark):
    rows = [("4.0",), (" 5 ",), ("A",), (None,), ("1.5",)]
    out = spark.createDataFrame(rows, "c string").select(C.quality_code("c")).collect()
    assert [r[0] for r in out] == ["4", "5", "A", None, "1.5"]
    floats = spark.createDataFrame([(4.0,)], "c double").select(C.quality_code("c")).first()[0]
    assert floats == "4"


def test_number_and_instant_never_fail(spark):
    rows = [("QCF", "2026-01-01T00:51Z"), ("1.5", "2026-01-01 00:51:02+00:00"), ("NaN", "nonsense"), (None, "2026-01-01T02:00:00-05:00")]
    out = spark.createDataFrame(rows, "n string, t string").select(C.number("n"), C.instant("t")).collect()
    assert [r[0] for r in out] == [None, 1.5, None, None]
    assert [r[1] for r in out] == [ts("2026-01-01T00:51:00"), ts("2026-01-01T00:51:02"), None, ts("2026-01-01T07:00:00")]


def test_local_clock_repeats_an_hour_in_autumn(spark):
    rows = [(ts("2024-11-03T04:00:00"),), (ts("2024-11-03T05:00:00"),), (ts("2024-11-03T06:00:00"),), (ts("2024-11-03T07:00:00"),)]
    df = spark.createDataFrame(rows, "t timestamp")
    local = [r[0] for r in df.select(C.to_local("t", "America/New_York")).collect()]
    assert len(set(local)) == 3
    text = [r[0] for r in df.select(C.iso_local("t", "America/New_York")).collect()]
    assert text[1:3] == ["2024-11-03T01:00:00-04:00", "2024-11-03T01:00:00-05:00"]
    assert df.select(C.iso_utc("t")).first()[0] == "2024-11-03T04:00:00Z"


def test_run_texts(spark):
    at = F.lit(ts("2026-09-16T12:00:00"))
    assert one(spark, C.run_slug(at)) == "20260916T1200Z"
    assert one(spark, C.lead_label(F.lit(7))) == "f007"


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")
    assert C.nan_to_null(df).first() == (None, 1.0)


def test_sql_functions(spark):
    C.register_sql(spark)
    row = spark.sql("SELECT wind_direction(1.0D, 0.0D) a, sky_cover_pct(' ovc') b").first()
    assert row["a"] == pytest.approx(270.0) and row["b"] == 100.0
    hours = spark.sql("SELECT * FROM hour_grid(TIMESTAMP '2026-01-01 00:00:00', TIMESTAMP '2026-01-01 03:00:00')")
    assert hours.count() == 3
    assert math.isclose(one(spark, C.wind_speed(F.lit(0.0), F.lit(0.0))), 0.0)
