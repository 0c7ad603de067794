from __future__ import annotations

from datetime import timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import hourly, ts
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gridcast.operators import align as A
from gridcast.operators.scan import following, positions
from gridcast.operators.screen import Rule, Screen, flag_name, total_masked

START, END = F.lit, F.lit


def bounds(a, b):
    return F.lit(ts(a)), F.lit(ts(b))


def test_last_known_value_wins_per_measure(frame):
    rows = [
        ("s", "A", ts("2026-01-01T00:10:00"), 1.0, 5.0),
        ("s", "A", ts("2026-01-01T00:51:00"), 2.0, None),
        ("s", "A", ts("2026-01-01T05:00:00"), 9.0, 9.0),
    ]
    df = frame(rows, "source string, station_id string, timestamp_utc timestamp, temperature_c double, dewpoint_c double")
    out = A.align(df, *bounds("2026-01-01T00:00:00", "2026-01-01T04:00:00")).orderBy("timestamp_utc").collect()
    assert len(out) == 4
    assert (out[0]["temperature_c"], out[0]["dewpoint_c"]) == (2.0, 5.0)
    assert all(r["temperature_c"] is None for r in out[1:])


def test_equal_times_follow_arrival(frame):
    rows = [("s", "A", ts("2026-01-01T00:10:00"), v, i) for i, v in enumerate((1.0, 2.0, None))]
    df = frame(rows, "source string, station_id string, timestamp_utc timestamp, temperature_c double, seq long")
    assert A.collapse(df, ["temperature_c"], tiebreak=["seq"]).first()["temperature_c"] == 2.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ABC"), st.integers(0, 47), st.floats(-20, 40)), min_size=1, max_size=30))
def test_grid_has_every_station_hour(spark, rows):
    base = ts("2026-01-01T00:00:00")
    df = spark.createDataFrame([("s", s, base + timedelta(hours=h), v) for s, h, v in rows], "source string, station_id string, timestamp_utc timestamp, temperature_c double")
    out = A.align(df, F.lit(base), F.lit(base + timedelta(hours=24)))
    assert out.count() == len({r[0] for r in rows}) * 24


def test_sources_coalesce_in_order(frame):
    first = hourly("2026-01-01T00:00:00", [1.0, None, None, 4.0], source="p")
    second = hourly("2026-01-01T00:00:00", [9.0, 2.0, None, 9.0], source="q")
    third = hourly("2026-01-01T00:00:00", [7.0, 7.0, 7.0, 7.0], source="other")
    panel = frame(first + second + third)
    start, end = bounds("2026-01-01T00:00:00", "2026-01-01T05:00:00")
    out = A.target_series(panel, "A", ("p", "q"), start, end, "America/New_York").orderBy("timestamp_utc").collect()
    assert [r["temperature_c"] for r in out] == [1.0, 2.0, None, 4.0, None]
    assert [r["temperature_source"] for r in out] == ["p", "q", None, "p", None]
    assert out[0]["timestamp_local"] == ts("2025-12-31T19:00:00")
    cover = A.coverage(A.target_series(panel, "A", ("p", "q"), start, end, "UTC")).first()
    assert (cover["covered_hours"], cover["hours"]) == (3, 5)


def masked(screen, df, column="temperature_c"):
    return [r[column] for r in screen.apply(df).orderBy("source", "station_id", "timestamp_utc").collect()]


def test_ranges_are_inclusive(frame):
    df = frame(hourly("2026-01-01T00:00:00", [-30.0, 50.0, 50.1, 999.0, None]))
    assert masked(Screen(flatline=()), df) == [-30.0, 50.0, None, None, None]


def test_dewpoint_rule_masks_dewpoint_only(frame):
    base = ts("2026-01-01T00:00:00")
    rows = [("s", "A", base, 10.0, 10.5), ("s", "A", base + timedelta(hours=1), 10.0, 10.6), ("s", "A", base + timedelta(hours=2), None, 10.0)]
    df = frame(rows, "source string, station_id string, timestamp_utc timestamp, temperature_c double, dewpoint_c double")
    out = Screen(flatline=()).apply(df).orderBy("timestamp_utc").collect()
    assert [r["dewpoint_c"] for r in out] == [10.5, None, 10.0]
    assert [r["temperature_c"] for r in out] == [10.0, 10.0, None]


def test_long_runs_are_masked_short_ones_kept(frame):
    values = [5.0] * 30 + [6.0] * 21 + [7.0] * 24 + [None] + [7.0] * 23
    out = masked(Screen(), frame(hourly("2026-01-01T00:00:00", values)))
    assert out[:30] == [None] * 30 and out[30:51] == [6.0] * 21
    assert out[51:75] == [None] * 24 and out[76:] == [7.0] * 23


def test_runs_do_not_cross_stations(frame):
    df = frame(hourly("2026-01-01T00:00:00", [5.0] * 12, "A") + hourly("2026-01-01T12:00:00", [5.0] * 12, "B"))
    assert masked(Screen(), df) == [5.0] * 24


def brute_flatline(values, minimum):
    s = pd.Series(values, dtype="float64")
    run = s.ne(s.shift()).cumsum()
    return (s.notna() & (s.groupby(run).transform("size") >= minimum)).tolist()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([1.0, 2.0, None]), min_size=1, max_size=90), st.integers(2, 6), st.integers(3, 20))
def test_blocks_do_not_change_runs(spark, values, minimum, block):
    df = spark.createDataFrame(hourly("2026-01-01T00:00:00", values), "source string, station_id string, timestamp_utc timestamp, temperature_c double")
    screen = Screen(ranges={}, dewpoint_tolerance=None, flatline=("temperature_c",), flatline_hours=minimum, block_hours=block)
    name = flag_name("flatline", "temperature_c")
    got = [r[name] for r in screen.flag(df).orderBy("timestamp_utc").collect()]
    assert got == brute_flatline(values, minimum)


def test_screening_is_idempotent_and_adds_nothing(frame):
    rng = np.random.default_rng(5)
    values = [None if x < 0.1 else float(np.round(x * 120 - 40)) for x in rng.random(200)]
    df = frame(hourly("2026-01-01T00:00:00", values))
    screen = Screen(flatline_hours=3)
    once = screen.apply(df)
    assert masked(screen, df) == masked(screen, once)
    assert once.count() == df.count()


def test_report_counts_by_rule(frame):
    df = frame(hourly("2026-01-01T00:00:00", [999.0, 1.0, 2.0], "A") + hourly("2026-01-01T00:00:00", [5.0] * 24, "B"))
    screen = Screen()
    report = screen.report(screen.flag(df))
    rows = {(r["rule"], r["station_id"], r["column"]): r["masked"] for r in report.collect()}
    assert rows == {("range", "A", "temperature_c"): 1, ("flatline", "B", "temperature_c"): 24}
    assert total_masked(report).first()["masked"] == 25


def test_rules_see_earlier_masks_and_can_be_added(frame):
    extra = (Rule("odd", "temperature_c", lambda: F.col("temperature_c") % 2 == 1),)
    df = frame(hourly("2026-01-01T00:00:00", [999.0, 3.0, 4.0]))
    screen = Screen(flatline=(), extra=extra)
    assert masked(screen, df) == [None, None, 4.0]
    assert {(r["rule"], r["masked"]) for r in screen.report(screen.flag(df)).collect()} == {("range", 1), ("odd", 1)}


def test_positions_and_following_across_blocks(spark):
    base = ts("2026-01-01T00:00:00")
    rows = [(k, base + timedelta(hours=int(h)), int(h) * 10) for k in ("A", "B") for h in np.random.default_rng(1).permutation(100)[:60]]
    df = spark.createDataFrame(rows, "k string, t timestamp, o long")
    placed = positions(df, ["k"], "t", block_hours=7).toPandas().sort_values(["k", "t"])
    for _, part in placed.groupby("k"):
        assert part["position"].tolist() == list(range(60))
    nxt = following(df, ["k"], "o", "n", 70).toPandas().sort_values(["k", "o"])
    for _, part in nxt.groupby("k"):
        assert part["n"].tolist()[:-1] == part["o"].tolist()[1:] and pd.isna(part["n"].iloc[-1])


def test_sql_reference_for_runs(frame):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2, 400).astype(float).tolist()
    df = frame(hourly("2026-01-01T00:00:00", values))
    screen = Screen(ranges={}, dewpoint_tolerance=None, flatline=("temperature_c",), flatline_hours=5, block_hours=24)
    got = screen.flag(df).toPandas().sort_values("timestamp_utc")[flag_name("flatline", "temperature_c")].tolist()
    pdf = pd.DataFrame({"i": range(400), "v": values})
    con = duckdb.connect()
    con.register("p", pdf)
    expected = con.execute("""
      WITH m AS (SELECT *, CASE WHEN v = lag(v) OVER (ORDER BY i) THEN 0 ELSE 1 END s FROM p), r AS (SELECT *, sum(s) OVER (ORDER BY i) g FROM m)
      SELECT count(*) OVER (PARTITION BY g) >= 5 AS f FROM r ORDER BY i""").fetchall()
    assert got == [r[0] for r in expected]
    assert pytest.approx(sum(got)) == sum(r[0] for r in expected)
