from __future__ import annotations

from itertools import accumulate

from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import ts
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gridcast.functions.vocabulary import CUTOFF, DS, FOLDS
from gridcast.operators import covariates as V
from gridcast.operators import folds as O
from gridcast.operators import panel as P
from gridcast.operators.contracts import check_features, check_holdout, check_order, unmatched_keys, violations
from gridcast.operators.intervals import in_window

RUN = "source string, station_id string, init_time_utc timestamp, valid_time_utc timestamp, lead_hours int, TMP double, DPT double, UGRD double, VGRD double, TCDC double, PRATE double"
INIT = "2026-01-01T12:00:00"


def raw_run(spark, leads, station="A", init=INIT, **fields):
    start = ts(init)
    names = ("TMP", "DPT", "UGRD", "VGRD", "TCDC", "PRATE")
    defaults = {"TMP": 280.0, "DPT": 275.0, "UGRD": 1.0, "VGRD": 0.0, "TCDC": 50.0, "PRATE": 0.0}
    rows = []
    for i, lead in enumerate(leads):
        values = [(fields[n][i] if n in fields else defaults[n]) for n in names]
        rows.append(("g", station, start, start + timedelta(hours=lead), lead, *values))
    return spark.createDataFrame(rows, RUN)


def test_run_is_filled_hourly_and_flagged(spark):
    panel, report = P.clean_forecasts(raw_run(spark, [0, 3], TMP=[280.15, 283.15]))
    rows = panel.orderBy("valid_time_utc").collect()
    assert [r["lead_hours"] for r in rows] == [0, 1, 2, 3]
    assert [round(r["temperature_c"], 9) for r in rows] == [7.0, 8.0, 9.0, 10.0]
    assert [r["interpolated"] for r in rows] == [False, True, True, False]
    assert report.count() == 0


def test_runs_are_not_extrapolated_or_mixed(spark):
    both = raw_run(spark, [0, 2]).unionByName(raw_run(spark, [1, 3], station="B")).unionByName(raw_run(spark, [5], init="2026-01-02T12:00:00"))
    out = P.to_hourly(P.normalize_runs(both)).groupBy("station_id", "init_time_utc").count().collect()
    assert sorted(r["count"] for r in out) == [1, 3, 3]


def test_missing_field_is_filled_inside_only(spark):
    rows = P.to_hourly(P.normalize_runs(raw_run(spark, [0, 1, 2, 3], TMP=[None, 274.15, None, 276.15]))).orderBy("valid_time_utc").collect()
    assert [r["temperature_c"] if r["temperature_c"] is None else round(r["temperature_c"], 6) for r in rows] == [None, 1.0, 2.0, 3.0]
    tail = P.to_hourly(P.normalize_runs(raw_run(spark, [0, 1, 2], TMP=[274.15, None, None]))).orderBy("valid_time_utc").collect()
    assert [r["temperature_c"] is None for r in tail] == [False, True, True]


def test_wind_crosses_north(spark):
    # 350 and 10 degrees: the midpoint must be north, not south.
    a, b = np.radians(350), np.radians(10)
    u, v = [-np.sin(a), -np.sin(b)], [-np.cos(a), -np.cos(b)]
    panel, _ = P.clean_forecasts(raw_run(spark, [0, 2], UGRD=[float(x) for x in u], VGRD=[float(x) for x in v]))
    mid = panel.filter("lead_hours = 1").first()["wind_direction_deg"]
    assert min(mid, 360 - mid) < 1e-6


def test_forecasts_keep_flat_stretches_and_lose_impossible_values(spark):
    panel, report = P.clean_forecasts(raw_run(spark, list(range(48)), TMP=[9999.0] + [280.0] * 47))
    rows = panel.orderBy("lead_hours").collect()
    assert rows[0]["temperature_c"] is None and all(r["temperature_c"] is not None for r in rows[1:])
    assert [(r["rule"], r["masked"]) for r in report.collect()] == [("range", 1)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 40), st.one_of(st.none(), st.floats(250, 310)), min_size=1, max_size=12))
def test_filled_values_match_pandas(spark, published):
    leads = sorted(published)
    raw = raw_run(spark, leads, TMP=[published[k] for k in leads])
    got = P.to_hourly(P.normalize_runs(raw)).toPandas().sort_values("lead_hours")["temperature_c"].to_numpy(dtype="float64")
    s = pd.Series([published[k] for k in leads], index=pd.to_datetime([ts(INIT) + timedelta(hours=k) for k in leads]), dtype="float64") - 273.15
    s = s.reindex(pd.date_range(s.index.min(), s.index.max(), freq="h")).interpolate(method="time", limit_area="inside")
    np.testing.assert_allclose(got, s.to_numpy(), atol=1e-9, equal_nan=True)


PANEL = "station_id string, init_time_utc timestamp, valid_time_utc timestamp, lead_hours int, temperature_c double, dewpoint_c double, wind_speed_ms double, wind_direction_deg double, cloud_cover_pct double, precipitation_mm double, interpolated boolean"


def panel_rows(init, first, n, value, dew=1.0, station="A"):
    start, valid = ts(init), ts(first)
    out = []
    for i in range(n):
        at = valid + timedelta(hours=i)
        lead = int((at - start).total_seconds() // 3600)
        out.append((station, start, at, lead, float(value), dew, 2.0, 90.0, 50.0, 0.0, False))
    return out


def folds_of(spark, *cutoffs, station="A", name="rolling"):
    return spark.createDataFrame([(station, name, ts(c)) for c in cutoffs], "station_id string, folds string, cutoff timestamp")


@pytest.fixture(scope="module")
def panel(spark):
    rows = panel_rows("2026-01-01T12:00:00", "2026-01-02T00:00:00", 48, 1.0)
    rows += panel_rows("2026-01-02T12:00:00", "2026-01-03T00:00:00", 48, 2.0, dew=None)
    rows += panel_rows("2026-01-05T12:00:00", "2026-01-05T12:00:00", 48, 3.0)
    return spark.createDataFrame(rows, PANEL)


def test_freshest_run_wins_and_late_runs_are_refused(spark, panel):
    cutoff = F.lit(ts("2026-01-03T00:00:00"))
    rows = V.forecast_at(panel, cutoff, 48).orderBy("valid_time_utc").collect()
    assert len(rows) == 48 and {r["gfs_temperature_c"] for r in rows} == {2.0}
    # Column by column: the newer run lacks the dew point, the older one supplies it where it reaches.
    assert [r["gfs_dewpoint_c"] for r in rows] == [1.0] * 24 + [None] * 24
    assert {r["init_time_utc"] for r in rows} == {ts("2026-01-02T12:00:00")}
    at_noon = V.forecast_at(panel, F.lit(ts("2026-01-02T12:00:00")), 24).collect()
    assert {r["gfs_temperature_c"] for r in at_noon} == {1.0}
    with pytest.raises(ValueError):
        V.require_forecast(panel, F.lit(ts("2026-01-01T12:00:00")))


def test_many_folds_equal_one_by_one(spark, panel):
    cutoffs = ["2026-01-02T06:00:00", "2026-01-03T00:00:00", "2026-01-03T13:00:00", "2026-01-05T12:00:00", "2026-01-05T13:00:00"]
    at_once = V.forecast_window(panel, folds_of(spark, *cutoffs), 24).toPandas()
    for c in cutoffs:
        single = V.forecast_at(panel, F.lit(ts(c)), 24).toPandas().sort_values("valid_time_utc").reset_index(drop=True)
        part = at_once[at_once[CUTOFF] == pd.Timestamp(c)].sort_values("valid_time_utc").reset_index(drop=True)
        pd.testing.assert_frame_equal(part[single.columns], single)


def test_whole_row_freshest_keeps_nulls(spark, panel):
    rows = V.freshest_rows(panel, ("station_id", "valid_time_utc")).filter("init_time_utc = '2026-01-02 12:00:00'")
    assert rows.count() == 48 and rows.filter("dewpoint_c IS NOT NULL").count() == 0


TARGET = "station_id string, timestamp_utc timestamp, temperature_c double"


def target_rows(first, n, value=0.0, station="A"):
    return [(station, ts(first) + timedelta(hours=i), value) for i in range(n)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 120))
def test_no_pair_at_or_after_its_cutoff(spark, panel, shift):
    cutoff = ts("2026-01-01T12:00:00") + timedelta(hours=shift)
    target = spark.createDataFrame(target_rows("2026-01-01T00:00:00", 200), TARGET)
    pairs = V.training_pairs(panel, target, F.lit(cutoff))
    assert pairs.filter((F.col("init_time_utc") >= F.lit(cutoff)) | (F.col("valid_time_utc") >= F.lit(cutoff))).count() == 0


def test_pairs_need_a_reading(spark, panel):
    rows = target_rows("2026-01-02T00:00:00", 10, 5.0)
    rows[3] = ("A", rows[3][1], None)
    pairs = V.training_pairs(panel, spark.createDataFrame(rows, TARGET), F.lit(ts("2026-02-01T00:00:00")))
    assert pairs.count() == 9
    assert {r["e"] for r in pairs.select(V.forecast_error().alias("e")).collect()} == {-4.0}


def test_attach(spark, panel):
    history = spark.createDataFrame([(s, t, v) for s, t, v in target_rows("2026-01-01T22:00:00", 6, 1.0)], "station_id string, ds timestamp, y double")
    joined = V.attach_available(history, panel).orderBy("ds").collect()
    assert [r["gfs_temperature_c"] for r in joined] == [None, None, 1.0, 1.0, 1.0, 1.0]
    window = V.forecast_at(panel, F.lit(ts("2026-01-02T00:00:00")), 24)
    with pytest.raises(ValueError, match="2 of 6"):
        V.attach_complete(history, window)
    assert V.attach_complete(history.filter("ds >= '2026-01-02'"), window).count() == 4


def test_covered_folds_need_every_hour_and_value(spark, panel):
    folds = folds_of(spark, "2026-01-02T00:00:00", "2026-01-03T00:00:00", "2026-01-04T00:00:00", "2026-01-05T13:00:00", "2026-01-01T00:00:00")
    got = {r[CUTOFF] for r in V.covered_folds(panel, folds, 24).collect()}
    assert got == {ts("2026-01-02T00:00:00"), ts("2026-01-03T00:00:00"), ts("2026-01-05T13:00:00")}


def test_trainable_needs_a_span(spark):
    # Coverage alone does not train a fold: its usable history must span the period.
    rows = panel_rows("2026-01-01T00:00:00", "2026-01-02T00:00:00", 24, 1.0) + panel_rows("2026-01-11T00:00:00", "2026-01-12T00:00:00", 72, 1.0)
    panel = spark.createDataFrame(rows, PANEL)
    history = spark.createDataFrame(target_rows("2026-01-01T00:00:00", 24 * 20, 1.0), "station_id string, ds timestamp, y double")
    folds = folds_of(spark, "2026-01-02T00:00:00", "2026-01-12T00:00:00", "2026-01-13T00:00:00", "2026-01-14T00:00:00")
    got = {r[CUTOFF] for r in V.trainable_folds(history, panel, folds, 24, 10).collect()}
    assert got == {ts("2026-01-13T00:00:00"), ts("2026-01-14T00:00:00")}
    span = {r[CUTOFF]: r["usable_hours"] for r in V.usable_span(history, panel, folds).collect()}
    assert span[ts("2026-01-12T00:00:00")] == 24 and span[ts("2026-01-13T00:00:00")] == 48


def history_of(spark, first, hours, step=1):
    return spark.createDataFrame([("A", ts(first) + timedelta(hours=i * step), 1.0) for i in range(hours)], "station_id string, ds timestamp, y double")


def test_rolling_cutoffs(spark):
    h = history_of(spark, "2020-01-01T00:00:00", 2000, 24)
    got = [r[CUTOFF] for r in O.rolling_cutoffs(h, ("station_id",), step_hours=24).orderBy(CUTOFF).collect()]
    expected = pd.date_range("2020-12-31", pd.Timestamp("2020-01-01") + pd.Timedelta(days=2000 - 14), freq="14D")
    assert got == [t.to_pydatetime() for t in expected]
    assert O.rolling_cutoffs(history_of(spark, "2020-01-01T00:00:00", 370, 24), ("station_id",), step_hours=24).count() == 0


@pytest.mark.parametrize("cutoff", ["2025-06-25T00:00:00", "2024-02-29T00:00:00"])
def test_seasonal_cutoffs(spark, cutoff):
    h = history_of(spark, "2015-06-01T00:00:00", 3650, 24)
    got = [r[CUTOFF] for r in O.seasonal_cutoffs(h, F.lit(ts(cutoff)), ("station_id",), step_hours=24).orderBy(CUTOFF).collect()]
    first, end = pd.Timestamp("2015-06-01"), pd.Timestamp("2015-06-01") + pd.Timedelta(days=3650)
    # One step of a year at a time: a leap day stays on the 28th from then on.
    steps = list(accumulate(range(12), lambda at, _: at - pd.DateOffset(years=1), initial=pd.Timestamp(cutoff)))[1:]
    fits = [s for s in steps if (s - first).days >= 365 and (end - s) >= pd.Timedelta(days=14)]
    assert got == [s.to_pydatetime() for s in reversed(fits)] and len(got) > 5


def test_split_and_future(spark):
    h = history_of(spark, "2026-01-01T00:00:00", 10)
    before, after = O.split(h, F.lit(ts("2026-01-01T04:00:00")))
    assert (before.count(), after.count()) == (4, 6)
    ahead = O.future_frame(folds_of(spark, "2026-01-02T00:00:00"), 5).select(DS).collect()
    assert [r[DS] for r in ahead] == [ts("2026-01-02T00:00:00") + timedelta(hours=i) for i in range(5)]


def test_segments_and_totals_equal_per_fold_scans(spark):
    rng = np.random.default_rng(3)
    rows = [(s, ts("2026-01-01T00:00:00") + timedelta(hours=int(h)), float(v)) for s in "AB" for h, v in zip(rng.permutation(3000)[:900], rng.normal(size=900))]
    h = spark.createDataFrame(rows, "station_id string, ds timestamp, y double")
    cutoffs = ["2026-01-03T05:00:00", "2026-01-17T00:00:00", "2026-01-17T01:00:00", "2026-03-30T00:00:00"]
    folds = folds_of(spark, *cutoffs).unionByName(folds_of(spark, *cutoffs[1:3], station="B", name="other"))
    stats = O.assign_segments(h, folds, ("station_id",)).groupBy("station_id", FOLDS, O.SEGMENT).agg(
        F.sum("y").alias("s"), F.count("y").alias("n"), F.min("ds").alias("a"), F.max("ds").alias("b")
    )
    got = O.fold_totals(stats, folds, ("station_id",), ("s", "n"), ("a",), ("b",)).toPandas()
    assert len(got) == 6
    pdf = pd.DataFrame(rows, columns=["station_id", "ds", "y"])
    for r in got.itertuples():
        part = pdf[(pdf.station_id == r.station_id) & (pdf.ds < r.cutoff)]
        assert r.n == len(part) and r.s == pytest.approx(part.y.sum()) and r.a == part.ds.min() and r.b == part.ds.max()


def test_position_folds_expand(spark):
    h = history_of(spark, "2026-01-01T00:00:00", 50)
    folds, validation = O.position_folds(h, 20, 10, 7, ("station_id",))
    origins = sorted(r["origin"] for r in folds.collect())
    assert origins == [20, 27, 34]
    rows = validation.toPandas()
    for o in origins:
        assert sorted(rows[rows.origin == o].position) == list(range(o, o + 10))
    with pytest.raises(ValueError):
        O.position_folds(h, 0, 10)
    with pytest.raises(ValueError):
        O.position_folds(h, 5, 0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 60)), min_size=1, max_size=10), st.integers(1, 50))
def test_window_join_equals_brute_force(spark, windows, bucket):
    base = ts("2026-01-01T00:00:00")
    points = spark.createDataFrame([(i, base + timedelta(hours=i)) for i in range(0, 240, 3)], "i int, t timestamp")
    w = spark.createDataFrame([(k, base + timedelta(hours=a), base + timedelta(hours=a + n)) for k, (a, n) in enumerate(windows)], "k int, a timestamp, b timestamp")
    got = {(r["i"], r["k"]) for r in in_window(points, w, "t", "a", "b", bucket_hours=bucket).select("i", "k").collect()}
    assert got == {(i, k) for i in range(0, 240, 3) for k, (a, n) in enumerate(windows) if a <= i < a + n}


def test_contracts(spark):
    df = spark.createDataFrame([(1.0, None, "x", 1), (float("inf"), 2.0, "y", 2)], "a double, b double, c string, d int")
    found = {r["column"]: (r["missing"], r["infinite"]) for r in violations(df, ["a", "b"], "d").collect()}
    assert found == {"a": (0, 1), "b": (1, 0), "d": (0, 0)}
    with pytest.raises(ValueError, match="nfinite"):
        check_features(df, ["a"], "d")
    with pytest.raises(TypeError, match="non-numeric"):
        check_features(df, ["c"])
    with pytest.raises(ValueError, match="unique"):
        check_features(df, ["b", "b"])
    with pytest.raises(ValueError, match="target-derived"):
        check_features(df.withColumn("temperature_c", F.lit(1.0)), ["temperature_c"])
    with pytest.raises(ValueError, match="issing"):
        check_features(df, ["d"], "b")
    with pytest.raises(ValueError, match="no rows"):
        check_features(df.limit(0), ["d"])
    assert check_features(df, ["b"], "d") == 2
    with pytest.raises(ValueError, match="order"):
        check_order(["a", "b"], ["b", "a"])
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert {tuple(r) for r in unmatched_keys(a, b, ["k"]).collect()} == {(1, "left"), (3, "right")}


def test_holdout_must_be_later(spark):
    def times(*hours):
        return spark.createDataFrame([(ts("2026-01-01T00:00:00") + timedelta(hours=h),) for h in hours], "t timestamp")

    check_holdout(times(1, 2), times(3, 4), "t")
    for bad in ((times(1, 1), times(3)), (times(1, 3), times(3)), (times(1, 5), times(3, 4)), (times(1), times(3, 3))):
        with pytest.raises(ValueError):
            check_holdout(*bad, "t")


def test_holdout_is_checked_per_series(spark):
    def times(*rows):
        return spark.createDataFrame([(k, ts("2026-01-01T00:00:00") + timedelta(hours=h)) for k, h in rows], "k string, t timestamp")

    # The second series starts where the first one's validation ends.
    check_holdout(times(("a", 1), ("a", 2), ("b", 5)), times(("a", 3), ("b", 6)), "t", ("k",))
    for bad in (times(("a", 3), ("b", 5)), times(("a", 3), ("b", 4)), times(("a", 3), ("a", 3))):
        with pytest.raises(ValueError):
            check_holdout(times(("a", 1), ("a", 2), ("b", 5)), bad, "t", ("k",))
    check_holdout(times(), times(("a", 1)), "t", ("k",))


def test_latest_run_block(spark, panel):
    rows = V.latest_run_block(panel)
    assert rows.filter("is_validation").select("init_time_utc").distinct().collect()[0][0] == ts("2026-01-05T12:00:00")
    assert V.latest_run_block(panel, ("station_id",)).filter("is_validation").count() == 48
