from __future__ import annotations

import json
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import hourly, ts
from pyspark.sql import functions as F

from gridcast.functions.vocabulary import DS
from gridcast.operators import align as A
from gridcast.operators import covariates as V
from gridcast.operators.screen import Screen, flag_name
from gridcast.plans import jobs
from gridcast.plans.registry import Setup
from gridcast.session import shared_dir
from gridcast.sources import readers
from gridcast.streaming import streams as S

CONFIG = {
    "history": {"start_utc": "2026-01-01T00:00:00Z", "end_utc": "2026-01-01T04:00:00Z", "local_timezone": "America/New_York"},
    "airport_stations": [
        {"name": "one", "icao": "KAAA", "iem_id": "AAA", "ghcnh_id": "USW1", "latitude": 35.5, "longitude": -78.1},
        {"name": "two", "icao": "KBBB", "iem_id": "BBB", "ghcnh_id": "USW2", "latitude": 35.6, "longitude": -78.2},
    ],
    "econet_stations": [{"id": "FLD", "name": "field"}],
}
FILES = {
    "noaa_ghcnh": "station_id,timestamp_utc,temperature,temperature_Quality_Code,dew_point_temperature\nUSW1,2026-01-01T00:51:00Z,10.0,5,8.0\nUSW1,2026-01-01T01:51:00Z,999.0,5,8.0\nUSW2,2026-01-01T00:51:00Z,7.0,5,9.0\n",
    "iem_asos": "station_id,timestamp_utc,tmpf,skyc1\nAAA,2026-01-01T00:51:00Z,41.0,CLR\nAAA,2026-01-01T01:51:00Z,50.0,OVC\nAAA,2026-01-01T09:51:00Z,50.0,OVC\n",
    "open_meteo": "station_id,timestamp_utc,temperature_2m,cloud_cover\nUSW1,2026-01-01T00:00:00Z,9.5,20\n",
    "ncsco_econet": "station_id,timestamp_utc,var,value,score\nFLD,2026-01-01T00:00:00Z,airtemp2m|C,11.0,0\nFLD,2026-01-01T01:00:00Z,airtemp2m|C,QCF,3\n",
}


@pytest.fixture
def workspace(tmp_path):
    for name, text in FILES.items():
        (tmp_path / "raw" / name).mkdir(parents=True)
        (tmp_path / "raw" / name / "weather_x.csv").write_text(text)
    (tmp_path / "config.json").write_text(json.dumps(CONFIG))
    return tmp_path


def test_cleaning_end_to_end(spark, workspace):
    args = (spark, str(workspace / "config.json"), str(workspace / "raw"), str(workspace / "out"), "KAAA")
    paths = jobs.clean_observations(*args)
    panel = spark.read.parquet(paths["panel"])
    # Four hours for two, one, one and one stations of the four sources.
    assert {r["source"]: r["count"] for r in panel.groupBy("source").count().collect()} == {"noaa_ghcnh": 8, "iem_asos": 4, "open_meteo": 4, "ncsco_econet": 4}
    target = spark.read.parquet(paths["target"]).orderBy("timestamp_utc").collect()
    assert [r["temperature_c"] for r in target] == [10.0, 10.0, None, None]
    assert [r["temperature_source"] for r in target] == ["noaa_ghcnh", "iem_asos", None, None]
    assert target[0]["timestamp_local"] == ts("2025-12-31T19:00:00")
    report = {(r["rule"], r["source"], r["station_id"], r["column"]): int(r["masked"]) for r in spark.read.option("header", True).csv(paths["report"]).collect()}
    assert report == {
        ("range", "noaa_ghcnh", "KAAA", "temperature_c"): 1,
        ("dewpoint_above_temperature", "noaa_ghcnh", "KBBB", "dewpoint_c"): 1,
    }
    with pytest.raises(FileExistsError):
        jobs.clean_observations(*args)
    jobs.clean_observations(*args, sources=["noaa-ghcnh"], overwrite=True)
    assert spark.read.parquet(paths["panel"]).select("source").distinct().count() == 1
    with pytest.raises(ValueError, match="target source"):
        jobs.clean_observations(*args, sources=["open_meteo"], overwrite=True)


def test_ingest_lands_chosen_sources(spark, tmp_path):
    rows = spark.createDataFrame([("AAA", ts("2026-01-01T00:51:00"), 41.0), ("AAA", ts("2027-01-01T00:51:00"), 41.0)], "station_id string, timestamp_utc timestamp, tmpf double")
    paths = jobs.ingest(spark, {"iem_asos": rows}, str(tmp_path), "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z", ["iem-asos"])
    assert readers.latest_csv(spark, str(tmp_path), jobs.select_sources(["iem_asos"])[0]).count() == 1
    with pytest.raises(FileExistsError):
        jobs.ingest(spark, {"iem_asos": rows}, str(tmp_path), "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z", ["iem-asos"])
    with pytest.raises(ValueError, match="No landed rows"):
        jobs.ingest(spark, {}, str(tmp_path), "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z", ["iem-asos"])
    assert list(paths) == ["iem_asos"]


def truth(stamps):
    return 15 - 10 * np.cos(2 * np.pi * (stamps.dayofyear - 15) / 365.25) + 5 * np.sin(2 * np.pi * (stamps.hour - 14) / 24)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A year and a half of hourly readings and weekly two-week runs on disk."""
    root = tmp_path_factory.mktemp("world")
    stamps = pd.date_range("2024-01-01", periods=24 * 480, freq="h")
    noise = np.random.default_rng(0).normal(0, 0.5, len(stamps))
    target = pd.DataFrame({"timestamp_utc": stamps, "station_id": "KAAA", "temperature_c": truth(stamps) + noise})
    spark.createDataFrame(target, "timestamp_utc timestamp, station_id string, temperature_c double").write.parquet(f"{root}/target")
    folder = root / "runs"
    folder.mkdir()
    leads = list(range(0, 121, 6)) + list(range(123, 400, 3))
    for init in pd.date_range("2023-12-31 12:00", "2025-04-20", freq="7D"):
        at = init + pd.to_timedelta(leads, unit="h")
        rows = pd.DataFrame({"source": "g", "station_id": "KAAA", "init_time_utc": init.strftime("%Y-%m-%dT%H:%M:%SZ"), "valid_time_utc": at.strftime("%Y-%m-%dT%H:%M:%SZ"), "lead_hours": leads,
                             "TMP": truth(at) + 275.15, "DPT": 270.0, "UGRD": 1.0, "VGRD": 1.0, "TCDC": 50.0, "PRATE": 0.0})
        rows.to_csv(folder / f"gfs_{init:%Y%m%dT%H%MZ}.csv", index=False)
    return root


def test_forecast_jobs(spark, world):
    out = f"{world}/out"
    paths = jobs.clean_forecast_runs(spark, f"{world}/runs", out)
    panel = spark.read.parquet(paths["panel"])
    per_run = panel.groupBy("init_time_utc").count().select("count").distinct().collect()
    assert [r["count"] for r in per_run] == [400]
    with pytest.raises(FileExistsError):
        jobs.clean_forecast_runs(spark, f"{world}/runs", out)
    assert jobs.clean_forecast_runs(spark, f"{world}/runs", out, reuse=True) == paths
    deduped = spark.read.parquet(jobs.dedupe_panel(spark, paths["panel"], f"{out}/deduped"))
    assert deduped.count() == panel.select("valid_time_utc").distinct().count()
    assert deduped.groupBy("valid_time_utc").count().filter("count > 1").isEmpty()


def test_backtest_jobs(spark, world):
    out = f"{world}/backtest"
    panel = jobs.clean_forecast_runs(spark, f"{world}/runs", f"{world}/out", reuse=True)["panel"]
    cutoff = ts("2025-04-25T00:00:00")
    names = ("persistence", "climatology", "raw_gfs", "prophet_gfs", "linear_gfs")
    paths = jobs.covariate_backtest(spark, f"{world}/target", panel, out, cutoff, names)
    summary = jobs.read_summary(spark, paths["summary"]).toPandas()
    total = summary[summary.cutoff == "all"].set_index(["model", "folds"])
    assert total.loc[("raw_gfs", "rolling"), "bias_c"] == pytest.approx(2.0, abs=0.1)
    assert total.loc[("prophet_gfs", "rolling"), "mae_c"] < 0.6 < total.loc[("raw_gfs", "rolling"), "mae_c"]
    assert total.loc[("linear_gfs", "rolling"), "mae_c"] < 0.6
    comparison = spark.read.option("header", True).csv(paths["comparison"]).toPandas()
    assert set(comparison.challenger) == set(names) - {"raw_gfs"}
    stored = spark.read.parquet(paths["predictions"])
    assert stored.filter("model = 'raw_gfs'").count() == int(total.loc[("raw_gfs", "rolling"), "scored_hours"])
    pairs = jobs.compare_pairs(spark, paths["summary"], [("prophet_gfs", "raw_gfs", "rolling")], f"{out}/pairs", seeded=True)
    assert spark.read.option("header", True).csv(pairs).count() == 1
    with pytest.raises(FileExistsError):
        jobs.covariate_backtest(spark, f"{world}/target", panel, out, cutoff, names)
    with pytest.raises(ValueError, match="No backtest fold"):
        jobs.backtest(spark, f"{world}/target", f"{out}/none", cutoff, ("persistence",), setup=Setup(hours=24 * 400))


def test_final_forecast_jobs(spark, world):
    panel = jobs.clean_forecast_runs(spark, f"{world}/runs", f"{world}/out", reuse=True)["panel"]
    cutoff = ts("2025-04-20T00:00:00")
    paths = jobs.linear_report(spark, f"{world}/target", panel, f"{world}/linear", cutoff, "America/New_York", Setup(hours=48))
    rows = spark.read.option("header", True).csv(paths["forecast"])
    assert rows.count() == 48 and {"linear_c", "linear_gfs_c", "linear_gfs_lower_c", "raw_gfs_c", "timestamp_local"} <= set(rows.columns)
    assert spark.read.option("header", True).csv(paths["coefficients"]).count() == 17 + 9
    fast = {"maxIter": 5, "maxDepth": 3}
    # One run per hour keeps the holdout's times unique.
    deduped = jobs.dedupe_panel(spark, panel, f"{world}/single", overwrite=True)
    made = jobs.train_boosted(spark, f"{world}/target", deduped, f"{world}/boosted", cutoff, "America/New_York", 48, fast, 3)
    forecast = spark.read.option("header", True).csv(made["forecast"]).toPandas()
    assert forecast.columns.tolist() == ["timestamp_utc", "timestamp_local", "predicted_temperature_c", "raw_gfs_temperature_c"]
    assert forecast.timestamp_utc.min() == "2025-04-20T00:00:00Z" and forecast.timestamp_local.min() == "2025-04-19T20:00:00-04:00"
    report = spark.read.json(made["report"]).first()
    assert report["boosted_validation_mae_c"] < report["raw_validation_mae_c"]


# --- streams -----------------------------------------------------------------------

OBS = "source string, station_id string, timestamp_utc timestamp, temperature_c double"


def landed(spark, df, parts=3):
    folder = shared_dir(spark, "landed")
    for i in range(parts):
        df.filter(F.abs(F.hash("timestamp_utc" if "timestamp_utc" in df.columns else "init_time_utc")) % parts == i).coalesce(1).write.mode("append").parquet(folder)
    return folder


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_streaming_collapse_equals_batch(spark):
    rng = np.random.default_rng(8)
    rows = [("s", "AB"[i % 2], ts("2026-01-01T00:00:00") + timedelta(minutes=int(m)), None if m % 5 == 0 else float(m)) for i, m in enumerate(rng.permutation(2000)[:300])]
    df = spark.createDataFrame(rows, OBS)
    stream = S.file_stream(spark, landed(spark, df), df.schema, files_per_batch=1)
    got = S.drain(S.collapse_stream(stream, ["temperature_c"], delay="5 days"), ("source", "station_id", "timestamp_utc"))
    cols = ("source", "station_id", "timestamp_utc", "temperature_c")
    assert rows_of(got, *cols) == rows_of(A.collapse(df, ["temperature_c"]), *cols)


def test_late_rows_are_dropped(spark):
    first = spark.createDataFrame([("s", "A", ts("2026-01-02T00:10:00"), 1.0)], OBS)
    late = spark.createDataFrame([("s", "A", ts("2026-01-01T00:10:00"), 9.0), ("s", "A", ts("2026-01-02T00:20:00"), 2.0)], OBS)
    folder, log, mark = (shared_dir(spark, n) for n in ("in", "log", "mark"))
    keys = ("source", "station_id", "timestamp_utc")

    def run():
        stream = S.collapse_stream(S.file_stream(spark, folder, first.schema), ["temperature_c"], delay="1 hour")
        return S.drain(stream, keys, log, mark)

    first.write.mode("append").parquet(folder)
    run()
    late.write.mode("append").parquet(folder)
    assert rows_of(run(), "timestamp_utc", "temperature_c") == [(ts("2026-01-02T00:00:00"), 2.0)]


RUNS = "source string, station_id string, init_time_utc timestamp, valid_time_utc timestamp, lead_hours int, temperature_c double"


def run_rows(n_runs=4, hours=30):
    out = []
    for r in range(n_runs):
        init = ts("2026-01-01T00:00:00") + timedelta(hours=12 * r)
        out += [("g", "A", init, init + timedelta(hours=h), h, None if (r == 3 and h % 4 == 0) else float(100 * r + h)) for h in range(hours)]
    return out


def test_streaming_freshest_equals_batch(spark):
    df = spark.createDataFrame(run_rows(), RUNS)
    stream = S.file_stream(spark, landed(spark, df), df.schema, files_per_batch=1).drop("source")
    got = S.drain(S.freshest_stream(stream), ("station_id", "valid_time_utc"))
    cols = ("station_id", "valid_time_utc", "init_time_utc", "lead_hours", "temperature_c")
    assert rows_of(got, *cols) == rows_of(V.freshest(df.drop("source"), ("station_id", "valid_time_utc")), *cols)


def test_streaming_ingestion_resumes_and_deduplicates(spark):
    df = spark.createDataFrame(run_rows(2, 5), RUNS)
    folder, out, mark = (shared_dir(spark, n) for n in ("in", "out", "mark"))
    df.filter("init_time_utc = '2026-01-01 00:00:00'").write.mode("append").parquet(folder)
    S.ingest_runs(spark, folder, df.schema, out, mark, "*.parquet", fmt="parquet").awaitTermination()
    assert spark.read.parquet(out).count() == 5
    df.write.mode("append").parquet(folder)
    S.ingest_runs(spark, folder, df.schema, out, mark, "*.parquet", fmt="parquet").awaitTermination()
    assert spark.read.parquet(out).count() == 10


def test_ingestion_keeps_runs_that_arrive_late(spark):
    df = spark.createDataFrame(run_rows(3, 5), RUNS)
    folder, out, mark = (shared_dir(spark, n) for n in ("in", "out", "mark"))
    first = df.agg(F.min("init_time_utc")).first()[0]
    late = df.filter(F.col("init_time_utc") == first).withColumn("init_time_utc", F.col("init_time_utc") - F.expr("INTERVAL 400 DAYS"))
    for landed in (df, late, late):
        landed.write.mode("append").parquet(folder)
        S.ingest_runs(spark, folder, df.schema, out, mark, "*.parquet", fmt="parquet").awaitTermination()
    assert spark.read.parquet(out).count() == 20


def test_streaming_pairs_both_ways(spark):
    df = spark.createDataFrame(run_rows(2, 10), RUNS).select("station_id", "init_time_utc", "valid_time_utc", F.col("temperature_c").alias("gfs_temperature_c"))
    seen = spark.createDataFrame([("A", ts("2026-01-01T00:00:00") + timedelta(hours=h), float(h)) for h in range(0, 20, 2)], "station_id string, valid_time_utc timestamp, observed_temperature_c double")
    expected = rows_of(df.join(seen, ["station_id", "valid_time_utc"]), "init_time_utc", "valid_time_utc", "gfs_temperature_c")
    left = S.file_stream(spark, landed(spark, df), df.schema)
    folder = shared_dir(spark, "seen")
    seen.write.parquet(folder)
    for right in (seen, S.file_stream(spark, folder, seen.schema)):
        pairs = S.pairs_stream(left, right)
        out, mark = shared_dir(spark, "pairs"), shared_dir(spark, "mark")
        pairs.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        assert rows_of(spark.read.parquet(out), "init_time_utc", "valid_time_utc", "gfs_temperature_c") == expected
    monitor = S.drain(S.error_stream(S.pairs_stream(left, seen), "1 day", ("station_id",)), ("station_id", "window_start", "lead_day"))
    assert monitor.agg(F.sum("pairs")).first()[0] == len(expected)


def test_streaming_flatline_counts_hours_and_takes_back(spark):
    keys = ("source", "station_id", "run_start")
    seven = hourly("2026-01-01T00:00:00", [5.0] * 5 + [None, 5.0])
    schema = spark.createDataFrame(seven, OBS).schema
    folder, out, mark = landed(spark, spark.createDataFrame(seven + seven[:1], OBS)), shared_dir(spark, "log"), shared_dir(spark, "mark")

    def stuck():
        stream = S.file_stream(spark, folder, schema)
        return rows_of(S.stuck_hours(S.drain(S.flatline_stream(stream, "temperature_c", 6, delay="30 days"), keys, out, mark)), "timestamp_utc")

    # Five hours, one of them read twice, are no run of six.
    assert stuck() == []
    spark.createDataFrame(hourly("2026-01-01T05:00:00", [5.0]), OBS).write.mode("append").parquet(folder)
    assert len(stuck()) == 7
    # A differing reading of the first hour breaks the first of two windows.
    spark.createDataFrame(hourly("2026-01-01T00:00:00", [6.0]), OBS).write.mode("append").parquet(folder)
    assert len(stuck()) == 6


def test_streaming_flatline_equals_batch(spark):
    rng = np.random.default_rng(9)
    values = [None if x < 0.05 else float(x > 0.75) for x in rng.random(300)]
    df = spark.createDataFrame(hourly("2026-01-01T00:00:00", values), OBS)
    stream = S.file_stream(spark, landed(spark, df), df.schema, files_per_batch=1)
    alarms = S.drain(S.flatline_stream(stream, "temperature_c", 6, delay="30 days"), ("source", "station_id", "run_start"))
    got = rows_of(S.stuck_hours(alarms), "timestamp_utc")
    screen = Screen(ranges={}, dewpoint_tolerance=None, flatline=("temperature_c",), flatline_hours=6)
    expected = screen.flag(df).filter(F.col(f"`{flag_name('flatline', 'temperature_c')}`"))
    assert got == rows_of(expected, "timestamp_utc") and got
    assert DS == "ds"
