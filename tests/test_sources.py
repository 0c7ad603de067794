from __future__ import annotations

import json
from datetime import timedelta

import pytest
from conftest import ts
from pyspark.sql import functions as F

from gridcast.functions import convert as C
from gridcast.sources import readers, schedule as S, specs, writers

REG = "namespace string, alias string, station_id string"


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(
        [("ghcnh", "USW1", "KAAA"), ("ghcnh", "USW2", "KBBB"), ("iem", "AAA", "KAAA"), ("iem", "BBB", "KBBB"), ("econet", "FLD", "FLD")], REG
    )


def test_coded_source(spark, registry):
    t = ts("2026-01-01T00:51:00")
    rows = [
        ("USW1", t, "10.0", "5", "999", "999.0", "10"),
        ("USW1", t + timedelta(hours=1), "11.0", "2", "180", "1000", "5"),
        (" USW2", t, "12.0", "A", "10", None, "bad"),
        ("NOPE", t, "13.0", None, "10", "1000", "1"),
    ]
    raw = spark.createDataFrame(rows, "station_id string, timestamp_utc timestamp, temperature string, temperature_Quality_Code string, wind_direction string, station_level_pressure string, visibility string")
    out = specs.NOAA_GHCNH.normalize(raw, registry).orderBy("station_id", "timestamp_utc").collect()
    assert [r["station_id"] for r in out] == ["KAAA", "KAAA", "KBBB"]
    assert [r["temperature_c"] for r in out] == [10.0, None, None]
    assert [r["wind_direction_deg"] for r in out] == [None, 180.0, 10.0]
    assert [r["pressure_hpa"] for r in out] == [999.0, 1000.0, None]
    assert [r["visibility_m"] for r in out] == [10000.0, 5000.0, None]


def test_numeric_codes_survive_float_typing(spark, registry):
    t = ts("2026-01-01T00:51:00")
    raw = spark.createDataFrame([("USW1", t, 10.0, 4.0), ("USW1", t, 11.0, 3.0)], "station_id string, timestamp_utc timestamp, temperature double, temperature_Quality_Code double")
    assert [r["temperature_c"] for r in specs.NOAA_GHCNH.normalize(raw, registry).collect()] == [10.0, None]


def test_imperial_source(spark, registry):
    t = ts("2026-01-01T00:51:00")
    rows = [("AAA", t, 50.0, 10.0, 1.0, 10.0, "FEW", "BKN"), ("ZZZ", t, 50.0, 10.0, 1.0, 10.0, "FEW", "BKN"), ("BBB", t, None, None, None, None, "???", None)]
    raw = spark.createDataFrame(rows, "station_id string, timestamp_utc timestamp, tmpf double, sknt double, p01i double, vsby double, skyc1 string, skyc2 string")
    out = specs.IEM_ASOS.normalize(raw, registry).orderBy("station_id").collect()
    assert len(out) == 2
    assert out[0]["temperature_c"] == pytest.approx(10.0) and out[0]["wind_speed_ms"] == pytest.approx(5.14444, rel=1e-4)
    assert (out[0]["precipitation_mm"], out[0]["cloud_cover_pct"], out[1]["cloud_cover_pct"]) == (pytest.approx(25.4), 75.0, None)


def test_long_graded_source(spark, registry):
    t = ts("2026-01-01T00:00:00")
    rows = [("FLD", t, "airtemp2m|C", "10.0", 0), ("FLD", t, "airtemp2m|C", "12.0", 1), ("FLD", t, "dewtemp2m|C", "QCF", 3), ("FLD", t, "windspeed10m|ms", "4", 0)]
    raw = spark.createDataFrame(rows, "station_id string, timestamp_utc timestamp, var string, value string, score int")
    out = specs.NCSCO_ECONET.normalize(raw, registry).collect()
    assert len(out) == 1
    assert (out[0]["temperature_c"], out[0]["dewpoint_c"], out[0]["wind_speed_ms"]) == (11.0, None, 4.0)


def test_source_plugin_and_selection(spark, registry):
    spec = specs.SourceSpec("lab", "iem", {"t": ("temperature_c", lambda v: v / 10)})
    specs.register(spec)
    try:
        raw = spark.createDataFrame([("AAA", ts("2026-01-01T00:00:00"), "215")], "station_id string, timestamp_utc timestamp, t string")
        assert specs.SOURCES["lab"].normalize(raw, registry).first()["temperature_c"] == 21.5
        assert [s.name for s in specs.select_sources(["lab", "iem-asos"])] == ["lab", "iem_asos"]
    finally:
        del specs.SOURCES["lab"]
    with pytest.raises(ValueError, match="Unknown"):
        specs.select_sources(["nope"])
    with pytest.raises(ValueError, match="target source"):
        specs.select_sources(["open_meteo"], ("noaa_ghcnh", "iem_asos"))


def test_latest_file_and_missing_source(spark, tmp_path):
    folder = tmp_path / "iem_asos"
    folder.mkdir()
    (folder / "weather_2024.csv").write_text("station_id,timestamp_utc,tmpf\nOLD,2024-01-01T00:00Z,1\n")
    (folder / "weather_2025.csv").write_text("station_id,timestamp_utc,tmpf\nNEW,2025-01-01T00:51Z,2\nNEW,bad,3\n")
    rows = readers.latest_csv(spark, str(tmp_path), specs.IEM_ASOS).collect()
    assert [r["station_id"] for r in rows] == ["NEW", "NEW"]
    assert rows[0]["timestamp_utc"] == ts("2025-01-01T00:51:00") and rows[1]["timestamp_utc"] is None
    with pytest.raises(FileNotFoundError):
        readers.latest_csv(spark, str(tmp_path), specs.OPEN_METEO)


def test_forecast_files_skip_checkpoints(spark, tmp_path):
    head = "source,station_id,init_time_utc,valid_time_utc,lead_hours,TMP\n"
    line = "g,KAAA,2026-01-01T12:00:00Z,2026-01-01T12:00:00Z,0,280\n"
    (tmp_path / "gfs_a.csv").write_text(head + line)
    (tmp_path / "gfs_b.partial.csv").write_text(head + line)
    assert readers.forecast_runs(spark, str(tmp_path)).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.forecast_runs(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        readers.parquet_table(spark, str(tmp_path / "none"))


def test_config(spark, tmp_path):
    config = {
        "history": {"start_utc": "2026-01-01T00:00:00Z", "end_utc": "2026-01-01T04:00:00Z", "local_timezone": "America/New_York"},
        "airport_stations": [{"name": "one", "icao": "KAAA", "iem_id": "AAA", "ghcnh_id": "USW1", "latitude": 35.5, "longitude": -78}],
        "econet_stations": [{"id": "FLD", "name": "field"}],
    }
    path = tmp_path / "config.json"
    path.write_text(json.dumps(config))
    stations = readers.registry(spark, str(path))
    assert {(r["namespace"], r["alias"]) for r in stations.collect()} == {("ghcnh", "USW1"), ("iem", "AAA"), ("airport", "KAAA"), ("econet", "FLD")}
    assert readers.station_coordinates(stations, "KAAA") == (35.5, -78.0)
    with pytest.raises(ValueError):
        readers.station_coordinates(stations, "KZZZ")
    assert readers.job_settings(spark, str(path))["cutoff"] == "2026-01-01T04:00:00Z"


def test_payload_rows(spark):
    body = [
        {"latitude": 1.0, "longitude": 2.0, "elevation": 3.0, "hourly": {"time": ["2026-01-01T00:00", "2026-01-01T01:00"], "temperature_2m": [5.0, None]}},
        {"latitude": 4.0, "longitude": 5.0, "hourly": {"time": ["2026-01-01T00:00"], "temperature_2m": [7.0]}},
    ]
    asked = [{"ghcnh_id": "S1", "name": "a", "latitude": 1.1, "longitude": 2.1}, {"ghcnh_id": "S2", "name": "b", "latitude": 4.1, "longitude": 5.1}]
    df = spark.createDataFrame([(json.dumps(body),)], "body string")
    out = readers.location_payload(df, asked, ["temperature_2m"], "m").orderBy("station_id", "timestamp_utc").collect()
    assert [(r["station_id"], r["temperature_2m"]) for r in out] == [("S1", 5.0), ("S1", None), ("S2", 7.0)]
    single = spark.createDataFrame([(json.dumps(body[0]),)], "body string")
    assert readers.location_payload(single, asked[:1], ["temperature_2m"], "m").count() == 2
    with pytest.raises(Exception, match="location count"):
        readers.location_payload(single, asked, ["temperature_2m"], "m").collect()


def test_publisher_shapes(spark):
    stations = spark.createDataFrame([("ghcnh", "USW1", "KAAA", "one"), ("iem", "AAA", "KAAA", "one"), ("econet", "FLD", "FLD", "field")], REG + ", name string")
    metar = spark.createDataFrame([("AAA", "2026-01-01 00:51", 50.0)], "station string, valid string, tmpf double")
    row = readers.metar_rows(metar, stations).first()
    assert (row["station_id"], row["station_name_config"], row["timestamp_utc"]) == ("AAA", "one", ts("2026-01-01T00:51:00"))
    long = spark.createDataFrame([("FLD", "2026-01-01 00:00:00", "v")], "location string, datetime string, var string")
    assert readers.long_rows(long, stations).first()["station_name_config"] == "field"


def test_landing_contract(spark):
    rows = spark.createDataFrame([("A", "2026-01-01T00:00:00"), ("A", "2026-01-01T00:00:00"), ("A", "2026-01-02T00:00:00")], "station_id string, t string")
    shaped = rows.select("station_id", C.instant("t").alias("timestamp_utc"))
    out = writers.land_source(shaped, "x", F.lit(ts("2026-01-01T00:00:00")), F.lit(ts("2026-01-02T00:00:00")))
    assert [tuple(r) for r in out.collect()] == [("x", "A", ts("2026-01-01T00:00:00"))]
    with pytest.raises(ValueError, match="omitted"):
        writers.land_source(rows, "x", F.lit(0), F.lit(1))


def test_protected_and_resumable_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3)
    writers.write_table(df, path)
    with pytest.raises(FileExistsError):
        writers.refuse_existing(spark, {"t": path}, overwrite=False)
    writers.refuse_existing(spark, {"t": path}, overwrite=True)
    init = ts("2026-01-01T12:00:00")
    rows = spark.createDataFrame([("g", "A", init, lead, float(lead)) for lead in range(4)], "source string, station_id string, init_time_utc timestamp, lead_hours int, v double")
    store = str(tmp_path / "runs")
    writers.append_missing_leads(rows, rows.filter("lead_hours < 2"), store)
    writers.append_missing_leads(rows, rows, store)
    writers.append_missing_leads(rows, rows, store)
    assert sorted(r["lead_hours"] for r in spark.read.parquet(store).collect()) == [0, 1, 2, 3]


def leads(spark, first, last):
    return spark.range(1).select(S.available_leads(F.lit(first), F.lit(last)).alias("l")).first()["l"]


def test_lead_schedule(spark):
    assert leads(spark, 0, 3) == [0, 1, 2, 3]
    assert leads(spark, 118, 130) == [118, 119, 120, 123, 126, 129]
    assert leads(spark, 121, 127) == [123, 126]
    assert leads(spark, 125, 126) == [126]
    assert leads(spark, 5, 4) == []
    assert len(leads(spark, 16, 352)) == 105 + 77


def test_run_plan(spark):
    def plan(*cutoffs, data_cutoff="2026-09-17T04:00:00"):
        df = spark.createDataFrame([(ts(c),) for c in cutoffs], "cutoff timestamp")
        return S.run_plan(df, F.lit(ts(data_cutoff))).orderBy("init_time_utc").collect()

    row = plan("2026-09-17T04:00:00")[0]
    assert row["init_time_utc"] == ts("2026-09-16T12:00:00")
    assert (row["leads"][0], row["leads"][-1], len(row["leads"])) == (16, 351, 182)
    # Eight in the evening: the lead-in reaches the same day's noon, which is before the cutoff.
    assert plan("2026-09-10T20:00:00")[0]["init_time_utc"] == ts("2026-09-10T12:00:00")
    assert len(plan("2026-09-10T04:00:00", "2026-09-10T05:00:00")) == 1
    with pytest.raises(Exception, match="not before the data cutoff"):
        plan("2026-09-19T04:00:00")


def test_time_chunks(spark):
    w = spark.createDataFrame([(ts("2021-09-17T04:00:00"), ts("2023-02-01T00:00:00"))], "start timestamp, end timestamp")
    years = S.calendar_years(w).orderBy("chunk_start").collect()
    assert [r["chunk_start"].year for r in years] == [2021, 2022, 2023]
    assert years[0]["chunk_end"] == ts("2022-01-01T00:00:00") and years[-1]["chunk_end"] == ts("2023-02-01T00:00:00")
    days = S.fixed_days(w, 90).orderBy("chunk_start").collect()
    assert all(a["chunk_end"] == b["chunk_start"] for a, b in zip(days, days[1:]))
    assert days[0]["chunk_end"] - days[0]["chunk_start"] == timedelta(days=90)
    with pytest.raises(ValueError):
        S.fixed_days(w, 0)
    with pytest.raises(ValueError, match="offsets"):
        S.parse_window("2024-01-01", "2025-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="earlier"):
        S.parse_window("2025-01-01T00:00:00Z", "2024-01-01T00:00:00Z")


def test_index_ranges(spark):
    text = ["1:0:d=2026:TMP:2 m:anl:", "2:500:d=2026:DPT:2 m:anl:", "junk", "3:900:d=2026:PRATE:surface:1 hour fcst:", "4:1500:d=2026:PRATE:surface:0-1 hour ave fcst:"]
    lines = spark.createDataFrame([("f", t) for t in text] + [("g", text[0])], "file string, line string")
    out = {(r["file"], r["key"]): r["byte_range"] for r in S.index_ranges(lines, block_bytes=400).collect()}
    assert out == {("f", "TMP:2 m"): "0-499", ("f", "DPT:2 m"): "500-899", ("f", "PRATE:surface"): "900-1499", ("g", "TMP:2 m"): "0-"}
