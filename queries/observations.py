"""Queries over raw readings: coercion, masks, alignment, screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions import convert as C
from gridcast.functions.vocabulary import INIT, SOURCE, STATION, TS, VALID
from gridcast.operators import align as A
from gridcast.operators.panel import derive_wind, to_hourly
from gridcast.operators.screen import Screen, flag_name
from gridcast.sources import readers, writers
from gridcast.sources.specs import QUALITY_SUFFIX, SourceSpec, accepted, graded_wide, resolve, variable_columns
from queries.bindings import OBS_END, OBS_SQL, OBS_START, at, finish, readings, table, with_sql

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


RAW_EVENTS = SourceSpec(
    name="events",
    namespace="events",
    variables={
        "temperature": ("temperature_c", None),
        "wind_direction": ("wind_direction_deg", None),
        "visibility": ("visibility_m", C.kilometres_to_m),
    },
    sentinels={"wind_direction": (99.0,)},
)


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS temperature_c,
       CASE WHEN TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) <> 99 THEN TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) END AS wind_direction_deg,
       CAST(user_id AS DOUBLE) * 1000.0 AS visibility_m
FROM events""")
def q_scan_coerce(spark, sf):
    """Text columns to typed measures: bad text and sentinels become null."""
    e = table(spark, sf, "events")
    raw = e.select(
        "event_id",
        F.when(F.col("event_type") == "error", "QCF").otherwise(F.col("value").cast("string")).alias("temperature"),
        F.get_json_object("props", "$.k").alias("wind_direction"),
        F.col("user_id").cast("string").alias("visibility"),
    )
    columns = variable_columns(raw, RAW_EVENTS)
    return finish(raw.select("event_id", *[c.alias(n) for n, c in columns.items()]))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       round((l_quantity - 32.0) * 5.0 / 9.0, 6) AS celsius_f, round(l_quantity - 273.15, 6) AS celsius_k,
       round(l_quantity * 3600.0, 6) AS mm_per_hour, round(l_quantity * (1852.0::DOUBLE / 3600.0::DOUBLE), 6) AS ms,
       round(l_quantity * 33.863886667::DOUBLE, 10) AS hpa, round(l_quantity * 25.4::DOUBLE, 6) AS mm,
       round(l_quantity * 1609.344::DOUBLE, 6) AS metres_mi, round(l_quantity * 1000.0, 6) AS metres_km,
       round(sqrt((l_quantity - 25) * (l_quantity - 25) + (l_linenumber - 4) * (l_linenumber - 4)), 6) AS wind_speed_ms,
       round((((270.0 - degrees(atan2(CAST(l_linenumber - 4 AS DOUBLE), l_quantity - 25))) % 360.0) + 360.0) % 360.0, 6) AS wind_direction_deg
FROM lineitem""")
def q_unit_convert(spark, sf):
    """Every unit conversion and the wind derivations."""
    l, q = table(spark, sf, "lineitem"), F.col("l_quantity")
    u, v = q - 25, F.col("l_linenumber") - 4
    return finish(
        l.select(
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            C.fahrenheit_to_celsius(q).alias("celsius_f"),
            C.kelvin_to_celsius(q).alias("celsius_k"),
            C.rate_to_mm_per_hour(q).alias("mm_per_hour"),
            C.knots_to_ms(q).alias("ms"),
            C.inches_mercury_to_hpa(q).alias("hpa"),
            C.inches_to_mm(q).alias("mm"),
            C.miles_to_m(q).alias("metres_mi"),
            C.kilometres_to_m(q).alias("metres_km"),
            C.wind_speed(u, v).alias("wind_speed_ms"),
            C.wind_direction(u, v).alias("wind_direction_deg"),
        ),
        6,
        hpa=10,
    )


@query("""
WITH c AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 18.75 WHEN '2-HIGH' THEN 43.75 WHEN '3-MEDIUM' THEN 75.0 END AS a,
                  CASE o_orderstatus WHEN 'O' THEN 100.0 WHEN 'F' THEN 18.75 END AS b FROM orders)
SELECT o_orderkey, CAST(greatest(a, b) AS DOUBLE) AS cloud_cover_pct FROM c""")
def q_code_map(spark, sf):
    """Sky layer codes to percent, the largest readable layer wins."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    layers = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(p == "1-URGENT", "few").when(p == "2-HIGH", " SCT ").when(p == "3-MEDIUM", "bkn").when(p == "5-LOW", "??").alias("skyc1"),
        F.when(s == "O", "OVC").when(s == "F", "Few").alias("skyc2"),
    )
    return layers.select("o_orderkey", C.total_sky_cover(["skyc1", "skyc2"]).alias("cloud_cover_pct"))


_CODES = {("A", "F"): "4.0", ("A", "O"): "A", ("R", "F"): "2.0", ("R", "O"): " 5 ", ("N", "O"): "9"}


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN '4' WHEN l_returnflag = 'A' THEN 'A'
            WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN '2' WHEN l_returnflag = 'R' THEN '5'
            WHEN l_linestatus = 'O' THEN '9' END AS code,
       CASE WHEN (l_returnflag = 'A' AND l_linestatus = 'O') OR (l_returnflag = 'R' AND l_linestatus = 'F') THEN NULL ELSE l_quantity END AS temperature_c,
       l_discount AS dewpoint_c
FROM lineitem""")
def q_quality_mask(spark, sf):
    """Quality codes normalised; a suspect code masks only the variable it describes."""
    code = F.lit(None).cast("string")
    for (flag, status), text in _CODES.items():
        code = F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), text).otherwise(code)
    l = table(spark, sf, "lineitem").withColumn("temperature" + QUALITY_SUFFIX, code)
    own = F.col("temperature" + QUALITY_SUFFIX)
    return finish(
        l.select(
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            C.quality_code(own).alias("code"),
            accepted(F.col("l_quantity"), own).alias("temperature_c"),
            F.col("l_discount").alias("dewpoint_c"),
        )
    )


WIDE = SourceSpec(
    name="events",
    namespace="events",
    variables={n: (m, None) for n, m in (("click", "temperature_c"), ("view", "dewpoint_c"), ("purchase", "wind_speed_ms"))},
    reshape=graded_wide,
)


@query(with_sql(OBS_SQL, select="""
SELECT source AS station_id, date_trunc('hour', timestamp_utc)::TIMESTAMP AS timestamp_utc,
       round(avg(ln(1 + temperature_c)) FILTER (WHERE station_id = 'click'), 8) AS click,
       round(avg(ln(1 + temperature_c)) FILTER (WHERE station_id = 'view'), 8) AS "view",
       round(avg(ln(1 + temperature_c)) FILTER (WHERE station_id = 'purchase'), 8) AS purchase
FROM obs WHERE dewpoint_c <= 60 GROUP BY ALL"""))
def q_grade_filter_pivot(spark, sf):
    """Graded long rows filtered, then one column per variable with duplicates averaged."""
    raw = readings(spark, sf).select(
        F.col(SOURCE).alias(STATION),
        C.hour_floor(TS).alias(TS),
        F.col(STATION).alias("var"),
        F.log(1 + F.col("temperature_c")).alias("value"),
        F.when(F.col("dewpoint_c") <= 60, "1").when(F.col("dewpoint_c") <= 80, "3").otherwise("bad").alias("score"),
    )
    return finish(graded_wide(raw, WIDE), 8)


@query("""
SELECT c_custkey, n_name AS station_id FROM customer LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3) n ON n_nationkey = c_nationkey""")
def q_registry_lookup(spark, sf):
    """Alias resolution through the registry; an unknown alias resolves to null."""
    n = table(spark, sf, "nation").filter("n_regionkey < 3")
    registry = n.select(F.lit("nation").alias("namespace"), F.col("n_nationkey").cast("string").alias("alias"), F.col("n_name").alias(STATION))
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("alias"))
    return finish(resolve(rows, registry, "nation"))


@query(with_sql(OBS_SQL, select="""
SELECT source, station_id, date_trunc('hour', timestamp_utc)::TIMESTAMP AS timestamp_utc,
       arg_max(temperature_c, row(timestamp_utc, event_id)) FILTER (WHERE temperature_c IS NOT NULL) AS temperature_c,
       arg_max(dewpoint_c, row(timestamp_utc, event_id)) FILTER (WHERE dewpoint_c <= 50) AS dewpoint_c
FROM obs GROUP BY ALL"""))
def q_hour_collapse(spark, sf):
    """Last non-missing reading per measure and hour."""
    rows = readings(spark, sf).withColumn("dewpoint_c", F.when(F.col("dewpoint_c") <= 50, F.col("dewpoint_c")))
    return finish(A.collapse(rows, ["temperature_c", "dewpoint_c"], tiebreak=["event_id"]))


@query(with_sql(OBS_SQL, f"""hours AS (SELECT unnest(generate_series(TIMESTAMP '{OBS_START}', TIMESTAMP '{OBS_END}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h),
cells AS (SELECT source, user_station, date_trunc('hour', timestamp_utc)::TIMESTAMP AS h, arg_max(temperature_c, row(timestamp_utc, event_id)) AS t FROM obs GROUP BY ALL),
st AS (SELECT DISTINCT source, user_station FROM obs)""", select="""
SELECT st.source, st.user_station AS station_id, hours.h AS timestamp_utc, cells.t AS temperature_c
FROM st CROSS JOIN hours LEFT JOIN cells ON cells.source = st.source AND cells.user_station = st.user_station AND cells.h = hours.h"""))
def q_grid_align(spark, sf):
    """Every station on every grid hour, gaps kept."""
    rows = readings(spark, sf, "user_id")
    return finish(A.align(rows, at(OBS_START), at(OBS_END), ["temperature_c"], tiebreak=["event_id"]))


def _aligned(spark, sf):
    return A.align(readings(spark, sf), at(OBS_START), at(OBS_END), ["temperature_c", "dewpoint_c"], tiebreak=["event_id"])


ALIGNED_SQL = f"""hours AS (SELECT unnest(generate_series(TIMESTAMP '{OBS_START}', TIMESTAMP '{OBS_END}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h),
cells AS (SELECT source, station_id, date_trunc('hour', timestamp_utc)::TIMESTAMP AS h, arg_max(temperature_c, row(timestamp_utc, event_id)) AS t,
                 arg_max(dewpoint_c, row(timestamp_utc, event_id)) AS d FROM obs GROUP BY ALL),
st AS (SELECT DISTINCT source, station_id FROM obs),
aligned AS (SELECT st.source, st.station_id, hours.h AS timestamp_utc, cells.t AS temperature_c, cells.d AS dewpoint_c
  FROM st CROSS JOIN hours LEFT JOIN cells ON cells.source = st.source AND cells.station_id = st.station_id AND cells.h = hours.h)"""


@query(with_sql(OBS_SQL, ALIGNED_SQL, select="""
SELECT a.timestamp_utc, timezone('America/New_York', timezone('UTC', a.timestamp_utc)) AS timestamp_local, a.station_id,
       coalesce(a.temperature_c, b.temperature_c) AS temperature_c,
       CASE WHEN a.temperature_c IS NOT NULL THEN 'even' WHEN b.temperature_c IS NOT NULL THEN 'odd' END AS temperature_source
FROM (SELECT * FROM aligned WHERE source = 'even') a JOIN (SELECT * FROM aligned WHERE source = 'odd') b USING (station_id, timestamp_utc)"""))
def q_target_coalesce(spark, sf):
    """Two sources coalesced in order, with provenance and local clock."""
    rows = A.coalesce_sources(_aligned(spark, sf), ("even", "odd"), zone="America/New_York")
    return finish(rows)


@query(with_sql(OBS_SQL, ALIGNED_SQL, select="""
SELECT station_id, count(t) AS covered_hours, count(*) AS hours, count(t) / count(*) AS covered_share
FROM (SELECT station_id, timestamp_utc, coalesce(max(temperature_c) FILTER (WHERE source = 'even'), max(temperature_c) FILTER (WHERE source = 'odd')) AS t
      FROM aligned GROUP BY ALL) GROUP BY 1"""))
def q_target_coverage(spark, sf):
    """Covered hours and share of the coalesced target per station."""
    return finish(A.coverage(A.coalesce_sources(_aligned(spark, sf), ("even", "odd")), by=(STATION,)))


@query(with_sql(OBS_SQL, select="""
SELECT event_id, CASE WHEN temperature_c BETWEEN -30 AND 50 THEN temperature_c END AS temperature_c,
       CASE WHEN dewpoint_c BETWEEN -40 AND 35 THEN dewpoint_c END AS dewpoint_c FROM obs"""))
def q_range_screen(spark, sf):
    """Impossible readings masked, rows kept."""
    screen = Screen(flatline=(), dewpoint_tolerance=None)
    return finish(screen.apply(readings(spark, sf)).select("event_id", "temperature_c", "dewpoint_c"))


@query(with_sql(OBS_SQL, select="""
SELECT event_id, temperature_c, CASE WHEN dewpoint_c - temperature_c > 0.5 THEN NULL ELSE dewpoint_c END AS dewpoint_c FROM obs"""))
def q_cross_rule(spark, sf):
    """A dew point above its temperature masks the dew point only."""
    screen = Screen(ranges={}, flatline=())
    return finish(screen.apply(readings(spark, sf)).select("event_id", "temperature_c", "dewpoint_c"))


STUCK_SQL = """stepped AS (SELECT source, station_id, timestamp_utc, floor(temperature_c / 150) AS v FROM aligned),
marked AS (SELECT *, CASE WHEN v IS NOT NULL AND v = lag(v) OVER w THEN 0 ELSE 1 END AS starts FROM stepped WINDOW w AS (PARTITION BY source, station_id ORDER BY timestamp_utc)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY source, station_id ORDER BY timestamp_utc ROWS UNBOUNDED PRECEDING) AS run FROM marked),
sized AS (SELECT *, v IS NOT NULL AND count(*) OVER (PARTITION BY source, station_id, run) >= 24 AS stuck FROM runs)"""


def _stepped(spark, sf):
    return _aligned(spark, sf).withColumn("temperature_c", F.floor(F.col("temperature_c") / 150).cast("double")).drop("dewpoint_c")


@query(with_sql(OBS_SQL, ALIGNED_SQL, STUCK_SQL, select="""
SELECT source, station_id, timestamp_utc, CASE WHEN NOT stuck THEN v END AS temperature_c, stuck FROM sized"""))
def q_flatline(spark, sf):
    """Readings inside a run of at least a day of equal values; a gap breaks a run."""
    screen = Screen(ranges={}, dewpoint_tolerance=None, flatline=("temperature_c",), block_hours=168)
    flagged = screen.flag(_stepped(spark, sf)).withColumnRenamed(flag_name("flatline", "temperature_c"), "stuck")
    return finish(flagged)


@query(with_sql(OBS_SQL, ALIGNED_SQL, """
r1 AS (SELECT source, station_id, timestamp_utc, temperature_c > 50 AS bt, dewpoint_c > 35 AS bd,
              CASE WHEN temperature_c <= 50 THEN temperature_c END AS t, CASE WHEN dewpoint_c <= 35 THEN dewpoint_c END AS d FROM aligned),
r2 AS (SELECT *, coalesce(d - t > 0.5, false) AS bx, CASE WHEN d - t > 0.5 THEN NULL ELSE d END AS d2 FROM r1),
lines AS (
  SELECT 'range' AS rule, source, station_id, 'temperature_c' AS "column", count(*) FILTER (WHERE bt) AS masked FROM r2 GROUP BY ALL
  UNION ALL SELECT 'range', source, station_id, 'dewpoint_c', count(*) FILTER (WHERE bd) FROM r2 GROUP BY ALL
  UNION ALL SELECT 'dewpoint_above_temperature', source, station_id, 'dewpoint_c', count(*) FILTER (WHERE bx) FROM r2 GROUP BY ALL)""",
    select="""SELECT rule, source, station_id, "column", masked FROM lines WHERE masked > 0"""))
def q_mask_report(spark, sf):
    """What each rule of a two-rule profile masked, per source and station."""
    screen = Screen(flatline=())
    return finish(screen.report(screen.flag(_aligned(spark, sf))))


RUN_SQL = """pub AS (
  SELECT user_station AS station_id, date_trunc('week', timestamp_utc)::TIMESTAMP AS init_time_utc, date_trunc('hour', timestamp_utc)::TIMESTAMP AS valid_time_utc,
         arg_max(ln(1 + temperature_c), row(timestamp_utc, event_id)) AS temperature_c,
         arg_max(dewpoint_c, row(timestamp_utc, event_id)) FILTER (WHERE dewpoint_c <= 50) AS dewpoint_c FROM obs GROUP BY ALL),
grid AS (SELECT station_id, init_time_utc, unnest(generate_series(min(valid_time_utc), max(valid_time_utc), INTERVAL 1 HOUR)) AS valid_time_utc FROM pub GROUP BY station_id, init_time_utc),
filled AS (
  SELECT g.*, p.valid_time_utc IS NULL AS interpolated, p.temperature_c AS t, p.dewpoint_c AS d,
         CASE WHEN p.temperature_c IS NOT NULL THEN g.valid_time_utc END AS tt, CASE WHEN p.dewpoint_c IS NOT NULL THEN g.valid_time_utc END AS dt
  FROM grid g LEFT JOIN pub p USING (station_id, init_time_utc, valid_time_utc)),
ends AS (
  SELECT *, last_value(t IGNORE NULLS) OVER b AS t0, last_value(tt IGNORE NULLS) OVER b AS tt0, first_value(t IGNORE NULLS) OVER a AS t1, first_value(tt IGNORE NULLS) OVER a AS tt1,
         last_value(d IGNORE NULLS) OVER b AS d0, last_value(dt IGNORE NULLS) OVER b AS dt0, first_value(d IGNORE NULLS) OVER a AS d1, first_value(dt IGNORE NULLS) OVER a AS dt1
  FROM filled
  WINDOW b AS (PARTITION BY station_id, init_time_utc ORDER BY valid_time_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY station_id, init_time_utc ORDER BY valid_time_utc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _runs(spark, sf):
    r = readings(spark, sf, "user_id").withColumn("temperature_c", F.log(1 + F.col("temperature_c")))
    r = r.withColumn("dewpoint_c", F.when(F.col("dewpoint_c") <= 50, F.col("dewpoint_c")))
    r = r.withColumn(INIT, F.date_trunc("week", TS)).withColumn(SOURCE, F.lit("events"))
    return A.collapse(r, ["temperature_c", "dewpoint_c"], (SOURCE, STATION, INIT), tiebreak=["event_id"]).withColumnRenamed(TS, VALID)


@query(with_sql(OBS_SQL, RUN_SQL, select="""
SELECT station_id, init_time_utc, valid_time_utc, date_diff('hour', init_time_utc, valid_time_utc) AS lead_hours,
       round(CASE WHEN t IS NOT NULL THEN t ELSE t0 + (t1 - t0) * date_diff('hour', tt0, valid_time_utc) / date_diff('hour', tt0, tt1) END, 8) AS temperature_c,
       round(CASE WHEN d IS NOT NULL THEN d ELSE d0 + (d1 - d0) * date_diff('hour', dt0, valid_time_utc) / date_diff('hour', dt0, dt1) END + 0.00000031415, 6) AS dewpoint_c,
       interpolated
FROM ends"""))
def q_run_interpolate(spark, sf):
    """Weekly runs per user filled to hourly rows inside their own span, never beyond it."""
    rows = to_hourly(_runs(spark, sf), ["temperature_c", "dewpoint_c"]).drop(SOURCE)
    # Whole-number readings can blend to exact rounding ties; the shift moves both engines off them.
    return finish(rows.withColumn("dewpoint_c", F.col("dewpoint_c") + F.lit(0.00000031415)), temperature_c=8, dewpoint_c=6)


@query(with_sql(OBS_SQL, RUN_SQL, select="""
SELECT count(DISTINCT (station_id, init_time_utc)) AS runs, count(*) AS hours, count(*) FILTER (WHERE interpolated) AS interpolated_hours,
       count(*) FILTER (WHERE interpolated) / count(*) AS interpolated_share FROM ends"""))
def q_panel_summary(spark, sf):
    """Runs, hours and interpolated share of the filled panel."""
    from gridcast.operators.panel import panel_summary

    return finish(panel_summary(to_hourly(_runs(spark, sf), ["temperature_c"])))


@query(with_sql(OBS_SQL, select="""
SELECT event_id, round(sqrt((temperature_c - 50.25) * (temperature_c - 50.25) + (dewpoint_c - 49.5) * (dewpoint_c - 49.5)), 6) AS wind_speed_ms,
       round((((270.0 - degrees(atan2(dewpoint_c - 49.5, temperature_c - 50.25))) % 360.0) + 360.0) % 360.0, 6) AS wind_direction_deg
FROM obs"""))
def q_wind_derive(spark, sf):
    """Speed and bearing from components, components dropped."""
    rows = readings(spark, sf).select(
        "event_id", (F.col("temperature_c") - 50.25).alias("wind_eastward_ms"), (F.col("dewpoint_c") - 49.5).alias("wind_northward_ms")
    )
    return finish(derive_wind(rows), 6)


@query("""
WITH t AS (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS ts FROM orders),
l AS (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS timestamp_local FROM t)
SELECT o_orderkey, timestamp_local, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc_text,
       strftime(timestamp_local, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_diff('minute', ts, timestamp_local) < 0 THEN '-' ELSE '+' END
         || lpad(CAST(abs(date_diff('minute', ts, timestamp_local)) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(date_diff('minute', ts, timestamp_local)) % 60 AS VARCHAR), 2, '0') AS local_text
FROM l""")
def q_local_time(spark, sf):
    """Local clock and ISO texts; the repeated autumn hour stays distinct by its offset."""
    zone = "America/New_York"
    o = table(spark, sf, "orders")
    ts = C.plus_hours(F.col("o_orderdate").cast("timestamp"), (F.col("o_orderkey") % 24).cast("int"))
    rows = o.select("o_orderkey", ts.alias("ts"))
    return finish(rows.select("o_orderkey", C.to_local("ts", zone).alias("timestamp_local"), C.iso_utc("ts").alias("utc_text"), C.iso_local("ts", zone).alias("local_text")))


@query(with_sql(OBS_SQL, select="""
SELECT DISTINCT 'events' AS source, station_id, timestamp_utc, temperature_c, dewpoint_c, event_id FROM obs
WHERE timestamp_utc >= TIMESTAMP '2024-01-05' AND timestamp_utc < TIMESTAMP '2024-01-20'"""))
def q_dedupe_exact(spark, sf):
    """Landing contract: window, exact duplicates removed, source tagged."""
    rows = readings(spark, sf).drop(SOURCE)
    return finish(writers.land_source(rows.unionByName(rows), "events", at("2024-01-05"), at("2024-01-20")))


@query("""
SELECT o_orderpriority AS "STATION", strftime(o_orderdate, '%Y-%m-%d') AS "DATE", CAST(o_totalprice AS DOUBLE) AS temperature, '1' AS "temperature_Quality_Code", 'FM15' AS "temperature_Report_Type",
       o_orderdate AS timestamp_utc, o_orderpriority AS station_id, lower(o_orderpriority) AS station_name_config, substr(o_orderpriority, 1, 1) AS station_icao
FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'""")
def q_source_shape(spark, sf):
    """Station-year rows: report type, window and configured columns kept, station tagged."""
    o = table(spark, sf, "orders")
    files = o.select(
        F.col("o_orderpriority").alias("STATION"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("DATE"),
        F.col("o_totalprice").alias("temperature"),
        F.lit("1").alias("temperature_Quality_Code"),
        F.when(F.col("o_orderstatus") == "F", "FM15").otherwise("FM12").alias("temperature_Report_Type"),
        F.col("o_custkey").alias("unused_variable"),
    )
    p = F.col("o_orderpriority")
    stations = o.select(F.lit("ghcnh").alias("namespace"), p.alias("alias"), F.substring(p, 1, 1).alias(STATION), F.lower(p).alias("name")).distinct()
    return finish(readers.station_year(files, stations, ["temperature"], at("1996-01-01"), at("2000-01-01")))


@query("""
WITH e AS (SELECT event_id, ts, value, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events)
SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp_utc, value AS temperature_2m, k AS cloud_cover, 'G1' AS station_id, event_id FROM e
UNION ALL SELECT date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR, k, value, 'G1', event_id FROM e
UNION ALL SELECT date_trunc('hour', ts)::TIMESTAMP, k, NULL, 'G2', event_id FROM e""")
def q_json_arrays(spark, sf):
    """Two-location JSON payloads with parallel hourly arrays, one row per hour."""
    e = table(spark, sf, "events")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    text = {n: F.date_format(t, "yyyy-MM-dd'T'HH:mm") for n, t in (("a", hour), ("b", C.plus_hours(hour, 1)))}
    k, v = F.get_json_object("props", "$.k"), F.col("value").cast("string")
    place = '{"latitude":%s,"longitude":%s,"elevation":%s,"hourly":{"time":'
    body = F.concat(
        F.lit("[" + place % ("35.9", "-78.8", "130.0") + '["'), text["a"], F.lit('","'), text["b"],
        F.lit('"],"temperature_2m":['), v, F.lit(","), k, F.lit('],"cloud_cover":['), k, F.lit(","), v,
        F.lit("]}}," + place % ("36.0", "-79.1", "null") + '["'), text["a"],
        F.lit('"],"temperature_2m":['), k, F.lit('],"cloud_cover":[null]}}]'),
    )
    asked = [{"ghcnh_id": "G1", "name": "one", "latitude": 35.9, "longitude": -78.8}, {"ghcnh_id": "G2", "name": "two", "latitude": 36.0, "longitude": -79.1}]
    rows = readers.location_payload(e.select(body.alias("body"), "event_id"), asked, ["temperature_2m", "cloud_cover"], "m", carry=("event_id",))
    return finish(rows.select(TS, "temperature_2m", "cloud_cover", STATION, "event_id"))
