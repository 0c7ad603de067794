"""Queries over forecast runs, folds and the joins between the two clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions import convert as C
from gridcast.functions import features as X
from gridcast.functions.vocabulary import CUTOFF, DS, FOLDS, INIT, INTERPOLATED, LEAD, OBSERVED, SOURCE, STATION, VALID, Y
from gridcast.operators import covariates as V
from gridcast.operators.contracts import violations
from gridcast.operators.folds import position_folds, rolling_cutoffs, seasonal_cutoffs
from gridcast.sources import schedule as S
from queries.bindings import (
    ATTACHED_SQL,
    BASE_SQL,
    COVERED_SQL,
    DAILY,
    DAY_END,
    FOLDS_SQL,
    FWINDOW_SQL,
    PANEL_SQL,
    TARGET_SQL,
    TIE,
    TRAINABLE_PARTS,
    at,
    finish,
    folds,
    freshest_sql,
    history,
    panel,
    staged_panel,
    table,
    target,
    with_sql,
)

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query(with_sql(TARGET_SQL, select="""
SELECT station_id, ds, round(y, 8) AS y, month(ds) IN (12, 1, 2) AS is_winter, month(ds) IN (3, 4, 5) AS is_spring,
       month(ds) IN (6, 7, 8) AS is_summer, month(ds) IN (9, 10, 11) AS is_autumn FROM target"""))
def q_season_flags(spark, sf):
    """Model frame: value and one flag per season."""
    return finish(X.model_frame(target(spark, sf), (STATION,), Y, DS), 8)


def _fourier_sql() -> str:
    cols = []
    hour, day = "0.0::DOUBLE", "(dayofyear(ds) - 1)"
    for k in (1, 2, 3):
        cols += [f"round(sin(2 * pi() * {k} * {hour} / 24), 8) AS daily_sin_{k}", f"round(cos(2 * pi() * {k} * {hour} / 24), 8) AS daily_cos_{k}"]
        cols += [f"round(sin(2 * pi() * {k} * {day} / 365.25), 8) AS annual_sin_{k}", f"round(cos(2 * pi() * {k} * {day} / 365.25), 8) AS annual_cos_{k}"]
    for d in ("sin", "cos"):
        for a in ("sin", "cos"):
            cols.append(f"round({d}({hour}) * {a}(2 * pi() * {day} / 365.25), 8) AS daily_{d}_1_x_annual_{a}_1")
    return "SELECT station_id, ds, round(date_diff('day', TIMESTAMP '1995-01-01', ds) / 365.25, 8) AS trend_years, " + ", ".join(cols) + " FROM target"


@query(with_sql(TARGET_SQL, select=_fourier_sql()))
def q_fourier_features(spark, sf):
    """Trend, daily and annual pairs and their products."""
    terms = X.calendar_features(DS, at("1995-01-01"))
    return finish(target(spark, sf).select(STATION, DS, *[c.alias(n) for n, c in terms.items()]), 8)


@query("""
WITH h AS (SELECT event_id, ts, hour(ts) + minute(ts) / 60.0::DOUBLE AS hour FROM events)
SELECT event_id, round(sin(2 * pi() * hour / 24), 8) AS daily_sin_1, round(cos(4 * pi() * hour / 24), 8) AS daily_cos_2,
       round(sin(2 * pi() * (dayofyear(ts) - 1 + hour / 24) / 365.25), 8) AS annual_sin_1,
       round(sin(2 * pi() * hour / 24) * cos(2 * pi() * (dayofyear(ts) - 1 + hour / 24) / 365.25), 8) AS daily_sin_1_x_annual_cos_1 FROM h""")
def q_fourier_hourly(spark, sf):
    """The same features within the day."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    terms = X.calendar_features("ts", at("2024-01-01"), 2, 1, 1)
    kept = ("daily_sin_1", "daily_cos_2", "annual_sin_1", "daily_sin_1_x_annual_cos_1")
    return finish(e.select("event_id", *[terms[n].alias(n) for n in kept]), 8)


_PAIRS_SQL = """pairs AS (
  SELECT p.*, t.y AS observed FROM panel p JOIN target t ON t.station_id = p.station_id AND t.ds = p.valid_time_utc
  WHERE p.init_time_utc < TIMESTAMP '2000-01-01' AND p.valid_time_utc < TIMESTAMP '2000-01-01' AND t.y IS NOT NULL)"""
KEY_SQL = "station_id, init_time_utc, valid_time_utc, l_orderkey, l_partkey, l_suppkey"


def _pairs(spark, sf):
    return V.training_pairs(panel(spark, sf), target(spark, sf), at("2000-01-01"), (STATION,), DS, Y, TIE)


@query(with_sql(PANEL_SQL, TARGET_SQL, _PAIRS_SQL, select=f"""
SELECT {KEY_SQL}, lead_hours, round(temperature_c, 8) AS gfs_temperature_c, round(observed, 8) AS observed_temperature_c,
       round(temperature_c - observed, 8) AS error_c FROM pairs"""))
def q_training_pairs(spark, sf):
    """Forecast and observation pairs with both clocks before the cutoff, and the forecast error."""
    rows = _pairs(spark, sf).withColumn("error_c", V.forecast_error())
    return finish(rows.select(STATION, INIT, VALID, "l_orderkey", "l_partkey", "l_suppkey", LEAD, "gfs_temperature_c", OBSERVED, "error_c"), 8)


@query(with_sql(PANEL_SQL, TARGET_SQL, _PAIRS_SQL, select=f"""
SELECT {KEY_SQL}, round(temperature_c, 8) AS gfs_temperature_c, round(lead_hours / 24, 8) AS lead_days, round(temperature_c * (lead_hours / 24), 6) AS gfs_x_lead_days,
       0.0::DOUBLE AS daily_sin_1, 1.0::DOUBLE AS daily_cos_1, 0.0::DOUBLE AS daily_sin_2, 1.0::DOUBLE AS daily_cos_2,
       round(sin(2 * pi() * (dayofyear(valid_time_utc) - 1) / 365.25), 8) AS annual_sin_1, round(cos(2 * pi() * (dayofyear(valid_time_utc) - 1) / 365.25), 8) AS annual_cos_1
FROM pairs"""))
def q_correction_features(spark, sf):
    """Forecast, lead, interaction and calendar terms of the linear correction."""
    rows = _pairs(spark, sf)
    terms = X.correction_features()
    return finish(rows.select(STATION, INIT, VALID, "l_orderkey", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in terms.items()]), 8, gfs_x_lead_days=6)


@query(with_sql(PANEL_SQL, TARGET_SQL, _PAIRS_SQL, select=f"""
SELECT {KEY_SQL}, round(temperature_c, 8) AS gfs_temperature_c, dewpoint_c AS gfs_dewpoint_c, round(wind_speed_ms, 6) AS gfs_wind_speed_ms, cloud_cover_pct AS gfs_cloud_cover_pct,
       precipitation_mm AS gfs_precipitation_mm, round(sin(radians(wind_direction_deg)), 8) AS gfs_wind_direction_sin, round(cos(radians(wind_direction_deg)), 8) AS gfs_wind_direction_cos,
       lead_hours::DOUBLE AS forecast_lead_hour, CAST(interpolated AS BIGINT) AS gfs_interpolated, 0.0::DOUBLE AS target_hour_sin, 1.0::DOUBLE AS target_hour_cos,
       round(sin(2 * pi() * dayofyear(valid_time_utc) / 365.25), 8) AS target_day_of_year_sin, round(cos(2 * pi() * dayofyear(valid_time_utc) / 365.25), 8) AS target_day_of_year_cos,
       round(observed - temperature_c, 8) AS residual_c FROM pairs"""))
def q_tree_features(spark, sf):
    """Thirteen tree features with circular encodings, and the residual label."""
    rows = _pairs(spark, sf)
    out = rows.select(STATION, INIT, VALID, "l_orderkey", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in X.tree_features(rows).items()], (F.col(OBSERVED) - F.col("gfs_temperature_c")).alias("residual_c"))
    return finish(out, 8, gfs_wind_speed_ms=6)


_FRESH = "round(gfs_temperature_c, 8) AS gfs_temperature_c, gfs_dewpoint_c, round(gfs_wind_speed_ms, 6) AS gfs_wind_speed_ms, round(gfs_wind_direction_deg, 4) AS gfs_wind_direction_deg, gfs_cloud_cover_pct, gfs_precipitation_mm, lead_hours, interpolated"
_DIGITS = {"gfs_temperature_c": 8, "gfs_wind_speed_ms": 6, "gfs_wind_direction_deg": 4}


@query(with_sql(PANEL_SQL, f"best AS (SELECT station_id, valid_time_utc, {freshest_sql()} FROM panel WHERE init_time_utc < TIMESTAMP '2000-01-01' GROUP BY ALL)",
                select=f"SELECT station_id, valid_time_utc, init_time_utc, {_FRESH} FROM best"))
def q_freshest_columnwise(spark, sf):
    """Freshest run per valid hour, each column's last non-null value, as of a cutoff."""
    rows = panel(spark, sf).filter(F.col(INIT) < at("2000-01-01"))
    best = V.freshest(V.prefixed(rows, (STATION, *TIE)), (STATION, VALID), TIE)
    return finish(best, **_DIGITS)


@query(with_sql(PANEL_SQL, select="""
SELECT station_id, valid_time_utc, init_time_utc, lead_hours, round(temperature_c, 8) AS temperature_c, dewpoint_c, l_orderkey, l_partkey, l_suppkey FROM panel
QUALIFY row_number() OVER (PARTITION BY station_id, valid_time_utc ORDER BY init_time_utc DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1"""))
def q_freshest_rowwise(spark, sf):
    """Whole row of the latest run per valid hour."""
    best = V.freshest_rows(panel(spark, sf), (STATION, VALID), TIE)
    return finish(best.select(STATION, VALID, INIT, LEAD, "temperature_c", "dewpoint_c", "l_orderkey", "l_partkey", "l_suppkey"), 8)


@query(with_sql(PANEL_SQL, TARGET_SQL, FOLDS_SQL, select="""
SELECT f.station_id, f.folds, f.cutoff, p.valid_time_utc, p.init_time_utc, p.lead_hours, round(p.temperature_c, 8) AS gfs_temperature_c, p.dewpoint_c AS gfs_dewpoint_c
FROM folds f JOIN panel p ON p.station_id = f.station_id AND p.valid_time_utc >= f.cutoff AND p.valid_time_utc < f.cutoff + INTERVAL 336 HOUR AND p.init_time_utc < f.cutoff
QUALIFY row_number() OVER (PARTITION BY f.station_id, f.folds, f.cutoff, p.valid_time_utc ORDER BY p.ord DESC) = 1"""))
def q_freshest_by_cutoff(spark, sf):
    """Whole row of the latest legitimate run per cutoff and valid hour, for every fold at once."""
    rows = V.forecast_window(panel(spark, sf), folds(history(spark, sf)), DAILY.hours, (STATION,), TIE, rowwise=True)
    return finish(rows.select(STATION, FOLDS, CUTOFF, VALID, INIT, LEAD, "gfs_temperature_c", "gfs_dewpoint_c"), 8)


@query(with_sql(PANEL_SQL, TARGET_SQL, ATTACHED_SQL, select=f"SELECT station_id, ds, round(y, 8) AS y, init_time_utc, {_FRESH} FROM attached".replace("lead_hours, interpolated", "lead_hours::DOUBLE AS lead_hours, interpolated::VARCHAR AS interpolated")))
def q_attach_left(spark, sf):
    """History with the freshest covariates there are; the rest stays null."""
    rows = V.attach_available(target(spark, sf), panel(spark, sf), None, (STATION,), TIE)
    # Nullable flags and counts are compared as text and doubles.
    rows = rows.withColumns({LEAD: F.col(LEAD).cast("double"), INTERPOLATED: F.col(INTERPOLATED).cast("string")})
    return finish(rows, y=8, **_DIGITS)


@query(with_sql(*BASE_SQL, FWINDOW_SQL, COVERED_SQL, select="SELECT * FROM covered"))
def q_covered_folds(spark, sf):
    """Folds with a complete, null-free legitimate forecast window."""
    return finish(V.covered_folds(panel(spark, sf), folds(history(spark, sf)), DAILY.hours, (STATION,), DAILY.step_hours))


@query(with_sql(*TRAINABLE_PARTS, select="SELECT * FROM trainable").replace("u.first_usable + INTERVAL 365 DAY", "u.first_usable + INTERVAL 1825 DAY"))
def q_trainable_folds(spark, sf):
    """Covered folds whose usable history spans five years."""
    past = history(spark, sf)
    rows = V.trainable_folds(past, staged_panel(spark, sf), folds(past), DAILY.hours, 1825, (STATION,), DAILY.step_hours)
    return finish(rows)


@query(with_sql(*BASE_SQL, ATTACHED_SQL, select="""
SELECT f.station_id, f.folds, f.cutoff, min(a.ds) AS first_usable, max(a.ds) AS last_usable, count(*) AS usable_hours
FROM folds f JOIN attached a ON a.station_id = f.station_id AND a.ds < f.cutoff AND a.y IS NOT NULL AND a.gfs_temperature_c IS NOT NULL GROUP BY ALL"""))
def q_usable_history(spark, sf):
    """First, last and number of usable training hours before every cutoff."""
    past = history(spark, sf)
    return finish(V.usable_span(past, panel(spark, sf), folds(past), (STATION,)))


@query(with_sql(TARGET_SQL, FOLDS_SQL, select="SELECT * FROM folds WHERE folds = 'rolling'"))
def q_rolling_cutoffs(spark, sf):
    """A cutoff every fortnight from one year in."""
    return finish(rolling_cutoffs(target(spark, sf), (STATION,), step_hours=24))


@query(with_sql(TARGET_SQL, FOLDS_SQL, select="SELECT * FROM folds WHERE folds = 'seasonal'"))
def q_seasonal_cutoffs(spark, sf):
    """Anniversaries of the data cutoff."""
    return finish(seasonal_cutoffs(target(spark, sf), at(DAY_END), (STATION,), step_hours=24))


@query(with_sql(TARGET_SQL, """
placed AS (SELECT station_id, ds, y, row_number() OVER (PARTITION BY station_id ORDER BY ds) - 1 AS position FROM target),
sizes AS (SELECT station_id, count(*) AS n FROM target GROUP BY 1),
f AS (SELECT station_id, unnest(generate_series(365, n - 14, 7)) AS origin FROM sizes)""", select="""
SELECT f.station_id, (f.origin - 365) // 7 + 1 AS fold, f.origin, f.origin AS train_rows, CAST(14 AS BIGINT) AS validation_rows, p.ds, round(p.y, 8) AS y, p.position, p.position - f.origin AS lead_position
FROM f JOIN placed p ON p.station_id = f.station_id AND p.position >= f.origin AND p.position < f.origin + 14"""))
def q_position_folds(spark, sf):
    """Expanding-window folds by row position, overlapping by half."""
    _, validation = position_folds(target(spark, sf), 365, 14, 7, (STATION,))
    return finish(validation, 8)


@query("""
WITH c AS (SELECT o_orderdate + to_hours(CAST(o_custkey % 24 AS INTEGER)) AS cutoff FROM orders),
d AS (SELECT cutoff, date_trunc('day', cutoff - INTERVAL 16 HOUR)::TIMESTAMP + INTERVAL 12 HOUR AS raw_init FROM c),
i AS (SELECT cutoff, CASE WHEN raw_init >= cutoff THEN raw_init - INTERVAL 1 DAY ELSE raw_init END AS init_time_utc FROM d),
r AS (SELECT init_time_utc, max(cutoff) AS cutoff FROM i GROUP BY 1),
l AS (SELECT *, list_filter(generate_series(date_diff('hour', init_time_utc, cutoff), date_diff('hour', init_time_utc, cutoff) + 336), lambda x: x <= 120 OR (x >= 123 AND x % 3 = 0)) AS leads FROM r)
SELECT init_time_utc, cutoff, CAST(len(leads) AS BIGINT) AS n_leads, leads[1] AS first_lead, leads[-1] AS last_lead, CAST(list_sum(leads) AS BIGINT) AS lead_sum,
       strftime(init_time_utc, '%Y%m%dT%H%MZ') AS slug, 'f' || lpad(CAST(leads[1] AS VARCHAR), 3, '0') AS first_label, init_time_utc + to_hours(CAST(leads[-1] AS INTEGER)) AS last_valid FROM l""")
def q_run_plan(spark, sf):
    """Distinct runs for many cutoffs and the leads that span each horizon."""
    o = table(spark, sf, "orders")
    cutoffs = o.select(C.plus_hours(F.col("o_orderdate").cast("timestamp"), (F.col("o_custkey") % 24).cast("int")).alias(CUTOFF))
    plan = S.run_plan(cutoffs, at("2002-01-01"))
    ends = plan.withColumns({"first_lead": F.get("leads", F.lit(0)), "last_lead": F.try_element_at("leads", F.lit(-1))})
    return finish(
        ends.select(
            INIT,
            CUTOFF,
            F.size("leads").alias("n_leads"),
            "first_lead",
            "last_lead",
            F.aggregate("leads", F.lit(0).cast("long"), lambda a, x: a + x).alias("lead_sum"),
            C.run_slug(INIT).alias("slug"),
            C.lead_label("first_lead").alias("first_label"),
            C.plus_hours(F.col(INIT), F.col("last_lead")).alias("last_valid"),
        )
    )


@query("""
WITH w AS (SELECT o_custkey, min(o_orderdate) AS s, max(o_orderdate) + INTERVAL 5 HOUR AS e FROM orders GROUP BY 1),
y AS (SELECT o_custkey, unnest(list_concat([s], list_filter(generate_series(date_trunc('year', s)::TIMESTAMP, e, INTERVAL 1 YEAR), lambda x: x > s AND x < e))) AS chunk_start, e FROM w),
f AS (SELECT o_custkey, unnest(list_concat([s], list_filter(generate_series(s, e, INTERVAL 90 DAY), lambda x: x > s AND x < e))) AS chunk_start, e FROM w)
SELECT 'year' AS kind, o_custkey, chunk_start, coalesce(lead(chunk_start) OVER (PARTITION BY o_custkey ORDER BY chunk_start), e) AS chunk_end FROM y
UNION ALL SELECT 'days', o_custkey, chunk_start, coalesce(lead(chunk_start) OVER (PARTITION BY o_custkey ORDER BY chunk_start), e) FROM f""")
def q_time_chunks(spark, sf):
    """Calendar-year and 90-day half-open chunks of every customer's order window."""
    day = F.col("o_orderdate").cast("timestamp")
    w = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(day).alias("start"), C.plus_hours(F.max(day), 5).alias("end"))
    years = S.calendar_years(w).select(F.lit("year").alias("kind"), "o_custkey", "chunk_start", "chunk_end")
    days = S.fixed_days(w, 90).select(F.lit("days").alias("kind"), "o_custkey", "chunk_start", "chunk_end")
    return finish(years.unionByName(days))


@query("""
WITH m AS (SELECT source AS file, doc_id * 70000 AS s, lang || ':' || CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS key FROM documents WHERE source <> 'src3'),
e AS (SELECT *, lead(s) OVER (PARTITION BY file ORDER BY s) - 1 AS e FROM m)
SELECT file, key, min(s) AS "start", arg_min(coalesce(e, -1), s) AS "end", CAST(min(s) AS VARCHAR) || '-' || CASE WHEN arg_min(coalesce(e, -1), s) < 0 THEN '' ELSE CAST(arg_min(coalesce(e, -1), s) AS VARCHAR) END AS byte_range
FROM e GROUP BY ALL""")
def q_index_ranges(spark, sf):
    """Sidecar index lines to the byte range of the first message per key; malformed lines skipped."""
    d = table(spark, sf, "documents")
    level = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    whole = F.concat_ws(":", F.col("doc_id").cast("string"), (F.col("doc_id") * 70000).cast("string"), F.lit("d=2024010100"), "lang", level, F.lit("anl"), F.lit(""))
    line = F.when(F.col("source") == "src3", F.concat(F.col("doc_id").cast("string"), F.lit(":unreadable"))).otherwise(whole)
    ranges = S.index_ranges(d.select(F.col("source").alias("file"), line.alias("line")))
    return finish(ranges.withColumn("end", F.coalesce("end", F.lit(-1).cast("long"))))


@query(with_sql(PANEL_SQL, select="""
SELECT DISTINCT 'lineitem' AS source, station_id, init_time_utc, lead_hours FROM panel p
WHERE NOT EXISTS (SELECT 1 FROM panel s WHERE s.interpolated AND s.station_id = p.station_id AND s.init_time_utc = p.init_time_utc AND s.lead_hours = p.lead_hours)"""))
def q_anti_resume(spark, sf):
    """Planned leads that are not stored yet."""
    rows = panel(spark, sf)
    planned = rows.select(SOURCE, STATION, INIT, LEAD).distinct()
    return finish(S.missing_leads(planned, rows.filter("interpolated")))


@query(with_sql(PANEL_SQL, TARGET_SQL, _PAIRS_SQL, select="""
SELECT 'gfs_temperature_c' AS "column", count(*) FILTER (WHERE temperature_c IS NULL) AS missing, CAST(0 AS BIGINT) AS infinite, count(*) AS "rows" FROM pairs
UNION ALL SELECT 'gfs_dewpoint_c', count(*) FILTER (WHERE dewpoint_c IS NULL), 0, count(*) FROM pairs
UNION ALL SELECT 'bearing_ratio', 0, count(*) FILTER (WHERE wind_direction_deg = 0), count(*) FROM pairs
UNION ALL SELECT 'observed_temperature_c', count(*) FILTER (WHERE observed IS NULL), 0, count(*) FROM pairs"""))
def q_contracts(spark, sf):
    """Missing and infinite counts per feature and label, in one aggregate."""
    ratio = F.when(F.col("gfs_wind_direction_deg") == 0, F.lit(float("inf"))).otherwise(F.col("gfs_wind_direction_deg"))
    rows = _pairs(spark, sf).withColumn("bearing_ratio", ratio)
    return finish(violations(rows, ["gfs_temperature_c", "gfs_dewpoint_c", "bearing_ratio"], OBSERVED))


@query(with_sql(PANEL_SQL, select="""
SELECT l_orderkey, l_partkey, l_suppkey, init_time_utc, init_time_utc = max(init_time_utc) OVER (PARTITION BY station_id) AS is_validation, station_id FROM panel"""))
def q_holdout_run(spark, sf):
    """Rows of each station's latest run flagged as its validation block."""
    rows = panel(spark, sf).select(STATION, INIT, "l_orderkey", "l_partkey", "l_suppkey")
    return finish(V.latest_run_block(rows, (STATION,)))
