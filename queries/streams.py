"""Streaming queries: the given tables replayed as file streams through the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions.vocabulary import DS, INIT, LEAD, OBSERVED, SOURCE, STATION, TS, VALID, Y
from gridcast.operators import align as A
from gridcast.session import cut_lineage, pin_utc, shared_dir
from gridcast.streaming import streams as S
from queries.bindings import OBS_SQL, PANEL_SQL, TARGET_SQL, TIE, finish, freshest_sql, history, panel, readings, table, with_sql
from queries.observations import ALIGNED_SQL, STUCK_SQL

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _event_stream(spark, sf):
    """The events file as a stream of readings."""
    schema = table(spark, sf, "events").schema
    e = S.file_stream(pin_utc(spark), sf, schema, glob="events.parquet")
    return e.select(
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias(SOURCE),
        F.col("event_type").alias(STATION),
        F.col("ts").cast("timestamp").alias(TS),
        "event_id",
        F.col("value").alias("temperature_c"),
        F.get_json_object("props", "$.k").try_cast("double").alias("dewpoint_c"),
    )


def _run_stream(spark, sf):
    """Forecast rows landed as files, then read as a stream."""
    rows = panel(spark, sf)
    folder = shared_dir(spark, "runs")
    rows.write.parquet(folder)
    return S.file_stream(spark, folder, rows.schema)


@query(with_sql(OBS_SQL, select="""
SELECT source, station_id, date_trunc('hour', timestamp_utc)::TIMESTAMP AS timestamp_utc, arg_max(temperature_c, row(timestamp_utc, event_id)) AS temperature_c,
       arg_max(dewpoint_c, row(timestamp_utc, event_id)) FILTER (WHERE dewpoint_c <= 50) AS dewpoint_c
FROM obs GROUP BY ALL"""))
def q_stream_collapse(spark, sf):
    """Streaming hour collapse; the log holds every cell, closed or still open."""
    stream = _event_stream(spark, sf).withColumn("dewpoint_c", F.when(F.col("dewpoint_c") <= 50, F.col("dewpoint_c")))
    cells = S.collapse_stream(stream, ["temperature_c", "dewpoint_c"], delay="40 days", tiebreak=["event_id"])
    return finish(S.drain(cells, (SOURCE, STATION, TS)))


@query(with_sql(PANEL_SQL, select=f"""
SELECT * REPLACE (round(temperature_c, 8) AS temperature_c, round(wind_speed_ms, 6) AS wind_speed_ms, round(wind_direction_deg, 4) AS wind_direction_deg)
FROM (SELECT station_id, valid_time_utc, {freshest_sql().replace('gfs_', '')} FROM panel GROUP BY ALL)"""))
def q_stream_freshest(spark, sf):
    """Freshest run per station and valid hour as runs arrive."""
    rows = S.freshest_stream(_run_stream(spark, sf).drop(SOURCE), delay="3650 days", tiebreak=list(TIE))
    return finish(S.drain(rows, (STATION, VALID)), temperature_c=8, wind_speed_ms=6, wind_direction_deg=4)


@query(with_sql(PANEL_SQL, TARGET_SQL, select="""
SELECT p.station_id, CAST(floor(date_diff('day', init_time_utc, valid_time_utc)) + 1 AS BIGINT) AS lead_day, date_trunc('day', valid_time_utc)::TIMESTAMP AS window_start,
       round(avg(abs(temperature_c - t.y)), 7) AS mae_c, count(*) AS pairs
FROM panel p JOIN target t ON t.station_id = p.station_id AND t.ds = p.valid_time_utc WHERE t.y IS NOT NULL GROUP BY ALL"""))
def q_stream_pairs(spark, sf):
    """Forecasts paired with observations as they arrive, error monitored by day and lead day."""
    seen = history(spark, sf).select(STATION, F.col(DS).alias(VALID), F.col(Y).alias(OBSERVED))
    runs = _run_stream(spark, sf).select(STATION, INIT, VALID, LEAD, F.col("temperature_c").alias("gfs_temperature_c"))
    timed = S.event_time(runs, VALID, "3650 days")
    monitor = S.error_stream(S.pairs_stream(timed, seen, watermarked=True), "1 day", (STATION,))
    return finish(S.drain(monitor, (STATION, "window_start", "lead_day")), 7)


@query(with_sql(OBS_SQL, ALIGNED_SQL, STUCK_SQL, select="SELECT source, station_id, timestamp_utc FROM sized WHERE stuck"))
def q_stream_flatline(spark, sf):
    """Hours inside a day-long run of equal hourly readings, from streaming windows; every third reading lands twice."""
    cells = A.collapse(readings(spark, sf), ["temperature_c"], tiebreak=["event_id"])
    stepped = cells.withColumn("temperature_c", F.floor(F.col("temperature_c") / 150).cast("double"))
    folder = shared_dir(spark, "hourly")
    stepped.write.parquet(folder)
    stepped.where(F.hour(TS) % 3 == 0).write.mode("append").parquet(folder)
    stream = S.file_stream(spark, folder, stepped.schema)
    alarms = S.drain(S.flatline_stream(stream, "temperature_c", 24, delay="40 days"), (SOURCE, STATION, "run_start"))
    return finish(S.stuck_hours(alarms))


@query(with_sql(PANEL_SQL, select="""
SELECT station_id, init_time_utc, lead_hours, count(*) > 0 AS stored FROM panel GROUP BY ALL"""))
def q_stream_ingest(spark, sf):
    """Incremental ingestion of run files: every (run, lead) stored once however often it arrives."""
    rows = panel(spark, sf).select(SOURCE, STATION, INIT, VALID, LEAD, "temperature_c")
    folder, out, mark = (shared_dir(spark, n) for n in ("landed", "stored", "mark"))
    late = F.col(INIT) < F.lit("1996-01-01").cast("timestamp")
    # Old runs land after new ones, and with them some that are stored already.
    for landed in (rows.where(~late), rows.where(late | (F.col(LEAD) % 7 == 0)), None):
        if landed is not None:
            landed.write.mode("append").parquet(folder)
        # The last call finds nothing new and must not store anything again.
        S.ingest_runs(spark, folder, rows.schema, out, mark, "*.parquet", "parquet").awaitTermination()
    stored = cut_lineage(spark.read.parquet(out)).groupBy(STATION, INIT, LEAD).agg((F.count(F.lit(1)) == 1).alias("stored"))
    return finish(stored)

