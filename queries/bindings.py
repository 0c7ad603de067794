"""The given tables shaped as sensor readings, forecast runs and a daily target.

B1  events   -> raw readings (source by user parity, station by event type or user)
B2  lineitem x orders -> two-clock forecast rows (issued at the order, valid at the shipment)
B3  orders   -> daily target per station on a complete day grid
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridcast.functions.vocabulary import DS, INIT, INTERPOLATED, LEAD, SOURCE, STATION, TS, VALID, Y
from gridcast.operators.align import grid
from gridcast.operators.folds import number_folds
from gridcast.plans.registry import Setup, fold_sets
from gridcast.session import cut_lineage, pin_utc, spread

OBS_START, OBS_END = "2024-01-01", "2024-01-31"
DAY_START, DAY_END = "1995-01-01", "2001-08-02"
TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
DAILY = Setup(hours=336, step_hours=24, keys=(STATION,), tiebreak=TIE, on_short="drop")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf}/{name}.parquet")


def at(text: str):
    return F.lit(text).cast("timestamp")


def finish(df: DataFrame, digits: int | None = None, **rounded: int) -> DataFrame:
    """Plain comparable types: instants without zone, long integers, rounded doubles."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DoubleType):
            places = rounded.get(f.name, digits)
            c = c if places is None else F.round(c, places)
        out.append(c.alias(f.name))
    return df.select(*out)


def readings(spark: SparkSession, sf: str, station: str = "event_type") -> DataFrame:
    """B1: raw readings; the event id breaks ties between equal instants."""
    e = table(spark, sf, "events")
    return e.select(
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias(SOURCE),
        F.col(station).cast("string").alias(STATION),
        F.col("ts").cast("timestamp").alias(TS),
        "event_id",
        F.col("value").alias("temperature_c"),
        F.get_json_object("props", "$.k").try_cast("double").alias("dewpoint_c"),
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """B2: forecast rows; a shipment at or before its order breaks the two-clock rule and is no forecast."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias(INIT))
    l = table(spark, sf, "lineitem")
    joined = l.join(o, l.l_orderkey == o.o_orderkey).withColumn(VALID, F.col("l_shipdate").cast("timestamp"))
    rows = joined.filter(F.col(VALID) > F.col(INIT))
    return rows.select(
        F.lit("lineitem").alias(SOURCE),
        F.col("o_orderpriority").alias(STATION),
        INIT,
        VALID,
        F.timestamp_diff("HOUR", INIT, VALID).cast("int").alias(LEAD),
        F.log("l_extendedprice").alias("temperature_c"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("dewpoint_c"),
        (F.col("l_discount") * 100).alias("wind_speed_ms"),
        (F.col("l_tax") * 4000).alias("wind_direction_deg"),
        (F.col("l_linenumber") * 10.0).alias("cloud_cover_pct"),
        (F.col("l_quantity") / 4).alias("precipitation_mm"),
        (F.col("l_linestatus") == "F").alias(INTERPOLATED),
        *TIE,
    )


def target(spark: SparkSession, sf: str) -> DataFrame:
    """B3: mean log order value per station and day on the whole day grid, gaps null."""
    o = table(spark, sf, "orders")
    rows = o.select(
        F.col("o_orderpriority").alias(STATION),
        F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias(DS),
        F.log("o_totalprice").alias(Y),
    )
    skeleton = grid(spread(rows.select(STATION).distinct(), STATION), at(DAY_START), at(DAY_END), DS, "1 day")
    return rows.unionByName(skeleton, allowMissingColumns=True).groupBy(STATION, DS).agg(F.avg(Y).alias(Y))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """B3 written once: models read it several times and must not rebuild it each time."""
    return cut_lineage(target(spark, sf))


def staged_panel(spark: SparkSession, sf: str) -> DataFrame:
    """B2 written once, for queries that read it more than once."""
    return cut_lineage(panel(spark, sf))


def folds(past: DataFrame) -> DataFrame:
    """Rolling and seasonal cutoffs of B3, a small table that is written once."""
    return cut_lineage(number_folds(fold_sets(past, at(DAY_END), DAILY), (STATION,)))


def trainable(past: DataFrame, runs: DataFrame) -> DataFrame:
    """The folds a covariate model can be trained for."""
    return cut_lineage(number_folds(fold_sets(past, at(DAY_END), DAILY, panel=runs), (STATION,)))


# --- the same bindings as SQL -----------------------------------------------------

OBS_SQL = """obs AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, event_type AS station_id, CAST(user_id AS VARCHAR) AS user_station,
         ts AS timestamp_utc, event_id, value AS temperature_c, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS dewpoint_c
  FROM events)"""

PANEL_SQL = """panel AS (
  SELECT o_orderpriority AS station_id, o_orderdate AS init_time_utc, l_shipdate AS valid_time_utc,
         date_diff('hour', o_orderdate, l_shipdate) AS lead_hours, ln(l_extendedprice) AS temperature_c,
         CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS dewpoint_c, l_discount * 100 AS wind_speed_ms,
         l_tax * 4000 AS wind_direction_deg, l_linenumber * 10.0::DOUBLE AS cloud_cover_pct, l_quantity / 4 AS precipitation_mm,
         l_linestatus = 'F' AS interpolated, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         row(o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate)"""

TARGET_SQL = f"""days AS (SELECT unnest(generate_series(TIMESTAMP '{DAY_START}', TIMESTAMP '{DAY_END}' - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS ds),
stations AS (SELECT DISTINCT o_orderpriority AS station_id FROM orders),
daily AS (SELECT o_orderpriority AS station_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ds, avg(ln(o_totalprice)) AS y FROM orders GROUP BY ALL),
target AS (SELECT s.station_id, d.ds, daily.y FROM stations s CROSS JOIN days d LEFT JOIN daily ON daily.station_id = s.station_id AND daily.ds = d.ds)"""

FOLDS_SQL = f"""spans AS (SELECT station_id, min(ds) AS first_ds, max(ds) + INTERVAL 1 DAY AS end_ds FROM target GROUP BY 1),
folds AS (
  SELECT station_id, 'rolling' AS folds, unnest(generate_series(first_ds + INTERVAL 365 DAY, end_ds - INTERVAL 14 DAY, INTERVAL 14 DAY)) AS cutoff FROM spans
  UNION ALL
  SELECT station_id, 'seasonal' AS folds, TIMESTAMP '{DAY_END}' - to_years(CAST(n AS INTEGER)) AS cutoff
  FROM spans, generate_series(1, 40) g(n)
  WHERE TIMESTAMP '{DAY_END}' - to_years(CAST(n AS INTEGER)) >= first_ds + INTERVAL 365 DAY
    AND TIMESTAMP '{DAY_END}' - to_years(CAST(n AS INTEGER)) + INTERVAL 14 DAY <= end_ds)"""

_MEASURES = ("temperature_c", "dewpoint_c", "wind_speed_ms", "wind_direction_deg", "cloud_cover_pct", "precipitation_mm")


def freshest_sql(prefix: str = "") -> str:
    """Column-wise last non-null by issue time, then row key."""
    cols = ("lead_hours", "interpolated")
    parts = [f"arg_max({p}{c}, {p}ord) FILTER (WHERE {p}{c} IS NOT NULL) AS {c}" for p in (prefix,) for c in cols]
    parts += [f"arg_max({prefix}{c}, {prefix}ord) FILTER (WHERE {prefix}{c} IS NOT NULL) AS gfs_{c}" for c in _MEASURES]
    return f"max({prefix}init_time_utc) AS init_time_utc, " + ", ".join(parts)


FWINDOW_SQL = f"""fwindow AS (
  SELECT f.station_id, f.folds, f.cutoff, p.valid_time_utc, {freshest_sql('p.')}
  FROM folds f JOIN panel p ON p.station_id = f.station_id AND p.valid_time_utc >= f.cutoff
   AND p.valid_time_utc < f.cutoff + INTERVAL 336 HOUR AND p.init_time_utc < f.cutoff
  GROUP BY f.station_id, f.folds, f.cutoff, p.valid_time_utc)"""

COVERED_SQL = """covered AS (
  SELECT station_id, folds, cutoff FROM fwindow GROUP BY ALL
  HAVING count(*) = 14 AND count(*) FILTER (WHERE gfs_dewpoint_c IS NULL OR gfs_temperature_c IS NULL) = 0)"""

ATTACHED_SQL = f"""best AS (SELECT station_id, valid_time_utc AS ds, {freshest_sql()} FROM panel GROUP BY station_id, valid_time_utc),
attached AS (SELECT t.station_id, t.ds, t.y, b.* EXCLUDE (station_id, ds) FROM target t LEFT JOIN best b ON b.station_id = t.station_id AND b.ds = t.ds)"""

TRAINABLE_SQL = """usable AS (
  SELECT f.station_id, f.folds, f.cutoff, min(a.ds) AS first_usable, max(a.ds) AS last_usable, count(*) AS usable_hours
  FROM folds f JOIN attached a ON a.station_id = f.station_id AND a.ds < f.cutoff AND a.y IS NOT NULL AND a.gfs_temperature_c IS NOT NULL
  GROUP BY ALL),
trainable AS (
  SELECT c.station_id, c.folds, c.cutoff FROM covered c JOIN usable u USING (station_id, folds, cutoff)
  WHERE u.last_usable >= u.first_usable + INTERVAL 365 DAY)"""


def with_sql(*parts: str, select: str) -> str:
    recursive = "RECURSIVE " if any("UNION ALL (" in p for p in parts) else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + select


BASE_SQL = (PANEL_SQL, TARGET_SQL, FOLDS_SQL)
TRAINABLE_PARTS = (PANEL_SQL, TARGET_SQL, FOLDS_SQL, FWINDOW_SQL, COVERED_SQL, ATTACHED_SQL, TRAINABLE_SQL)
