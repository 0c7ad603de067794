"""Scans: landed files to raw DataFrames, configuration to dimension tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridcast.functions import convert as C
from gridcast.functions.vocabulary import INIT, SOURCE, STATION, TS, VALID
from gridcast.sources.specs import SourceSpec

ARRIVAL = "_order"


def _all_strings(spark: SparkSession, path: str, comment: str | None = None, glob: str | None = None) -> DataFrame:
    """CSV with a header, every column text: typing is explicit and bad text becomes null later."""
    # A file whose header differs fails loudly instead of being read by position.
    reader = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False)
    if comment:
        reader = reader.option("comment", comment)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.csv(path)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob, by name; a directory listing, no data is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in found or [])


def latest_csv(spark: SparkSession, folder: str, spec: SourceSpec, pattern: str = "weather_*.csv") -> DataFrame:
    """Rows of the newest file (or written folder) by name in ``folder/<source>``, with their arrival order.

    Arrival order (file position) decides ties between equal timestamps, as a
    stable sort would.
    """
    candidates = listed(spark, f"{folder.rstrip('/')}/{spec.name}/{pattern}")
    if not candidates:
        raise FileNotFoundError(f"No raw CSV for {spec.name} beneath {folder}.")
    rows = _all_strings(spark, candidates[-1], spec.comment)
    # Splits may be scheduled in any order, so file and offset come before the row number.
    order = F.struct(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row")
    )
    return rows.select("*", order.alias(ARRIVAL)).withColumn(TS, C.instant(TS))


def forecast_runs(spark: SparkSession, folder: str, pattern: str = "gfs_*.csv", partial: str = ".partial.csv") -> DataFrame:
    """Every finished run file; unfinished checkpoints are left out."""
    if not any(not p.endswith(partial) for p in listed(spark, f"{folder.rstrip('/')}/{pattern}")):
        raise FileNotFoundError(f"No forecast runs beneath {folder}.")
    rows = _all_strings(spark, folder, glob=pattern)
    finished = rows.filter(~F.col("_metadata.file_name").endswith(partial))
    return finished.withColumns({INIT: C.instant(INIT), VALID: C.instant(VALID)})


def parquet_table(spark: SparkSession, path: str, made_by: str = "the job that writes it") -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"No table at {path}; run {made_by} first.") from error


def registry(spark: SparkSession, config_path: str) -> DataFrame:
    """Station dimension: one row per (namespace, alias), with coordinates."""
    config = spark.read.option("multiLine", True).json(config_path)
    airports = config.select(F.explode("airport_stations").alias("s"))
    keyed = [("ghcnh", "ghcnh_id"), ("iem", "iem_id"), ("airport", "icao")]
    aliases = F.array(*[F.struct(F.lit(n).alias("namespace"), F.col(f"s.{c}").alias("alias")) for n, c in keyed])
    shared = ("name", "latitude", "longitude")
    present = set(airports.schema["s"].dataType.names)

    def attributes(names: set[str]) -> list:
        return [F.col(f"s.{c}").alias(c) if c in names else F.lit(None).alias(c) for c in shared]

    rows = airports.select(F.explode(aliases).alias("a"), F.col("s.icao").alias(STATION), *attributes(present))
    rows = rows.select("a.namespace", "a.alias", STATION, *shared)
    if "econet_stations" in config.columns:
        fields = config.select(F.explode("econet_stations").alias("s"))
        named = set(fields.schema["s"].dataType.names)
        more = fields.select(F.lit("econet").alias("namespace"), F.col("s.id").alias("alias"), F.col("s.id").alias(STATION), *attributes(named))
        rows = rows.unionByName(more)
    return rows.withColumns({"latitude": F.col("latitude").cast("double"), "longitude": F.col("longitude").cast("double")})


def job_settings(spark: SparkSession, config_path: str) -> dict:
    """Scalar settings of a configuration document; the cutoff is where history ends."""
    text = spark.read.text(config_path, wholetext=True).first()[0]
    config = json.loads(text)
    history = config["history"]
    return config | {"start_utc": history["start_utc"], "end_utc": history["end_utc"], "cutoff": history["end_utc"], "zone": history.get("local_timezone", "UTC")}


def station_coordinates(stations: DataFrame, station: str) -> tuple[float, float]:
    row = stations.filter((F.col("namespace") == "airport") & (F.col(STATION) == station)).select("latitude", "longitude").first()
    if row is None:
        raise ValueError(f"No airport station {station!r} is configured.")
    return row["latitude"], row["longitude"]


# --- shaping of landed publisher files -----------------------------------------

# Columns that identify a station-year row, and per-variable attributes.
YEAR_IDENTITY = ("DATE", "STATION", "NAME", "LATITUDE", "LONGITUDE", "ELEVATION")
YEAR_ATTRIBUTES = ("_Measurement_Code", "_Quality_Code", "_Report_Type", "_Source_Code", "_Source_Station_ID")


def station_year(files: DataFrame, stations: DataFrame, variables: Sequence[str], start, end, report_type: str = "FM15") -> DataFrame:
    """Station-year Parquet rows: one report type, the window, configured columns only."""
    wanted = {c for v in variables for c in (v, *[f"{v}{a}" for a in YEAR_ATTRIBUTES])}
    kept = [c for c in files.columns if c in YEAR_IDENTITY] + [c for c in files.columns if c in wanted]
    stamped = files.withColumn(TS, C.instant("DATE"))
    rows = stamped.filter((F.col("temperature_Report_Type") == report_type) & (F.col(TS) >= start) & (F.col(TS) < end))
    names = stations.filter("namespace = 'ghcnh'").select(
        F.col("alias").alias("STATION"), F.col("alias").alias(STATION), F.col("name").alias("station_name_config"), F.col(STATION).alias("station_icao")
    )
    return rows.select(*kept, TS).join(names, "STATION")


def metar_rows(files: DataFrame, stations: DataFrame) -> DataFrame:
    """METAR CSV rows: parse ``valid``, keep the publisher's station, attach its name."""
    names = stations.filter("namespace = 'iem'").select(F.col("alias").alias("station"), F.col("name").alias("station_name_config"))
    shaped = files.withColumns({TS: C.instant("valid"), STATION: F.col("station")})
    return shaped.join(names, "station", "left")


def long_rows(files: DataFrame, stations: DataFrame) -> DataFrame:
    """Long graded CSV rows: location and datetime renamed, name attached."""
    names = stations.filter("namespace = 'econet'").select(F.col("alias").alias("location"), F.col("name").alias("station_name_config"))
    shaped = files.withColumns({TS: C.instant("datetime"), STATION: F.col("location")})
    return shaped.join(names, "location", "left")


def payload_schema(variables: Sequence[str]) -> T.ArrayType:
    hourly = [T.StructField("time", T.ArrayType(T.StringType()))]
    hourly += [T.StructField(v, T.ArrayType(T.DoubleType())) for v in variables]
    location = [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("elevation", T.DoubleType()),
        T.StructField("hourly", T.StructType(hourly)),
    ]
    return T.ArrayType(T.StructType(location))


def location_payload(payloads: DataFrame, stations: Sequence[dict], variables: Sequence[str], model: str, body: str = "body", carry: Sequence[str] = ()) -> DataFrame:
    """JSON payloads (one object per location, parallel hourly arrays) to one row per hour.

    Locations arrive in the order the stations were requested in; any other
    location count is an error. ``carry`` keeps payload columns.
    """
    text = F.trim(F.col(body))
    as_list = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    parsed = payloads.select(*carry, F.from_json(as_list, payload_schema(variables)).alias("locations"))
    counted = parsed.withColumn(
        "locations",
        F.when(F.size("locations") == len(stations), F.col("locations")).otherwise(
            F.raise_error(F.lit("The payload has an unexpected location count."))
        ),
    )
    asked = F.array(*[
        F.struct(
            F.lit(s["ghcnh_id"]).alias(STATION),
            F.lit(s.get("name")).alias("station_name_config"),
            F.lit(float(s["latitude"])).alias("requested_latitude"),
            F.lit(float(s["longitude"])).alias("requested_longitude"),
        )
        for s in stations
    ])
    # The outer form: an inner explode would add a size filter that parses the text again.
    located = counted.select(*carry, F.posexplode_outer("locations").alias("at", "l")).withColumn("s", F.get(asked, F.col("at")))
    arrays = F.arrays_zip(F.col("l.hourly.time").alias("time"), *[F.col(f"l.hourly.{v}").alias(v) for v in variables])
    return located.select(*carry, "s", "l", F.explode(arrays).alias("h")).select(
        *carry,
        C.instant("h.time").alias(TS),
        *[F.col(f"h.{v}").alias(v) for v in variables],
        "s.*",
        F.col("l.latitude").alias("grid_latitude"),
        F.col("l.longitude").alias("grid_longitude"),
        F.col("l.elevation").alias("grid_elevation_m"),
        F.lit(model).alias("model"),
    )


def tag_source(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.lit(name).alias(SOURCE), *[c for c in rows.columns if c != SOURCE])
