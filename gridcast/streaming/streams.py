"""Structured Streaming versions of the collapse, freshest-run, pairing and stuck-sensor operators.

Streams end in an upsert log: every micro-batch writes its changed keys to its
own folder, so a replayed batch overwrites itself, and ``latest`` reads the
newest version of each key. Checkpoints and logs live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from gridcast.functions.vocabulary import INIT, LEAD, OBSERVED, SOURCE, STATION, TS, VALID
from gridcast.operators.align import last_known
from gridcast.operators.covariates import forecast_error
from gridcast.session import shared_dir

BATCH = "batch_id"


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", glob: str | None = None, files_per_batch: int | None = None, **options) -> DataFrame:
    """New files beneath a folder, in arrival order."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(folder)


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermark needs an instant: a timestamp without zone is read as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def upsert_log(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write each micro-batch to its own folder; replaying a batch replaces it."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest logged version of every key."""
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c not in (*keys, BATCH)]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_row")).select(*keys, "_row.*")


def drain(df: DataFrame, keys: Sequence[str], out: str | None = None, checkpoint: str | None = None, mode: str = "update") -> DataFrame:
    """Run everything available now through the log and return the current state as a batch table."""
    spark = df.sparkSession
    path = out or shared_dir(spark, "stream-log")
    mark = checkpoint or shared_dir(spark, "stream-checkpoint")
    upsert_log(df, path, mark, mode).awaitTermination()
    return latest(spark, path, keys)


def ingest_runs(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, glob: str = "gfs_*.csv", fmt: str = "csv") -> StreamingQuery:
    """Incremental run ingestion: finished files are read once, a restart resumes, every lead of a run is stored once.

    A batch stores what no other batch has stored, in a folder of its own that a
    replay overwrites. Runs may arrive in any order and however late.
    """
    options = {"header": "true"} if fmt == "csv" else {}
    rows = file_stream(spark, folder, schema, fmt, glob, **options)
    rows = rows.filter(~F.col("_metadata.file_name").endswith(".partial.csv"))
    timed = rows.withColumns({c: F.col(c).cast("timestamp") for c in (INIT, VALID)})
    keys = [SOURCE, STATION, INIT, LEAD]
    # An empty first folder lets every batch read what is stored already.
    spark.createDataFrame([], timed.schema).write.mode("overwrite").parquet(f"{out}/{BATCH}=-1")

    def store(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        known = own.read.schema(T.StructType([*timed.schema.fields, T.StructField(BATCH, T.LongType())])).parquet(out).where(F.col(BATCH) != batch_id)
        known = known.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        batch.dropDuplicates(keys).join(known, same, "left_anti").write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    return timed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()


def collapse_stream(sdf: DataFrame, measures: Sequence[str], keys: Sequence[str] = (SOURCE, STATION), ts: str = TS, delay: str = "2 hours", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Tumbling hours with the last non-null value per measure; rows later than the watermark are dropped."""
    timed = event_time(sdf, ts, delay)
    order = F.struct(ts, *tiebreak) if tiebreak else F.col(ts)
    cells = timed.groupBy(*keys, F.window(ts, "1 hour").alias("_w")).agg(*[last_known(m, order).alias(m) for m in measures])
    return cells.select(*keys, F.col("_w.start").alias(ts), *measures)


def freshest_stream(sdf: DataFrame, by: Sequence[str] = (STATION, VALID), valid: str = VALID, delay: str = "16 days", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Freshest run per key as runs arrive; state for a valid hour is kept until it leaves the watermark."""
    timed = event_time(sdf, valid, delay).withColumn(INIT, F.col(INIT).cast("timestamp"))
    order = F.struct(INIT, *tiebreak) if tiebreak else F.col(INIT)
    rest = [c for c in timed.columns if c not in (*by, INIT, *tiebreak)]
    return timed.groupBy(*by).agg(F.max(INIT).alias(INIT), *[last_known(c, order).alias(c) for c in rest])


def pairs_stream(forecasts: DataFrame, observations: DataFrame, keys: Sequence[str] = (STATION,), cutoff: Column | None = None, delay: str = "16 days", watermarked: bool = False) -> DataFrame:
    """Forecast and observation pairs as data arrive.

    With a static observation table this is a stream-static join; with a
    stream both sides carry watermarks on the valid hour, which bounds state.
    ``watermarked`` says the forecasts carry theirs already.
    """
    left = event_time(forecasts, VALID, delay) if forecasts.isStreaming and not watermarked else forecasts
    if cutoff is not None:
        left = left.filter((F.col(INIT) < cutoff) & (F.col(VALID) < cutoff))
    right = observations.filter(F.col(OBSERVED).isNotNull())
    if right.isStreaming:
        right = event_time(right, VALID, delay)
    return left.join(right, [*keys, VALID])


def flatline_stream(sdf: DataFrame, measure: str, minimum_run: int = 24, keys: Sequence[str] = (SOURCE, STATION), ts: str = TS, delay: str = "2 hours") -> DataFrame:
    """Windows of ``minimum_run`` hours that have a reading in every hour; ``stuck`` says whether all are equal.

    An hour lies in a run of at least ``minimum_run`` equal readings exactly
    when it lies in a stuck window, so sliding windows replace custom state: a
    busy station spreads over its windows, and state expires with the watermark.
    Hours are counted, not readings, so a repeated reading is harmless. A later
    reading that differs sends its windows again with ``stuck`` false, which
    takes the alarm back from the log.
    """
    timed = event_time(sdf, ts, delay).filter(F.col(measure).isNotNull())
    window = F.window(ts, f"{minimum_run} hours", "1 hour")
    tested = timed.withColumn("_hour", F.date_trunc("hour", ts)).groupBy(*keys, window.alias("_w")).agg(
        F.size(F.collect_set("_hour")).alias("_hours"), F.min(measure).alias("_low"), F.max(measure).alias("_high")
    )
    full = tested.filter(F.col("_hours") == minimum_run)
    equal = F.col("_low") == F.col("_high")
    return full.select(*keys, F.col("_w.start").alias("run_start"), F.col("_w.end").alias("run_end"), F.col("_low").alias("value"), equal.alias("stuck"))


def stuck_hours(alarms: DataFrame, keys: Sequence[str] = (SOURCE, STATION), ts: str = TS) -> DataFrame:
    """Distinct hours covered by windows that are still stuck; ``alarms`` holds the newest row of every window."""
    hours = F.sequence(F.col("run_start"), F.col("run_end") - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))
    return alarms.filter("stuck").select(*keys, F.explode(hours).alias(ts)).distinct()


def error_stream(pairs: DataFrame, window: str = "1 day", keys: Sequence[str] = (), ts: str = VALID) -> DataFrame:
    """Mean absolute error by event-time window and day of lead time."""
    day = (F.floor((F.unix_seconds(VALID) - F.unix_seconds(INIT)) / F.lit(86400)) + 1).cast("int")
    error = F.abs(forecast_error())
    return pairs.groupBy(*keys, F.window(ts, window).alias("_w"), day.alias("lead_day")).agg(
        F.avg(error).alias("mae_c"), F.count(F.lit(1)).alias("pairs")
    ).select(*keys, F.col("_w.start").alias("window_start"), "lead_day", "mae_c", "pairs")
