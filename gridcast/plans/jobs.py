"""Jobs: whole stages as functions from paths to written tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridcast.functions import features as X
from gridcast.functions.convert import iso_local, iso_utc
from gridcast.functions.features import model_frame
from gridcast.functions.vocabulary import (
    CUTOFF,
    DS,
    FOLDS,
    HORIZON_HOURS,
    MEASURES,
    MODEL,
    PANEL_COLUMNS,
    ROLLING_STEP_DAYS,
    SOURCE,
    STATION,
    TS,
    VALID,
)
from gridcast.operators import align as A
from gridcast.operators import compare as K
from gridcast.operators import metrics as M
from gridcast.operators.covariates import freshest_rows, require_forecast
from gridcast.operators.folds import number_folds
from gridcast.operators.panel import flag_forecasts
from gridcast.operators.screen import FORECAST_SCREEN, Screen, strip_flags
from gridcast.plans.baselines import raw_forecast
from gridcast.plans.boosted import RAW, Boosted, corrected_forecast, residual_recipe, training_matrix
from gridcast.plans.least_squares import coefficient_table
from gridcast.plans.linear import calendar_fit, calendar_regression, correction_fit, forecast_correction
from gridcast.plans.registry import COVARIATE, UNIVARIATE, Setup, fold_sets, run_models, score
from gridcast.session import cut_lineage
from gridcast.sources import readers, writers
from gridcast.sources.schedule import parse_window
from gridcast.sources.specs import select_sources

TARGET_PRIORITY = ("noaa_ghcnh", "iem_asos")


def ingest(spark: SparkSession, shaped: Mapping[str, DataFrame], out_dir: str, start: str, end: str, selected: Sequence[str] | None = None, overwrite: bool = False) -> dict[str, str]:
    """Land the shaped rows of the chosen sources, one protected CSV folder each."""
    first, last = parse_window(start, end)
    chosen = [s.name for s in select_sources(selected)]
    absent = [n for n in chosen if n not in shaped]
    if absent:
        raise ValueError(f"No landed rows for: {absent}.")
    stamp = f"weather_{first:%Y%m%dT%H%M%SZ}_{last:%Y%m%dT%H%M%SZ}.csv"
    paths = {n: f"{out_dir}/{n}/{stamp}" for n in chosen}
    writers.refuse_existing(spark, paths, overwrite)
    for name, path in paths.items():
        rows = writers.land_source(shaped[name], name, F.lit(first), F.lit(last))
        ordered = rows.withColumn(TS, iso_utc(TS)).sortWithinPartitions(STATION, TS)
        writers.write_csv(ordered, path, overwrite)
    return paths


def align_sources(spark: SparkSession, raw_dir: str, registry: DataFrame, start, end, sources: Sequence[str] | None = None, must_include: Sequence[str] = ()) -> DataFrame:
    """Chosen sources normalized and placed on the grid, as one panel."""
    parts = []
    for spec in select_sources(sources, must_include):
        raw = readers.latest_csv(spark, raw_dir, spec)
        rows = spec.normalize(raw, registry)
        tie = (readers.ARRIVAL,) if readers.ARRIVAL in rows.columns else ()
        parts.append(A.align(rows, start, end, tiebreak=tie))
    panel = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return panel.select(SOURCE, STATION, TS, *[c for c in MEASURES if c in panel.columns])


def clean_observations(
    spark: SparkSession,
    config_path: str,
    raw_dir: str,
    out_dir: str,
    station: str,
    sources: Sequence[str] | None = None,
    overwrite: bool = False,
    priority: Sequence[str] = TARGET_PRIORITY,
    screen: Screen = Screen(),
) -> dict[str, str]:
    """Raw source files to panel, target and screening report.

    The flagged panel is written once to the shared folder; panel, target and
    report are read from it, so the readings are parsed and screened once.
    """
    paths = {"panel": f"{out_dir}/hourly_panel", "target": f"{out_dir}/hourly_target", "report": f"{out_dir}/screening_report"}
    select_sources(sources, priority)
    writers.refuse_existing(spark, paths, overwrite)
    settings = readers.job_settings(spark, config_path)
    first, last = parse_window(settings["start_utc"], settings["end_utc"])
    start, end = F.lit(first), F.lit(last)
    stations = readers.registry(spark, config_path)
    panel = align_sources(spark, raw_dir, stations, start, end, sources, priority)
    flagged = cut_lineage(screen.flag(panel))
    kept = strip_flags(flagged)
    writers.write_table(kept, paths["panel"], overwrite, (SOURCE,), (STATION, TS))
    target = A.target_series(kept, station, priority, start, end, settings["zone"])
    writers.write_table(target, paths["target"], overwrite, (), (TS,))
    writers.write_csv(screen.report(flagged), paths["report"], overwrite)
    return paths


def clean_forecast_runs(spark: SparkSession, raw_dir: str, out_dir: str, name: str = "gfs_forecast_panel", overwrite: bool = False, reuse: bool = False, screen: Screen = FORECAST_SCREEN) -> dict[str, str]:
    """Raw run files to the hourly two-clock panel and its report; ``reuse`` keeps a panel that is there."""
    paths = {"panel": f"{out_dir}/{name}", "report": f"{out_dir}/{name}_screening_report"}
    if reuse and writers.exists(spark, paths["panel"]):
        return paths
    writers.refuse_existing(spark, paths, overwrite)
    flagged = cut_lineage(flag_forecasts(readers.forecast_runs(spark, raw_dir), screen))
    panel = strip_flags(flagged).select(*[c for c in PANEL_COLUMNS if c in flagged.columns])
    dated = panel.withColumn("init_date", F.to_date("init_time_utc"))
    writers.write_table(dated, paths["panel"], overwrite, ("init_date",), (STATION, "init_time_utc", VALID))
    writers.write_csv(screen.report(flagged), paths["report"], overwrite)
    return paths


def dedupe_panel(spark: SparkSession, path: str, out_path: str, overwrite: bool = False) -> str:
    """One forecast row per valid hour, the latest run's; written to a new path, the input stays."""
    panel = readers.parquet_table(spark, path, "clean_forecast_runs")
    return writers.write_table(freshest_rows(panel, (SOURCE, STATION, VALID)), out_path, overwrite)


def _keyed(target: DataFrame) -> DataFrame:
    return model_frame(target, (STATION,))


def backtest(spark: SparkSession, target_path: str, out_dir: str, cutoff, models: Sequence[str] = UNIVARIATE, panel_path: str | None = None, setup: Setup = Setup(), step_days: int = ROLLING_STEP_DAYS, overwrite: bool = False) -> dict[str, str]:
    """Every model on every fold set: summary, lead-day errors and stored predictions.

    With a panel the folds are those a covariate model can be trained for.
    """
    paths = {"summary": f"{out_dir}/backtest_summary", "by_lead_day": f"{out_dir}/backtest_by_lead_day", "predictions": f"{out_dir}/backtest_predictions"}
    writers.refuse_existing(spark, paths, overwrite)
    history = cut_lineage(_keyed(readers.parquet_table(spark, target_path, "clean_observations")))
    panel = readers.parquet_table(spark, panel_path, "clean_forecast_runs") if panel_path else None
    folds = cut_lineage(number_folds(fold_sets(history, F.lit(cutoff), setup, step_days, panel), setup.keys))
    if folds.isEmpty():
        raise ValueError("No backtest fold has a year of history behind it and a whole window ahead.")
    staged = M.with_truth(run_models(models, history, folds, panel, setup), history, setup.keys)
    writers.write_table(staged, paths["predictions"], overwrite, (MODEL, FOLDS), (CUTOFF, DS))
    stored = spark.read.parquet(paths["predictions"]).withColumns({MODEL: F.col(MODEL).cast("string"), FOLDS: F.col(FOLDS).cast("string")})
    metrics = score(stored.drop("y"), history, folds, setup)
    writers.write_csv(M.summarize(metrics, (*setup.keys, MODEL, FOLDS)), paths["summary"], overwrite)
    writers.write_csv(M.by_lead_day(stored, (*setup.keys, MODEL, FOLDS, CUTOFF)), paths["by_lead_day"], overwrite)
    return paths


def covariate_backtest(spark: SparkSession, target_path: str, panel_path: str, out_dir: str, cutoff, models: Sequence[str] = COVARIATE, reference: str = "raw_gfs", setup: Setup = Setup(), step_days: int = ROLLING_STEP_DAYS, overwrite: bool = False) -> dict[str, str]:
    """Backtest on trainable folds, then every model against the raw forecast."""
    paths = backtest(spark, target_path, out_dir, cutoff, models, panel_path, setup, step_days, overwrite)
    paths["comparison"] = f"{out_dir}/comparison"
    compare_models(spark, [paths["summary"]], paths["comparison"], reference, overwrite)
    return paths


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    typed = {"scored_hours": "long", "training_hours": "long", "mae_c": "double", "rmse_c": "double", "bias_c": "double", "max_abs_error_c": "double", "interval_coverage": "double", "training_years": "double"}
    raw = spark.read.option("header", True).csv(path)
    return raw.withColumns({c: F.col(c).cast(t) for c, t in typed.items() if c in raw.columns})


def series_of(summary: DataFrame) -> tuple[str, ...]:
    """The columns that name a series in a stored summary."""
    return tuple(c for c in (STATION,) if c in summary.columns)


def compare_models(spark: SparkSession, summary_paths: Sequence[str], out_path: str, reference: str, overwrite: bool = False, metric: str = "mae_c", seeded: bool = False) -> str:
    """Paired comparison of stored summaries (several are appended) against one reference."""
    parts = [read_summary(spark, p) for p in summary_paths]
    summary = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    keys = series_of(summary)
    K.require_one_row(summary, keys)
    return writers.write_csv(K.compare(summary, metric, reference, seeded=seeded, keys=keys), out_path, overwrite)


def compare_pairs(spark: SparkSession, summary_path: str, pairs: Sequence[tuple[str, str, str]], out_path: str, overwrite: bool = False, seeded: bool = False) -> str:
    """Chosen (challenger, reference, folds) pairs, each series by itself."""
    summary = read_summary(spark, summary_path)
    keys = series_of(summary)
    K.require_pairs(summary, pairs)
    K.require_one_row(summary, keys)
    table = spark.createDataFrame(list(pairs), f"challenger string, reference string, {FOLDS} string")
    return writers.write_csv(K.compare(summary, pairs=table, seeded=seeded, keys=keys), out_path, overwrite)


def forecast_rows(rows: DataFrame, zone: str) -> DataFrame:
    """Forecast file layout: UTC text with Z, local text with offset, predicted and raw value."""
    return rows.select(
        iso_utc(DS).alias("timestamp_utc"),
        iso_local(DS, zone).alias("timestamp_local"),
        "predicted_temperature_c",
        F.col(RAW).alias("raw_gfs_temperature_c"),
    )


def train_boosted(spark: SparkSession, target_path: str, panel_path: str, out_dir: str, cutoff, zone: str, hours: int = HORIZON_HOURS, params: Mapping | None = None, patience: int | None = 50, overwrite: bool = False) -> dict[str, str]:
    """Residual recipe end to end: model with contract, forecast file and metric report."""
    paths = {"model": f"{out_dir}/model", "forecast": f"{out_dir}/forecast", "report": f"{out_dir}/report"}
    writers.refuse_existing(spark, paths, overwrite)
    target = readers.parquet_table(spark, target_path, "clean_observations")
    panel = readers.parquet_table(spark, panel_path, "clean_forecast_runs")
    at = F.lit(cutoff)
    require_forecast(panel, at)
    fitted, report = residual_recipe(training_matrix(panel, target, at), params, patience=patience)
    fitted.save(paths["model"])
    rows = corrected_forecast(Boosted.load(spark, paths["model"]), panel, at, hours)
    writers.write_csv(forecast_rows(rows, zone).sortWithinPartitions("timestamp_utc"), paths["forecast"], overwrite)
    writers.write_json(spark.createDataFrame([_flat(report)]), paths["report"], overwrite)
    return paths


def _flat(report: Mapping) -> dict:
    out = {}
    for key, value in report.items():
        out |= {f"{key}_{k}": v for k, v in value.items()} if isinstance(value, Mapping) else {key: value}
    return out


def merged_forecasts(history: DataFrame, panel: DataFrame, folds: DataFrame, hours: int, keys: Sequence[str] = (STATION,), step_hours: int = 1, tiebreak: Sequence[str] = (), minimum: int = 50, on_short: str = "error") -> DataFrame:
    """Calendar, corrected (with bounds) and raw forecasts side by side on ``ds``."""
    by = [*keys, FOLDS, CUTOFF, DS]
    calendar = calendar_regression(history, folds, hours, keys, step_hours, on_short=on_short).select(*by, F.col("yhat").alias("linear_c"))
    corrected = forecast_correction(history, panel, folds, hours, keys, minimum=minimum, tiebreak=tiebreak, on_short=on_short, step_hours=step_hours).select(
        *by, F.col("yhat").alias("linear_gfs_c"), F.col("yhat_lower").alias("linear_gfs_lower_c"), F.col("yhat_upper").alias("linear_gfs_upper_c")
    )
    raw = raw_forecast(panel, folds, hours, keys, tiebreak).select(*by, F.col("yhat").alias("raw_gfs_c"))
    return calendar.join(corrected, by, "left").join(raw, by, "left")


def linear_report(spark: SparkSession, target_path: str, panel_path: str, out_dir: str, cutoff, zone: str, setup: Setup = Setup(), overwrite: bool = False) -> dict[str, str]:
    """Final multi-model forecast and coefficient table of both linear models, fitted on all data before the cutoff."""
    paths = {"forecast": f"{out_dir}/linear_forecast", "coefficients": f"{out_dir}/linear_coefficients"}
    writers.refuse_existing(spark, paths, overwrite)
    history = _keyed(readers.parquet_table(spark, target_path, "clean_observations"))
    panel = readers.parquet_table(spark, panel_path, "clean_forecast_runs")
    folds = history.select(*setup.keys).distinct().select(*setup.keys, F.lit("final").alias(FOLDS), F.lit(cutoff).alias(CUTOFF))
    rows = merged_forecasts(history, panel, folds, setup.hours, setup.keys, setup.step_hours, setup.tiebreak)
    writers.write_csv(rows.withColumn("timestamp_local", iso_local(DS, zone)).drop(FOLDS, CUTOFF), paths["forecast"], overwrite)
    calendar = coefficient_table(calendar_fit(history, folds, setup.keys), setup.keys, list(X.calendar_features(DS, F.lit(cutoff))), "linear")
    correction = coefficient_table(correction_fit(history, panel, folds, setup.keys), setup.keys, list(X.correction_features()), "linear_gfs")
    writers.write_csv(calendar.unionByName(correction).drop(FOLDS, CUTOFF), paths["coefficients"], overwrite)
    return paths
