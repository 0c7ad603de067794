"""Model registry and the backtest over identical folds.

A model is a function ``(history, folds, panel, Setup) -> predictions`` that
covers every series and fold at once. Third-party per-fold models join through
``per_fold_model``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Observation, functions as F

from gridcast.functions.vocabulary import CUTOFF, DS, FOLDS, HORIZON_HOURS, MODEL, ROLLING_STEP_DAYS, STATION, Y
from gridcast.operators import metrics as M
from gridcast.operators.covariates import trainable_folds
from gridcast.operators.folds import (
    SEGMENT,
    assign_segments,
    before_cutoff,
    fold_totals,
    future_frame,
    number_folds,
    rolling_cutoffs,
    seasonal_cutoffs,
)
from gridcast.plans.baselines import climatology, persistence, raw_forecast, shape
from gridcast.plans.boosted import boosted_backtest
from gridcast.plans.linear import ALL_REGRESSORS, DEFAULT_REGRESSORS, additive, calendar_regression, forecast_correction, simple_correction
from gridcast.session import cut_lineage


@dataclass(frozen=True)
class Setup:
    """Grain and series keys shared by every model of a backtest."""

    hours: int = HORIZON_HOURS
    step_hours: int = 1
    keys: Sequence[str] = (STATION,)
    tiebreak: Sequence[str] = ()
    on_short: str = "error"
    options: Mapping[str, Mapping] = field(default_factory=dict)


Model = Callable[[DataFrame, DataFrame, DataFrame | None, Setup], DataFrame]


def _plain(fn, **fixed) -> Model:
    return lambda h, f, p, s: fn(h, f, s.hours, s.keys, s.step_hours, **fixed)


def _additive(name: str, **fixed) -> Model:
    return lambda h, f, p, s: additive(
        h, f, s.hours, s.keys, panel=p, step_hours=s.step_hours, tiebreak=s.tiebreak, on_short=s.on_short, name=name, **fixed
    )


MODELS: dict[str, Model] = {
    "persistence": _plain(persistence),
    "climatology": _plain(climatology),
    "linear": lambda h, f, p, s: calendar_regression(h, f, s.hours, s.keys, s.step_hours, on_short=s.on_short),
    "linear_no_anomaly": lambda h, f, p, s: calendar_regression(
        h, f, s.hours, s.keys, s.step_hours, use_anomaly=False, name="linear_no_anomaly", on_short=s.on_short
    ),
    "prophet": _additive("prophet"),
    "raw_gfs": lambda h, f, p, s: raw_forecast(p, f, s.hours, s.keys, s.tiebreak),
    "linear_gfs": lambda h, f, p, s: forecast_correction(h, p, f, s.hours, s.keys, tiebreak=s.tiebreak, on_short=s.on_short),
    "prophet_gfs": lambda h, f, p, s: simple_correction(h, p, f, s.hours, s.keys, s.tiebreak),
    "prophet_gfs_all": _additive("prophet_gfs_all", regressors=ALL_REGRESSORS, seasonality=False),
    "prophet_gfs_seasonal": _additive("prophet_gfs_seasonal", regressors=DEFAULT_REGRESSORS, seasonality=True),
    "xgboost": lambda h, f, p, s: boosted_backtest(
        h, p, f, s.hours, s.keys, step_hours=s.step_hours, tiebreak=s.tiebreak, **s.options.get("xgboost", {})
    ),
}
UNIVARIATE = ("prophet", "linear", "climatology", "persistence")
COVARIATE = ("persistence", "climatology", "prophet", "raw_gfs", "prophet_gfs", "prophet_gfs_all", "prophet_gfs_seasonal")


def register(name: str, model: Model) -> None:
    MODELS[name] = model


def per_fold_model(name: str, fit_predict: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], window_hours: int | None = None) -> Model:
    """Wrap an opaque pandas model: ``(history, future) -> future with yhat`` per series and fold.

    Each call sees all history before its cutoff, as one group. ``window_hours``
    is for models that want less: then a group is bounded by the hourly grid
    however long the series is.
    """

    def run(history: DataFrame, folds: DataFrame, panel: DataFrame | None, setup: Setup) -> DataFrame:
        keys = [*setup.keys, FOLDS, CUTOFF]
        asked = folds.select(*keys)
        seen = history.select(*setup.keys, DS, Y)
        if window_hours is None:
            past = seen.join(asked, list(setup.keys)).where(F.col(DS) < F.col(CUTOFF))
        else:
            past = before_cutoff(seen, asked, window_hours, setup.keys)
        ahead = future_frame(asked, setup.hours, setup.step_hours)
        # Both sides descend from the folds; fresh column ids keep the cogroup unambiguous.
        ahead = ahead.toDF(*ahead.columns)
        types = {f.name: f.dataType.simpleString() for f in ahead.schema.fields}
        schema = ", ".join([f"`{c}` {types[c]}" for c in (*keys, DS)] + ["yhat double", "yhat_lower double", "yhat_upper double"])

        def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = fit_predict(left.sort_values(DS), right.sort_values(DS))
            for bound in ("yhat_lower", "yhat_upper"):
                if bound not in out:
                    out[bound] = None
            return out[[*keys, DS, "yhat", "yhat_lower", "yhat_upper"]]

        rows = past.groupBy(*keys).cogroup(ahead.groupBy(*keys)).applyInPandas(one, schema)
        return shape(rows, name, F.col("yhat"), setup.keys, F.col("yhat_lower"), F.col("yhat_upper"))

    return run


def fold_sets(history: DataFrame, cutoff, setup: Setup, step_days: int = ROLLING_STEP_DAYS, panel: DataFrame | None = None) -> DataFrame:
    """Seasonal and rolling folds; with a panel only those a covariate model can be trained for."""
    rolling = rolling_cutoffs(history, setup.keys, setup.hours, step_days, step_hours=setup.step_hours)
    folds = rolling.unionByName(seasonal_cutoffs(history, cutoff, setup.keys, setup.hours, step_hours=setup.step_hours))
    if panel is None:
        return folds
    # The few fold rows are read by several branches; written once, they cost no further pass over the history.
    numbered = cut_lineage(number_folds(folds, setup.keys))
    return trainable_folds(history, panel, numbered, setup.hours, keys=setup.keys, step_hours=setup.step_hours)


def run_models(names: Sequence[str], history: DataFrame, folds: DataFrame, panel: DataFrame | None, setup: Setup) -> DataFrame:
    """Predictions of the named models on identical folds, as one union."""
    unknown = sorted(set(names) - set(MODELS))
    if unknown:
        raise ValueError(f"Unknown models: {unknown}.")
    parts = [MODELS[n](history, folds, panel, setup) for n in names]
    return reduce(DataFrame.unionByName, parts)


def training_hours(history: DataFrame, folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed hours before every cutoff."""
    seen = assign_segments(history.filter(F.col(Y).isNotNull()).select(*keys, DS), folds, keys)
    stats = seen.groupBy(*keys, FOLDS, SEGMENT).agg(F.count(F.lit(1)).alias("training_hours"))
    return fold_totals(stats, folds, keys, ("training_hours",)).select(
        *keys, FOLDS, CUTOFF, F.coalesce("training_hours", F.lit(0)).alias("training_hours")
    )


def score(predictions: DataFrame, history: DataFrame, folds: DataFrame, setup: Setup, by_series: bool = True) -> DataFrame:
    """Fold metrics with training hours, per series or pooled over series."""
    by = (*(setup.keys if by_series else ()), MODEL, FOLDS, CUTOFF)
    scored = M.with_truth(predictions, history, setup.keys)
    trained = training_hours(history, folds, setup.keys)
    on = (*(setup.keys if by_series else ()), FOLDS, CUTOFF)
    if not by_series:
        trained = trained.groupBy(*on).agg(F.sum("training_hours").alias("training_hours"))
    return M.with_training(M.fold_metrics(scored, by), trained, on)


def observed(predictions: DataFrame, name: str = "backtest") -> tuple[DataFrame, Observation]:
    """Count rows and missing predictions while the job runs, without a second pass."""
    watch = Observation(name)
    return predictions.observe(watch, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("yhat").isNull()).alias("missing")), watch
