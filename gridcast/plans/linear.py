"""Linear models: calendar regression, forecast correction and the additive model."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridcast.functions import features as X
from gridcast.functions.convert import plus_hours
from gridcast.functions.vocabulary import (
    COVARIATES,
    CUTOFF,
    DS,
    FOLDS,
    HORIZON_HOURS,
    INIT,
    OBSERVED,
    PREFIX,
    STATION,
    VALID,
    Y,
)
from gridcast.operators.covariates import attach_available, forecast_window, training_pairs
from gridcast.operators.folds import SEGMENT, assign_segments, fold_totals, future_frame
from gridcast.operators.intervals import in_window
from gridcast.plans.baselines import shape
from gridcast.plans.least_squares import cross_products, predict, residual_sd, solve_folds

# Two-sided normal quantiles: 95 per cent as published, 80 per cent interval width.
Z95 = 1.96
Z80 = 1.2815515655446004
ALL_REGRESSORS = tuple(PREFIX + c for c in COVARIATES)
DEFAULT_REGRESSORS = (PREFIX + "temperature_c",)


# --- calendar regression with a decaying recent anomaly --------------------------


def _with_origin(rows: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The trend counts from a series' first observation, the same for all its folds."""
    origin = history.filter(F.col(Y).isNotNull()).groupBy(*keys).agg(F.min(DS).alias("_origin"))
    return rows.join(origin, list(keys), "left")


def calendar_fit(
    history: DataFrame,
    folds: DataFrame,
    keys: Sequence[str] = (STATION,),
    harmonics: Mapping[str, int] | None = None,
    on_short: str = "error",
) -> DataFrame:
    """Fitted calendar regression per fold."""
    terms = X.calendar_features(DS, F.col("_origin"), **(harmonics or {}))
    observed = _with_origin(history.filter(F.col(Y).isNotNull()).select(*keys, DS, Y), history, keys)
    placed = assign_segments(observed, folds, keys)
    products = cross_products(placed, (*keys, FOLDS, SEGMENT), terms, F.col(Y))
    return solve_folds(products, folds, keys, list(terms), 1, on_short)


def recent_rows(history: DataFrame, folds: DataFrame, keys: Sequence[str] = (STATION,), days: float = 3.0) -> DataFrame:
    """Observations of the last ``days`` up to each fold's last observation, tagged with their fold."""
    observed = history.filter(F.col(Y).isNotNull()).select(*keys, DS, Y)
    stats = assign_segments(observed, folds, keys).groupBy(*keys, FOLDS, SEGMENT).agg(F.max(DS).alias("last_observed"))
    last = fold_totals(stats, folds, keys, maxima=("last_observed",)).select(*keys, FOLDS, CUTOFF, "last_observed")
    hours = int(days * 24)
    # Strictly after the window start, up to and including the last observation.
    tick = F.expr("INTERVAL 1 MICROSECOND")
    windows = last.filter(F.col("last_observed").isNotNull()).withColumns(
        {"_since": plus_hours(F.col("last_observed"), -hours) + tick, "_until": F.col("last_observed") + tick}
    )
    return in_window(observed, windows, DS, "_since", "_until", keys, hours).drop("_since", "_until")


def calendar_regression(
    history: DataFrame,
    folds: DataFrame,
    hours: int = HORIZON_HOURS,
    keys: Sequence[str] = (STATION,),
    step_hours: int = 1,
    harmonics: Mapping[str, int] | None = None,
    use_anomaly: bool = True,
    anomaly_days: float = 3.0,
    decay_days: float = 2.0,
    name: str = "linear",
    on_short: str = "error",
) -> DataFrame:
    """Calendar regression, plus the recent residual fading with lead time.

    Future rows and recent observations are predicted together, so the fits
    are computed once; the anomaly is then averaged over one fold's rows (its
    horizon and its few recent days).
    """
    terms = X.calendar_features(DS, F.col("_origin"), **(harmonics or {}))
    fits = calendar_fit(history, folds, keys, harmonics, on_short)
    wanted = future_frame(folds.select(*keys, FOLDS, CUTOFF), hours, step_hours)
    if use_anomaly:
        wanted = wanted.unionByName(recent_rows(history, folds, keys, anomaly_days), allowMissingColumns=True)
    rows = predict(_with_origin(wanted, history, keys), fits, keys, terms, "_fit")
    yhat = F.col("_fit")
    if use_anomaly:
        fold = Window.partitionBy(*keys, FOLDS, CUTOFF)
        rows = rows.withColumns(
            {"_anomaly": F.avg(F.col(Y) - F.col("_fit")).over(fold), "_seen": F.max("last_observed").over(fold)}
        ).filter(F.col("last_observed").isNull())
        lead_days = (F.unix_micros(DS) - F.unix_micros("_seen")) / F.lit(86400e6)
        yhat = yhat + F.coalesce(X.anomaly_decay(F.col("_anomaly"), lead_days, decay_days), F.lit(0.0))
    spread = F.lit(Z95) * residual_sd(len(terms) + 1)
    return shape(rows.withColumn("_yhat", yhat), name, F.col("_yhat"), keys, F.col("_yhat") - spread, F.col("_yhat") + spread)


def whole_window(rows: DataFrame, folds: DataFrame, hours: int, step_hours: int, keys: Sequence[str]) -> DataFrame:
    """All hours of all folds, with what ``rows`` hold of them."""
    wanted = future_frame(folds.select(*keys, FOLDS, CUTOFF), hours, step_hours)
    return wanted.join(rows, [*keys, FOLDS, CUTOFF, DS], "left")


def incomplete_hours(predictions: DataFrame, fits: DataFrame, window: DataFrame, keys: Sequence[str], minimum: int, needed: Sequence[str] = (PREFIX + "temperature_c",)) -> DataFrame:
    """The hours without a prediction and why: 'short history' of the fold, 'no forecast' for the hour, or a 'missing measure' in it.

    A short fold is named before anything that its hours lack.
    """
    by = [*keys, FOLDS, CUTOFF]
    there = F.lit(True)
    for c in needed:
        there = there & F.col(c).isNotNull()
    covered = window.select(*by, F.col(VALID).alias(DS), there.alias("_measured"))
    open_hours = predictions.where(F.col("yhat").isNull()).select(*by, DS)
    told = open_hours.join(fits.select(*by, "n_rows"), by, "left").join(covered, [*by, DS], "left")
    reason = (
        F.when(F.coalesce("n_rows", F.lit(0)) < minimum, "short history").when(F.col("_measured").isNull(), "no forecast").when(~F.col("_measured"), "missing measure")
    )
    return told.select(*by, DS, F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), reason.alias("reason"))


# --- forecast correction ----------------------------------------------------------


def correction_fit(
    history: DataFrame,
    panel: DataFrame,
    folds: DataFrame,
    keys: Sequence[str] = (STATION,),
    daily: int = 2,
    minimum: int = 50,
    on_short: str = "error",
) -> DataFrame:
    """Observed value on forecast, lead, their product and calendar terms, per fold.

    A pair is usable once its run is issued and its hour has passed, so it
    belongs to the segment of the later of the two clocks.
    """
    pairs = training_pairs(panel, history, None, keys, DS, Y).na.drop(subset=[PREFIX + "temperature_c"])
    dated = pairs.withColumn("_known", F.greatest(INIT, VALID))
    terms = X.correction_features(daily=daily)
    placed = assign_segments(dated, folds, keys, "_known")
    products = cross_products(placed, (*keys, FOLDS, SEGMENT), terms, F.col(OBSERVED))
    return solve_folds(products, folds, keys, list(terms), minimum, on_short)


def forecast_correction(
    history: DataFrame,
    panel: DataFrame,
    folds: DataFrame,
    hours: int = HORIZON_HOURS,
    keys: Sequence[str] = (STATION,),
    daily: int = 2,
    minimum: int = 50,
    tiebreak: Sequence[str] = (),
    name: str = "linear_gfs",
    on_short: str = "error",
    step_hours: int = 1,
) -> DataFrame:
    """Freshest legitimate forecast corrected by the fold's regression.

    With ``on_short`` 'null' every fold and hour comes back, without a value
    where the fold is short or no run covers the hour.
    """
    fits = correction_fit(history, panel, folds, keys, daily, minimum, on_short)
    terms = X.correction_features(daily=daily)
    window = forecast_window(panel, folds, hours, keys, tiebreak).na.drop(subset=[PREFIX + "temperature_c"])
    rows = predict(window, fits, keys, terms, "_yhat").withColumn(DS, F.col(VALID))
    if on_short == "null":
        rows = whole_window(rows, folds, hours, step_hours, keys)
    spread = F.lit(Z95) * residual_sd(len(terms) + 1)
    return shape(rows, name, F.col("_yhat"), keys, F.col("_yhat") - spread, F.col("_yhat") + spread)


# --- additive model and covariate correction --------------------------------------

KNOTS = 25
KNOT_SHARE = 0.8
TREND_PRIOR = 5.0
KNOT_PRIOR = 0.01
SEASON_PRIOR = 10.0


def _with_span(rows: DataFrame, history: DataFrame, folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Origin and span (years) that place the trend knots of a series."""
    first = history.filter(F.col(Y).isNotNull()).groupBy(*keys).agg(F.min(DS).alias("_origin"))
    last = folds.groupBy(*keys).agg(F.max(CUTOFF).alias("_end"))
    span = first.join(last, list(keys)).withColumn(
        "_span", (F.unix_micros("_end") - F.unix_micros("_origin")) / F.lit(1e6) / F.lit(X.YEAR_SECONDS)
    )
    return rows.join(span.drop("_end"), list(keys))


def trend_features(knots: int = KNOTS) -> dict[str, Column]:
    """Linear trend in years and hinges over the first four fifths of the series."""
    t = (F.unix_micros(DS) - F.unix_micros("_origin")) / F.lit(1e6) / F.lit(X.YEAR_SECONDS)
    out = {"trend": t}
    for j in range(1, knots + 1):
        out[f"knot_{j}"] = F.greatest(t - F.col("_span") * F.lit(KNOT_SHARE * j / knots), F.lit(0.0))
    return out


def _ridge(names: Sequence[str], knots: int):
    """Penalty of one fold: priors on the scale of the label, knots past its first four fifths shut off."""
    kinds = [0 if n == "trend" else int(n.split("_")[1]) if n.startswith("knot_") else -1 for n in names]
    years = F.greatest(F.col("_years"), F.lit(1e-6))

    def weights(sigma2: Column, height: Column) -> Column:
        season = sigma2 / F.pow(F.lit(SEASON_PRIOR) * height, 2)
        trend = sigma2 / F.pow(F.lit(TREND_PRIOR) * height / years, 2)
        # A Laplace prior of scale b has variance 2 b**2.
        knot = sigma2 / F.pow(F.lit(math.sqrt(2.0) * KNOT_PRIOR) * height / years, 2)
        off = F.lit(1e12) * sigma2 / F.pow(height, 2)
        late = [F.lit(k / max(knots, 1)) * F.col("_span") > F.col("_years") for k in kinds]
        return F.array(*[trend if k == 0 else season if k < 0 else F.when(after, off).otherwise(knot) for k, after in zip(kinds, late)])

    return weights


def additive_terms(
    seasonality: bool, regressors: Sequence[str], step_hours: int, yearly: int = 6, daily: int = 6, conditional_daily: bool = False, knots: int = KNOTS
) -> dict[str, Column]:
    """Design of the additive model; without seasonality only the regressors remain (flat growth)."""
    out: dict[str, Column] = {}
    if seasonality:
        # A daily curve cannot be seen on steps of a day or more.
        curves = daily if step_hours < 24 else 0
        out |= trend_features(knots) | X.structural_features(DS, yearly, curves, conditional_daily)
    return out | {r: F.col(r) for r in regressors}


def additive_fit(
    history: DataFrame,
    folds: DataFrame,
    keys: Sequence[str] = (STATION,),
    panel: DataFrame | None = None,
    regressors: Sequence[str] = (),
    seasonality: bool = True,
    step_hours: int = 1,
    tiebreak: Sequence[str] = (),
    on_short: str = "error",
    **design,
) -> DataFrame:
    """Fitted additive terms per fold; regressors are learned only on hours that have them."""
    terms = additive_terms(seasonality, regressors, step_hours, **design)
    rows = history.select(*keys, DS, Y)
    if regressors:
        rows = attach_available(rows, panel, None, keys, tiebreak)
    usable = rows.na.drop(subset=[*regressors, Y])
    asked = folds.select(*keys, FOLDS, CUTOFF)
    extra: tuple[str, ...] = ()
    penalty = None
    if seasonality:
        usable = _with_span(usable, history, folds, keys)
        dated = _with_span(asked, history, folds, keys)
        years = (F.unix_micros(CUTOFF) - F.unix_micros("_origin")) / F.lit(1e6) / F.lit(X.YEAR_SECONDS)
        asked = dated.withColumn("_years", F.lit(KNOT_SHARE) * years).withColumn("_span", F.lit(KNOT_SHARE) * F.col("_span")).drop("_origin")
        extra, penalty = ("_years", "_span"), _ridge(list(terms), design.get("knots", KNOTS))
    placed = assign_segments(usable, folds, keys)
    products = cross_products(placed, (*keys, FOLDS, SEGMENT), terms, F.col(Y))
    return solve_folds(products, asked, keys, list(terms), 2, on_short, penalty, extra)


def additive(
    history: DataFrame,
    folds: DataFrame,
    hours: int = HORIZON_HOURS,
    keys: Sequence[str] = (STATION,),
    panel: DataFrame | None = None,
    regressors: Sequence[str] = (),
    seasonality: bool = True,
    step_hours: int = 1,
    tiebreak: Sequence[str] = (),
    name: str = "prophet",
    on_short: str = "error",
    **design,
) -> DataFrame:
    """Additive predictions with an 80 per cent normal interval.

    With a panel and without seasonality this is the pure forecast correction:
    least squares on the regressors of the hours that have them.
    """
    fits = additive_fit(history, folds, keys, panel, regressors, seasonality, step_hours, tiebreak, on_short, **design)
    terms = additive_terms(seasonality, regressors, step_hours, **design)
    if regressors:
        window = forecast_window(panel, folds, hours, keys, tiebreak)
        wanted = window.withColumnRenamed(VALID, DS).na.drop(subset=list(regressors))
    else:
        wanted = future_frame(folds.select(*keys, FOLDS, CUTOFF), hours, step_hours)
    if seasonality:
        wanted = _with_span(wanted, history, folds, keys)
    rows = predict(wanted, fits, keys, terms, "_yhat")
    if on_short == "null":
        rows = whole_window(rows, folds, hours, step_hours, keys)
    spread = F.lit(Z80) * F.sqrt(F.col("rss") / F.col("n_rows"))
    return shape(rows, name, F.col("_yhat"), keys, F.col("_yhat") - spread, F.col("_yhat") + spread)


def simple_correction_fit(
    history: DataFrame, panel: DataFrame, folds: DataFrame, keys: Sequence[str] = (STATION,), tiebreak: Sequence[str] = (), regressor: str = DEFAULT_REGRESSORS[0]
) -> DataFrame:
    """Slope and intercept per fold for the one-regressor correction, entirely as aggregates."""
    usable = attach_available(history.select(*keys, DS, Y), panel, None, keys, tiebreak).na.drop(subset=[regressor, Y])
    x, y = F.col(regressor), F.col(Y)
    stats = assign_segments(usable, folds, keys).groupBy(*keys, FOLDS, SEGMENT).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(x).alias("_x"),
        F.sum(y).alias("_y"),
        F.sum(x * x).alias("_xx"),
        F.sum(x * y).alias("_xy"),
        F.sum(y * y).alias("_yy"),
    )
    run = fold_totals(stats, folds, keys, ("n_rows", "_x", "_y", "_xx", "_xy", "_yy"))
    n = F.col("n_rows")
    sxx = F.col("_xx") - F.col("_x") * F.col("_x") / n
    sxy = F.col("_xy") - F.col("_x") * F.col("_y") / n
    syy = F.col("_yy") - F.col("_y") * F.col("_y") / n
    slope = F.when((n >= 2) & (sxx > 0), sxy / sxx)
    fitted = run.select(*keys, FOLDS, CUTOFF, "n_rows", slope.alias("slope"), F.col("_x"), F.col("_y"), syy.alias("_syy"), sxy.alias("_sxy"))
    return fitted.select(
        *keys,
        FOLDS,
        CUTOFF,
        "n_rows",
        "slope",
        ((F.col("_y") - F.col("slope") * F.col("_x")) / n).alias("intercept"),
        # Two points fit exactly; the difference of sums would leave rounding noise.
        F.when(n > 2, F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))).otherwise(0.0).alias("rss"),
    )


def simple_correction(
    history: DataFrame,
    panel: DataFrame,
    folds: DataFrame,
    hours: int = HORIZON_HOURS,
    keys: Sequence[str] = (STATION,),
    tiebreak: Sequence[str] = (),
    name: str = "prophet_gfs",
    regressor: str = DEFAULT_REGRESSORS[0],
) -> DataFrame:
    """Default covariate model: one-regressor correction of the freshest forecast, 80 per cent interval.

    Folds with fewer than two usable hours have no fit and yield no rows.
    """
    fits = simple_correction_fit(history, panel, folds, keys, tiebreak, regressor).filter(F.col("slope").isNotNull())
    window = forecast_window(panel, folds, hours, keys, tiebreak).withColumnRenamed(VALID, DS).na.drop(subset=[regressor])
    rows = window.join(fits, [*keys, FOLDS, CUTOFF]).withColumn("_yhat", F.col("intercept") + F.col("slope") * F.col(regressor))
    spread = F.lit(Z80) * F.sqrt(F.col("rss") / F.col("n_rows"))
    return shape(rows, name, F.col("_yhat"), keys, F.col("_yhat") - spread, F.col("_yhat") + spread)
