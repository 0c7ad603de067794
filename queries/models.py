"""Queries that fit and predict: baselines, regressions, additive and boosted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions import features as X
from gridcast.functions.vocabulary import CUTOFF, DS, FOLDS, INIT, MODEL, STATION, VALID, Y
from gridcast.plans import boosted as B
from gridcast.plans.baselines import climatology, persistence, raw_forecast
from gridcast.plans.jobs import merged_forecasts
from gridcast.plans.least_squares import coefficient_table, cross_products
from gridcast.plans.linear import additive, additive_terms, additive_fit, calendar_regression, correction_fit, forecast_correction, incomplete_hours, simple_correction
from gridcast.plans.linear import ALL_REGRESSORS
from gridcast.operators.covariates import forecast_window, freshest_rows
from gridcast.session import cut_lineage
from queries.bindings import (
    ATTACHED_SQL,
    BASE_SQL,
    DAILY,
    FOLDS_SQL,
    FWINDOW_SQL,
    PANEL_SQL,
    TARGET_SQL,
    TIE,
    at,
    finish,
    folds,
    history,
    panel,
    staged_panel,
    target,
    freshest_sql,
    with_sql,
)
from queries.solve_sql import all_regressors_sql, calendar_sql, correction_sql
from queries.tree_sql import FEATURES_SQL, cells_sql, draws_sql, every_column_sql, grow_sql, recipe_sql

QUERIES, ORACLE = {}, {}
KEYS = (STATION,)
_CORRECTION_TERMS = ", ".join(f"'{n}'" for n in ("gfs_temperature_c", "lead_days", "gfs_x_lead_days", "daily_sin_1", "daily_cos_1", "daily_sin_2", "daily_cos_2", "annual_sin_1", "annual_cos_1"))


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def future_sql(folds_table: str = "folds") -> str:
    return f"future AS (SELECT station_id, folds, cutoff, unnest(generate_series(cutoff, cutoff + INTERVAL 13 DAY, INTERVAL 1 DAY)) AS ds FROM {folds_table})"


CLIMATOLOGY_SQL = """climatology AS (
  SELECT u.station_id, 'climatology' AS model, u.folds, u.cutoff, u.ds,
         coalesce(sum(t.y) FILTER (WHERE (dayofyear(t.ds) - dayofyear(u.ds) + 373) % 366 <= 14) / count(t.y) FILTER (WHERE (dayofyear(t.ds) - dayofyear(u.ds) + 373) % 366 <= 14),
                  avg(t.y)) AS yhat, CAST(NULL AS DOUBLE) AS yhat_lower, CAST(NULL AS DOUBLE) AS yhat_upper
  FROM future u LEFT JOIN target t ON t.station_id = u.station_id AND t.ds < u.cutoff AND t.y IS NOT NULL GROUP BY u.station_id, u.folds, u.cutoff, u.ds)"""

PERSISTENCE_SQL = """persistence AS (
  SELECT u.station_id, 'persistence' AS model, u.folds, u.cutoff, u.ds, arg_max(t.y, t.ds) AS yhat, CAST(NULL AS DOUBLE) AS yhat_lower, CAST(NULL AS DOUBLE) AS yhat_upper
  FROM future u LEFT JOIN target t ON t.station_id = u.station_id AND t.ds < u.cutoff AND t.ds >= u.cutoff - INTERVAL 72 HOUR AND t.y IS NOT NULL
  GROUP BY u.station_id, u.folds, u.cutoff, u.ds)"""

RAW_SQL = """raw AS (
  SELECT station_id, 'raw_gfs' AS model, folds, cutoff, valid_time_utc AS ds, gfs_temperature_c AS yhat, CAST(NULL AS DOUBLE) AS yhat_lower, CAST(NULL AS DOUBLE) AS yhat_upper FROM fwindow)"""


def simple_sql(folds_table: str = "folds") -> str:
    return f"""fits AS (
  SELECT f.station_id, f.folds, f.cutoff, count(*) AS n, regr_slope(a.y, a.gfs_temperature_c) AS slope, regr_intercept(a.y, a.gfs_temperature_c) AS intercept,
         CASE WHEN count(*) > 2 THEN greatest(regr_syy(a.y, a.gfs_temperature_c) - regr_sxy(a.y, a.gfs_temperature_c) ** 2 / regr_sxx(a.y, a.gfs_temperature_c), 0) ELSE 0 END AS rss
  FROM {folds_table} f JOIN attached a ON a.station_id = f.station_id AND a.ds < f.cutoff AND a.y IS NOT NULL AND a.gfs_temperature_c IS NOT NULL GROUP BY ALL),
simple AS (
  SELECT w.station_id, 'prophet_gfs' AS model, w.folds, w.cutoff, w.valid_time_utc AS ds, intercept + slope * gfs_temperature_c AS yhat,
         intercept + slope * gfs_temperature_c - 1.2815515655446004 * sqrt(rss / n) AS yhat_lower, intercept + slope * gfs_temperature_c + 1.2815515655446004 * sqrt(rss / n) AS yhat_upper
  FROM fwindow w JOIN fits USING (station_id, folds, cutoff))"""


OUT = "station_id, model, folds, cutoff, ds, round(yhat, 7) AS yhat, round(yhat_lower, 7) AS yhat_lower, round(yhat_upper, 7) AS yhat_upper"


@query(with_sql(TARGET_SQL, FOLDS_SQL, future_sql(), CLIMATOLOGY_SQL, select=f"SELECT {OUT} FROM climatology"))
def q_climatology(spark, sf):
    """Mean over a window of days of the year, from data before each cutoff, all folds in one plan."""
    past = history(spark, sf)
    return finish(climatology(past, folds(past), DAILY.hours, KEYS, 24), 7)


@query(with_sql(TARGET_SQL, FOLDS_SQL, future_sql(), PERSISTENCE_SQL, select=f"SELECT {OUT} FROM persistence"))
def q_persistence(spark, sf):
    """Last value at each hour of the day within the lookback, all folds in one plan."""
    past = history(spark, sf)
    return finish(persistence(past, folds(past), DAILY.hours, KEYS, 24), 7)


@query(with_sql(*BASE_SQL, FWINDOW_SQL, RAW_SQL, select=f"SELECT {OUT} FROM raw"))
def q_raw_model(spark, sf):
    """The freshest legitimate forecast as a model without bounds."""
    return finish(raw_forecast(panel(spark, sf), folds(history(spark, sf)), DAILY.hours, KEYS, TIE), 7)


@query(with_sql(*BASE_SQL, FWINDOW_SQL, ATTACHED_SQL, simple_sql(), select=f"SELECT {OUT} FROM simple WHERE yhat IS NOT NULL"))
def q_ols_simple(spark, sf):
    """One-regressor correction per cutoff with an 80 per cent interval."""
    past = history(spark, sf)
    return finish(simple_correction(past, staged_panel(spark, sf), folds(past), DAILY.hours, KEYS, TIE), 7)


_GRAM_TERMS = ("trend_years", "annual_sin_1", "annual_cos_1")


@query(with_sql(TARGET_SQL, """
x AS (SELECT station_id, 1.0::DOUBLE AS z0, date_diff('day', TIMESTAMP '1995-01-01', ds) / 365.25 AS z1, sin(2 * pi() * (dayofyear(ds) - 1) / 365.25) AS z2,
             cos(2 * pi() * (dayofyear(ds) - 1) / 365.25) AS z3, y AS z4 FROM target WHERE y IS NOT NULL),
long AS (""" + " UNION ALL ".join(
    f"SELECT station_id, CAST({p} AS BIGINT) AS position, z{i} * z{j} AS v FROM x" for p, (i, j) in enumerate((i, j) for i in range(5) for j in range(i, 5))
) + ")", select="SELECT station_id, position, round(sum(v), 5) AS product FROM long GROUP BY ALL"))
def q_gram_matrix(spark, sf):
    """Cross products of a calendar design, the additive statistics behind every linear fit."""
    rows = target(spark, sf).filter(F.col(Y).isNotNull())
    terms = {n: c for n, c in X.calendar_features(DS, at("1995-01-01"), 0, 1, 0).items() if n in _GRAM_TERMS}
    products = cross_products(rows, KEYS, terms, F.col(Y))
    return finish(products.select(STATION, F.posexplode("products").alias("position", "product")), 5)


@query(with_sql(TARGET_SQL, FOLDS_SQL, future_sql(), """
org AS (SELECT station_id, min(ds) AS origin FROM target WHERE y IS NOT NULL GROUP BY 1),
x AS (SELECT t.station_id, t.ds, t.y, date_diff('day', origin, t.ds) / 365.25 AS t FROM target t JOIN org USING (station_id) WHERE y IS NOT NULL),
fit AS (SELECT f.station_id, f.folds, f.cutoff, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, max(x.ds) AS last_ds, count(*) AS n,
               regr_syy(y, t) - regr_sxy(y, t) ** 2 / regr_sxx(y, t) AS rss
        FROM folds f JOIN x ON x.station_id = f.station_id AND x.ds < f.cutoff GROUP BY ALL),
anomaly AS (SELECT fit.station_id, fit.folds, fit.cutoff, avg(x.y - intercept - slope * x.t) AS a
            FROM fit JOIN x ON x.station_id = fit.station_id AND x.ds <= fit.last_ds AND x.ds > fit.last_ds - INTERVAL 72 HOUR GROUP BY ALL),
p AS (SELECT u.station_id, 'linear' AS model, u.folds, u.cutoff, u.ds, intercept + slope * (date_diff('day', origin, u.ds) / 365.25) + a * exp(-date_diff('day', last_ds, u.ds) / 2.0::DOUBLE) AS yhat,
             1.96 * sqrt(rss / (n - 2)) AS spread
      FROM future u JOIN fit USING (station_id, folds, cutoff) JOIN anomaly USING (station_id, folds, cutoff) JOIN org USING (station_id))""",
    select="SELECT station_id, model, folds, cutoff, ds, round(yhat, 7) AS yhat, round(yhat - spread, 7) AS yhat_lower, round(yhat + spread, 7) AS yhat_upper FROM p"))
def q_anomaly_decay(spark, sf):
    """Trend regression per fold plus its recent residual fading with lead time."""
    past = history(spark, sf)
    rows = calendar_regression(past, folds(past), DAILY.hours, KEYS, 24, {"daily": 0, "annual": 0, "interaction": 0})
    return finish(rows, 7)


@query(with_sql(TARGET_SQL, FOLDS_SQL, future_sql(), calendar_sql(), select="SELECT station_id, 'linear' AS model, folds, cutoff, ds, round(yhat, 6) AS yhat, round(yhat - spread, 6) AS yhat_lower, round(yhat + spread, 6) AS yhat_upper FROM calendar"))
def q_calendar_regression(spark, sf):
    """Full calendar regression (trend, daily and annual terms, recent anomaly) at every fold."""
    past = history(spark, sf)
    return finish(calendar_regression(past, folds(past), DAILY.hours, KEYS, 24, on_short="null"), 6)


@query(with_sql(*BASE_SQL, FWINDOW_SQL, future_sql(), correction_sql(), select="SELECT station_id, 'linear_gfs' AS model, folds, cutoff, ds, round(yhat, 6) AS yhat, round(yhat - spread, 6) AS yhat_lower, round(yhat + spread, 6) AS yhat_upper FROM corrected"))
def q_forecast_correction(spark, sf):
    """Forecast, lead and calendar regression applied to the freshest forecast, at every fold and day."""
    past = history(spark, sf)
    rows = forecast_correction(past, staged_panel(spark, sf), folds(past), DAILY.hours, KEYS, tiebreak=TIE, on_short="null", step_hours=24)
    return finish(rows, 6)


@query(with_sql(*BASE_SQL, FWINDOW_SQL, future_sql(), correction_sql(), f"terms AS (SELECT station_id, folds, cutoff, unnest([{_CORRECTION_TERMS}]) AS feature, unnest(b) AS coefficient FROM cor_fits WHERE b IS NOT NULL)",
                select="SELECT station_id, folds, cutoff, feature, round(coefficient, 6) AS coefficient, 'linear_gfs' AS model FROM terms"))
def q_correction_coefficients(spark, sf):
    """Fitted terms of the forecast correction per fold."""
    past = history(spark, sf)
    fits = correction_fit(past, panel(spark, sf), folds(past), KEYS, on_short="null")
    return finish(coefficient_table(fits, KEYS, list(X.correction_features()), "linear_gfs"), 6)


@query(with_sql(*BASE_SQL, FWINDOW_SQL, ATTACHED_SQL, future_sql(), all_regressors_sql(ALL_REGRESSORS), select="SELECT station_id, 'prophet_gfs_all' AS model, folds, cutoff, ds, round(yhat, 6) AS yhat, round(yhat - spread, 6) AS yhat_lower, round(yhat + spread, 6) AS yhat_upper FROM covariate_all"))
def q_covariate_all(spark, sf):
    """Correction on all six forecast measures, at every fold and day."""
    past = history(spark, sf)
    rows = additive(past, folds(past), DAILY.hours, KEYS, staged_panel(spark, sf), ALL_REGRESSORS, False, 24, TIE, "prophet_gfs_all", "null")
    return finish(rows, 6)


@query()
def q_structural(spark, sf):
    """Additive trend and seasonality with an 80 per cent interval."""
    past = history(spark, sf)
    return finish(additive(past, folds(past), DAILY.hours, KEYS, step_hours=24, on_short="drop"), 6)


@query()
def q_structural_terms(spark, sf):
    """Fitted terms of the additive model per fold."""
    past = history(spark, sf)
    fits = additive_fit(past, folds(past), KEYS, step_hours=24, on_short="drop")
    return finish(coefficient_table(fits, KEYS, list(additive_terms(True, (), 24)), "prophet"), 6)


@query(with_sql(*BASE_SQL, FWINDOW_SQL, future_sql(), calendar_sql(), correction_sql(), select="""
SELECT c.station_id, c.folds, c.cutoff, c.ds, round(c.yhat, 6) AS linear_c, round(r.yhat, 6) AS linear_gfs_c, round(r.yhat - r.spread, 6) AS linear_gfs_lower_c,
       round(r.yhat + r.spread, 6) AS linear_gfs_upper_c, round(w.gfs_temperature_c, 6) AS raw_gfs_c
FROM calendar c LEFT JOIN corrected r USING (station_id, folds, cutoff, ds) LEFT JOIN fwindow w ON w.station_id = c.station_id AND w.folds = c.folds AND w.cutoff = c.cutoff AND w.valid_time_utc = c.ds"""))
def q_forecast_merge(spark, sf):
    """Calendar, corrected and raw forecasts side by side."""
    past = history(spark, sf)
    rows = merged_forecasts(past, staged_panel(spark, sf), folds(past), DAILY.hours, KEYS, 24, TIE, on_short="null")
    return finish(rows, 6)


@query(with_sql(*BASE_SQL, FWINDOW_SQL, future_sql(), correction_sql(), select="""
SELECT c.station_id, c.folds, c.cutoff, c.ds, coalesce(f.n, 0)::BIGINT AS n_rows,
       CASE WHEN coalesce(f.n, 0) < 50 THEN 'short history' WHEN w.valid_time_utc IS NULL THEN 'no forecast' WHEN w.gfs_temperature_c IS NULL THEN 'missing measure' END AS reason
FROM corrected c LEFT JOIN cor_fits f USING (station_id, folds, cutoff)
LEFT JOIN fwindow w ON w.station_id = c.station_id AND w.folds = c.folds AND w.cutoff = c.cutoff AND w.valid_time_utc = c.ds WHERE c.yhat IS NULL"""))
def q_incomplete_folds(spark, sf):
    """Fold days the forecast correction has no value for, and why."""
    past, runs = history(spark, sf), staged_panel(spark, sf)
    asked = folds(past)
    rows = forecast_correction(past, runs, asked, DAILY.hours, KEYS, tiebreak=TIE, on_short="null", step_hours=24)
    fits = correction_fit(past, runs, asked, KEYS, on_short="null")
    return finish(incomplete_hours(rows, fits, forecast_window(runs, asked, DAILY.hours, KEYS, TIE), KEYS, 50))


# The published settings; two queries but for the number of rounds.
RANKING = {"maxIter": 8}
RECIPE = {"maxIter": 4}
BACKTEST = {}


def row_number():
    """A station and day's number; one row of a matrix has it."""
    return (F.unix_date(F.to_date(VALID)) * 8 + F.substring(STATION, 1, 1).cast("int")).cast("long")


def matrix_sql(cutoff: str | None = None) -> str:
    """``matrix``: the freshest run of every observed hour with its features as a list."""
    legal = f"WHERE init_time_utc < {cutoff} AND valid_time_utc < {cutoff}" if cutoff else ""
    return f"""matrix AS MATERIALIZED (
  SELECT (valid_time_utc::DATE - DATE '1970-01-01') * 8 + substr(p.station_id, 1, 1)::INT AS row, p.station_id, init_time_utc, valid_time_utc, t.y - temperature_c AS y, {FEATURES_SQL.replace("gfs_", "")} AS x
  FROM (SELECT * FROM panel {legal}) p JOIN target t ON t.station_id = p.station_id AND t.ds = valid_time_utc AND t.y IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY p.station_id, valid_time_utc ORDER BY ord DESC) = 1)"""


def _matrix(spark, sf):
    """Pairs with every tree input, null or not, the freshest run per hour."""
    matrix = B.training_matrix(panel(spark, sf), target(spark, sf), at("2000-01-01"), KEYS, DS, Y, TIE)
    return freshest_rows(matrix, (STATION, VALID), TIE)


def ranking_sql() -> str:
    growth = B.growth_of(RANKING)
    grown = grow_sql("sel", "learning", "every", growth)
    names = ", ".join(f"'{n}'" for n in X.TREE_FEATURES)
    return with_sql(
        PANEL_SQL, TARGET_SQL, matrix_sql("TIMESTAMP '2000-01-01'"), cells_sql("matrix", "matrix", growth.bins),
        "learning AS MATERIALIZED (SELECT 0 AS model, row, 'learn' AS kind, y FROM matrix)",
        every_column_sql("learning"), draws_sql(growth, "learning"), *grown.parts,
        select=f"SELECT [{names}][f + 1] AS feature, round(importance, 6) AS importance FROM {grown.importances} WHERE importance > 0 ORDER BY {grown.importances}.importance DESC, f LIMIT 8",
    )


@query(ranking_sql())
def q_topk_importance(spark, sf):
    """Boosted-tree feature ranking: the top eight with a positive importance."""
    rows = cut_lineage(_matrix(spark, sf))
    _, importances = B.select_features(rows, B.TREE_FEATURES, B.LABEL, params=RANKING, row=row_number())
    table = spark.createDataFrame([(i, n, importances[n]) for i, n in enumerate(B.TREE_FEATURES)], "position int, feature string, importance double")
    return finish(B.top_features(table, 8).select("feature", "importance"), 6)


def residual_sql() -> str:
    growth, cutoff = B.growth_of(RECIPE), "TIMESTAMP '2000-01-01'"
    return with_sql(
        PANEL_SQL, TARGET_SQL, matrix_sql(cutoff),
        "marked AS (SELECT *, init_time_utc = max(init_time_utc) OVER (PARTITION BY station_id) AS held FROM matrix)",
        "placed AS (SELECT *, min(CASE WHEN held THEN valid_time_utc END) OVER (PARTITION BY station_id) AS first_held FROM marked)",
        f"""window_rows AS (SELECT station_id, valid_time_utc, {freshest_sql()} FROM panel
  WHERE init_time_utc < {cutoff} AND valid_time_utc >= {cutoff} AND valid_time_utc < {cutoff} + INTERVAL 336 HOUR GROUP BY ALL)""",
        f"ahead AS MATERIALIZED (SELECT -row_number() OVER (ORDER BY station_id, valid_time_utc) AS row, *, {FEATURES_SQL} AS x FROM window_rows)",
        """recipe_rows AS MATERIALIZED (SELECT 0 AS model, row, CASE WHEN held THEN 'held' ELSE 'learn' END AS kind, y FROM placed WHERE held OR valid_time_utc < first_held
  UNION ALL SELECT 1, row, 'learn', y FROM placed UNION ALL SELECT 1, row, 'ask', 0.0::DOUBLE FROM ahead)""",
        "known AS (SELECT row, x FROM matrix UNION ALL SELECT row, x FROM ahead)",
        "trial_rows AS (SELECT row FROM recipe_rows WHERE model = 0 AND kind = 'learn')",
        cells_sql("known", "trial_rows", growth.bins),
        *recipe_sql("recipe_rows", growth, B.MAX_FEATURES),
        select="""SELECT station_id, valid_time_utc AS ds, init_time_utc, round(gfs_temperature_c + pred, 6) AS predicted_temperature_c, round(gfs_temperature_c, 6) AS raw_gfs_temperature_c
FROM ahead JOIN answers USING (row)""",
    )


@query(residual_sql())
def q_gbt_residual(spark, sf):
    """Residual recipe: hold out the latest run, stop early, repeat on all rows, correct the forecast of the next window."""
    fitted, _ = B.residual_recipe(_matrix(spark, sf), RECIPE, keys=KEYS, overlap="trial", row=row_number())
    out = B.corrected_forecast(fitted, panel(spark, sf), at("2000-01-01"), 336, KEYS, TIE)
    return finish(out.select(STATION, DS, INIT, "predicted_temperature_c", F.col(B.RAW).alias("raw_gfs_temperature_c")), 6)


def gbt_backtest_sql() -> str:
    growth = B.growth_of(BACKTEST)
    return with_sql(
        *BASE_SQL, FWINDOW_SQL, future_sql(), matrix_sql(),
        "cutoffs AS MATERIALIZED (SELECT cutoff, row_number() OVER (ORDER BY cutoff) - 1 AS k FROM (SELECT DISTINCT cutoff FROM folds))",
        "later AS MATERIALIZED (SELECT k, matrix.* FROM matrix JOIN cutoffs ON valid_time_utc < cutoff)",
        "marked AS (SELECT *, init_time_utc = max(init_time_utc) OVER (PARTITION BY k, station_id) AS held FROM later)",
        "placed AS (SELECT *, min(CASE WHEN held THEN valid_time_utc END) OVER (PARTITION BY k, station_id) AS first_held FROM marked)",
        "trials AS MATERIALIZED (SELECT 2 * k AS model, row, CASE WHEN held THEN 'held' ELSE 'learn' END AS kind, y FROM placed WHERE held OR valid_time_utc < first_held)",
        "usable AS MATERIALIZED (SELECT model FROM trials GROUP BY model HAVING count(*) FILTER (WHERE kind = 'held') > 0 AND count(*) FILTER (WHERE kind = 'learn') > 0)",
        f"ahead AS MATERIALIZED (SELECT -row_number() OVER (ORDER BY station_id, folds, cutoff, valid_time_utc) AS row, k, fwindow.*, {FEATURES_SQL} AS x FROM fwindow JOIN cutoffs USING (cutoff))",
        """fold_rows AS MATERIALIZED (SELECT trials.* FROM trials JOIN usable USING (model)
  UNION ALL SELECT 2 * k + 1, row, 'learn', y FROM later WHERE 2 * k IN (SELECT model FROM usable)
  UNION ALL SELECT 2 * k + 1, row, 'ask', 0.0::DOUBLE FROM ahead WHERE 2 * k IN (SELECT model FROM usable))""",
        "known AS (SELECT row, x FROM matrix UNION ALL SELECT row, x FROM ahead)",
        "first_rows AS (SELECT row FROM fold_rows WHERE kind = 'learn' AND model = (SELECT min(model) FROM usable))",
        cells_sql("known", "first_rows", growth.bins),
        *recipe_sql("fold_rows", growth, B.MAX_FEATURES, B.PATIENCE),
        "corrected AS (SELECT station_id, folds, cutoff, valid_time_utc AS ds, gfs_temperature_c + pred AS yhat FROM ahead JOIN answers USING (row))",
        select="SELECT station_id, 'xgboost' AS model, folds, cutoff, ds, round(yhat, 6) AS yhat FROM future LEFT JOIN corrected USING (station_id, folds, cutoff, ds)",
    )


@query(gbt_backtest_sql())
def q_gbt_backtest(spark, sf):
    """Boosted correction learned anew at every rolling and seasonal cutoff; hours no run covers come back without a value."""
    past = history(spark, sf)
    out = B.boosted_backtest(past, staged_panel(spark, sf), folds(past).select(STATION, FOLDS, CUTOFF), DAILY.hours, KEYS, BACKTEST, step_hours=24, tiebreak=TIE, overlap="trial", row=row_number())
    return finish(out.select(STATION, MODEL, FOLDS, CUTOFF, DS, "yhat"), 6)
