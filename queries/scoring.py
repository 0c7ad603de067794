"""Queries that score and compare models on identical folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions.vocabulary import CUTOFF, DS, FOLDS, MODEL, STATION, Y
from gridcast.operators import compare as K
from gridcast.operators import metrics as M
from gridcast.operators.folds import rolling_cutoffs
from gridcast.plans.baselines import persistence
from gridcast.plans.registry import run_models, score, training_hours
from gridcast.session import cut_lineage, shared_dir
from queries.bindings import DAILY, FOLDS_SQL, TARGET_SQL, TRAINABLE_PARTS, finish, history, staged_panel, trainable, with_sql
from queries.models import CLIMATOLOGY_SQL, PERSISTENCE_SQL, RAW_SQL, future_sql, simple_sql

QUERIES, ORACLE = {}, {}
NAMES = ("persistence", "climatology", "raw_gfs", "prophet_gfs")
BY = (MODEL, FOLDS, CUTOFF)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def scored(spark, sf):
    """Four models on the trainable folds with the truth attached; also history and folds."""
    past = history(spark, sf)
    runs = staged_panel(spark, sf)
    folds = trainable(past, runs)
    rows = M.with_truth(run_models(NAMES, past, folds, runs, DAILY), past, (STATION,))
    return rows, past, folds


def fold_rows(spark, sf):
    """Metric rows per model and fold, a small table that comparisons read several times."""
    rows, _, _ = scored(spark, sf)
    return cut_lineage(M.fold_metrics(rows))


SCORED = (
    *TRAINABLE_PARTS,
    future_sql("trainable"),
    CLIMATOLOGY_SQL,
    PERSISTENCE_SQL,
    RAW_SQL + ",\nraw_kept AS (SELECT raw.* FROM raw JOIN trainable USING (station_id, folds, cutoff))",
    simple_sql("trainable"),
    """predictions AS (SELECT * FROM climatology UNION ALL SELECT * FROM persistence UNION ALL SELECT * FROM raw_kept UNION ALL SELECT * FROM simple),
scored AS (SELECT p.*, t.y FROM predictions p LEFT JOIN target t ON t.station_id = p.station_id AND t.ds = p.ds)""",
)
METRICS_SQL = """metrics AS (
  SELECT model, folds, cutoff, count(*) AS scored_hours, avg(abs(yhat - y)) AS mae_c, sqrt(avg((yhat - y) * (yhat - y))) AS rmse_c, avg(yhat - y) AS bias_c,
         max(abs(yhat - y)) AS max_abs_error_c,
         CASE WHEN count(yhat_lower) + count(yhat_upper) > 0 THEN avg(CASE WHEN y BETWEEN yhat_lower AND yhat_upper THEN 1 ELSE 0 END) END AS interval_coverage
  FROM scored WHERE y IS NOT NULL GROUP BY ALL)"""
ROUNDED = "scored_hours, round(mae_c, 7) AS mae_c, round(rmse_c, 7) AS rmse_c, round(bias_c, 7) AS bias_c, round(max_abs_error_c, 7) AS max_abs_error_c, round(interval_coverage, 7) AS interval_coverage"


@query(with_sql(TARGET_SQL, FOLDS_SQL, "kept AS (SELECT * FROM folds WHERE folds = 'rolling')", future_sql("kept"), PERSISTENCE_SQL, """
scored AS (SELECT p.*, t.y FROM persistence p LEFT JOIN target t ON t.station_id = p.station_id AND t.ds = p.ds)""", select="""
SELECT station_id, model, folds, cutoff, count(*) AS scored_hours, round(avg(abs(yhat - y)), 7) AS mae_c, round(sqrt(avg((yhat - y) * (yhat - y))), 7) AS rmse_c,
       round(avg(yhat - y), 7) AS bias_c, round(max(abs(yhat - y)), 7) AS max_abs_error_c, CAST(NULL AS DOUBLE) AS interval_coverage
FROM scored WHERE y IS NOT NULL GROUP BY ALL"""))
def q_persistence_skill(spark, sf):
    """Gap-preserving daily target, persistence at every rolling cutoff, metrics per series and fold."""
    past = history(spark, sf)
    folds = rolling_cutoffs(past, (STATION,), step_hours=24)
    rows = M.with_truth(persistence(past, folds, DAILY.hours, (STATION,), 24), past, (STATION,))
    return finish(M.fold_metrics(rows, (STATION, *BY)), 7)


@query(with_sql(*SCORED, select="""
SELECT station_id, model, folds, cutoff, ds, round(yhat, 7) AS yhat, round(yhat_lower, 7) AS yhat_lower, round(yhat_upper, 7) AS yhat_upper, round(y, 7) AS y FROM scored"""))
def q_backtest_registry(spark, sf):
    """Registered models on identical trainable folds, truth attached."""
    rows, _, _ = scored(spark, sf)
    return finish(rows, 7)


@query(with_sql(*SCORED, METRICS_SQL, select=f"SELECT model, folds, cutoff, {ROUNDED} FROM metrics"))
def q_fold_metrics(spark, sf):
    """Error metrics and interval coverage per model and fold, pooled over series."""
    rows, _, _ = scored(spark, sf)
    return finish(M.fold_metrics(rows), 7)


@query(with_sql(*SCORED, select="""
SELECT model, folds, CASE WHEN count(yhat_lower) + count(yhat_upper) > 0 THEN round(avg(CASE WHEN y BETWEEN yhat_lower AND yhat_upper THEN 1 ELSE 0 END), 7) END AS interval_coverage,
       count(yhat_lower) AS bounded FROM scored WHERE y IS NOT NULL GROUP BY ALL"""))
def q_coverage(spark, sf):
    """Interval coverage per model; null where no interval was estimated."""
    rows, _, _ = scored(spark, sf)
    known = rows.filter(F.col(Y).isNotNull())
    return finish(known.groupBy(MODEL, FOLDS).agg(M.coverage().alias("interval_coverage"), F.count("yhat_lower").alias("bounded")), 7)


@query(with_sql(*SCORED, select="""
SELECT model, folds, cutoff, date_diff('day', cutoff, ds) + 1 AS lead_day, round(avg(abs(yhat - y)), 7) AS mae_c, count(*) AS scored_hours FROM scored WHERE y IS NOT NULL GROUP BY ALL"""))
def q_lead_day(spark, sf):
    """Mean absolute error by day of lead time, per fold."""
    rows, _, _ = scored(spark, sf)
    return finish(M.by_lead_day(rows), 7)


@query(with_sql(*SCORED, """days_of_lead AS (SELECT model, folds, cutoff, date_diff('day', cutoff, ds) + 1 AS lead_day, avg(abs(yhat - y)) AS mae_c FROM scored WHERE y IS NOT NULL GROUP BY ALL),
curve AS (SELECT model, folds, lead_day, avg(mae_c) AS m, count(DISTINCT cutoff) AS n_folds FROM days_of_lead GROUP BY ALL)""",
                select="SELECT model, folds, lead_day, round(m, 7) AS mean_mae_c, n_folds, round((SELECT max(m) FROM curve), 7) AS ceiling_c FROM curve"))
def q_lead_day_curve(spark, sf):
    """Mean of the per-fold lead-day errors, the folds behind it and the largest value of all curves."""
    rows, _, _ = scored(spark, sf)
    curve = cut_lineage(M.lead_day_curve(M.by_lead_day(rows)))
    ceiling = M.curve_ceiling(curve).first()["ceiling_c"]
    return finish(curve.withColumn("ceiling_c", F.lit(ceiling).cast("double")), 7)


_TOTAL = """totals AS (
  SELECT model, folds, 'all' AS cutoff, CAST(sum(scored_hours) AS BIGINT) AS scored_hours, sum(mae_c * scored_hours) / sum(scored_hours) FILTER (WHERE mae_c IS NOT NULL) AS mae_c,
         sqrt(sum(rmse_c * rmse_c * scored_hours) / sum(scored_hours) FILTER (WHERE rmse_c IS NOT NULL)) AS rmse_c, sum(bias_c * scored_hours) / sum(scored_hours) FILTER (WHERE bias_c IS NOT NULL) AS bias_c, max(max_abs_error_c) AS max_abs_error_c,
         sum(interval_coverage * scored_hours) / sum(scored_hours) FILTER (WHERE interval_coverage IS NOT NULL) AS interval_coverage FROM metrics GROUP BY ALL)"""


@query(with_sql(*SCORED, METRICS_SQL, _TOTAL, select=f"""
SELECT model, folds, strftime(cutoff, '%Y-%m-%d %H:%M:%S') AS cutoff, {ROUNDED} FROM metrics UNION ALL SELECT model, folds, cutoff, {ROUNDED} FROM totals"""))
def q_summary_total(spark, sf):
    """Fold rows plus hour-weighted total rows."""
    return finish(M.summarize(fold_rows(spark, sf)), 7)


@query(with_sql(*TRAINABLE_PARTS, select="""
SELECT f.station_id, f.folds, f.cutoff, count(t.y) AS training_hours, round(count(t.y) / (365.25 * 24), 2) AS training_years
FROM trainable f LEFT JOIN target t ON t.station_id = f.station_id AND t.ds < f.cutoff GROUP BY ALL"""))
def q_training_hours(spark, sf):
    """Observed steps before every cutoff, and the years they make."""
    past, runs = history(spark, sf), staged_panel(spark, sf)
    rows = training_hours(past, trainable(past, runs), (STATION,))
    return finish(rows.withColumn("training_years", F.round(F.col("training_hours") / F.lit(M.HOURS_PER_YEAR), 2)))


@query(with_sql(*SCORED, select="""
SELECT model, round(avg(abs(yhat - y)), 7) AS mae_c, round(sqrt(avg((yhat - y) * (yhat - y))), 7) AS rmse_c, round(avg(yhat - y), 7) AS bias_c, count(*) AS n_predictions
FROM scored WHERE y IS NOT NULL GROUP BY 1"""))
def q_overall(spark, sf):
    """Metrics over every out-of-sample prediction of a model."""
    rows, _, _ = scored(spark, sf)
    return finish(M.overall(rows, (MODEL,)), 7)


DIFF_SQL = """diffs AS (
  SELECT a.folds, a.model AS challenger, b.model AS reference, a.cutoff, a.mae_c - b.mae_c AS difference
  FROM metrics a JOIN metrics b ON a.folds = b.folds AND a.cutoff = b.cutoff AND b.model = 'raw_gfs' AND a.model <> 'raw_gfs'
  WHERE a.mae_c IS NOT NULL AND b.mae_c IS NOT NULL)"""
_STATS = """SELECT folds, challenger, reference, count(*) AS n_folds, round(avg(difference), 7) AS mean_difference, count(*) FILTER (WHERE difference < 0) AS challenger_wins,
       round(avg(CASE WHEN difference < 0 THEN 1 ELSE 0 END), 7) AS win_rate"""


@query(with_sql(*SCORED, METRICS_SQL, DIFF_SQL, select=_STATS + ", count(*) >= 8 AS resolving FROM diffs GROUP BY ALL"))
def q_paired_stats(spark, sf):
    """Every model against the raw forecast on shared folds."""
    stats = K.paired_stats(K.differences(fold_rows(spark, sf), reference="raw_gfs"))
    return finish(stats.withColumn("resolving", F.col("n_folds") >= K.MIN_RESOLVING_FOLDS), 7)


@query(with_sql(*SCORED, METRICS_SQL, """chosen AS (
  SELECT a.folds, a.model AS challenger, b.model AS reference, a.mae_c - b.mae_c AS difference FROM metrics a JOIN metrics b ON a.folds = b.folds AND a.cutoff = b.cutoff
  WHERE (a.model = 'prophet_gfs' AND b.model IN ('raw_gfs', 'climatology') AND a.folds = 'rolling') OR (a.model = 'climatology' AND b.model = 'persistence' AND a.folds = 'seasonal' AND b.mae_c IS NOT NULL))""",
                select=_STATS + " FROM chosen GROUP BY ALL"))
def q_paired_list(spark, sf):
    """A chosen list of pairs and fold sets."""
    pairs = [("prophet_gfs", "raw_gfs", "rolling"), ("prophet_gfs", "climatology", "rolling"), ("climatology", "persistence", "seasonal")]
    table = spark.createDataFrame(pairs, f"challenger string, reference string, {FOLDS} string")
    return finish(K.paired_stats(K.differences(fold_rows(spark, sf), pairs=table)), 7)


def _index_sql(r: str, j: str, n: str) -> str:
    """The counter-based draw in SQL: 31-bit multiply, add and xor-shift steps."""
    x = f"(({r} * 40503 + {K.SEED}) & 2147483647)"
    x = f"(({x} * 1103515245 + {j} * 2654435 + 12345) & 2147483647)"
    return x


BOOT_SQL = f"""indexed AS (SELECT *, row_number() OVER (PARTITION BY folds, challenger, reference ORDER BY cutoff) - 1 AS i, count(*) OVER (PARTITION BY folds, challenger, reference) AS n FROM diffs),
sizes AS (SELECT folds, challenger, reference, n, unnest(range(n)) AS j FROM (SELECT DISTINCT folds, challenger, reference, n FROM indexed)),
s0 AS (SELECT folds, challenger, reference, n, r, j, {_index_sql('r', 'j', 'n')} AS x FROM sizes, generate_series(0, {K.RESAMPLES - 1}) g(r)),
s1 AS (SELECT * EXCLUDE (x), ((xor(x, x >> 15) * 1103515245 + 12345) & 2147483647) AS x FROM s0),
s2 AS (SELECT * EXCLUDE (x), ((xor(x, x >> 15) * 22695477 + 1) & 2147483647) AS x FROM s1),
s3 AS (SELECT * EXCLUDE (x), ((xor(x, x >> 15) * 1664525 + 1013904223) & 2147483647) AS x FROM s2),
draws AS (SELECT folds, challenger, reference, r, (xor(x, x >> 13) * n) >> 31 AS i FROM s3),
means AS (SELECT d.folds, d.challenger, d.reference, d.r, avg(difference) AS m FROM draws d JOIN indexed x ON x.folds = d.folds AND x.challenger = d.challenger AND x.reference = d.reference AND x.i = d.i GROUP BY ALL),
ci AS (SELECT folds, challenger, reference, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY ALL)"""


@query(with_sql(*SCORED, METRICS_SQL, DIFF_SQL, BOOT_SQL, select="""
SELECT folds, challenger, reference, count(*) AS n_folds, round(avg(difference), 7) AS mean_difference, count(*) FILTER (WHERE difference < 0) AS challenger_wins,
       round(avg(CASE WHEN difference < 0 THEN 1 ELSE 0 END), 7) AS win_rate, round(lo, 7) AS ci_low, round(hi, 7) AS ci_high, 'mae_c' AS metric,
       lo > 0 OR hi < 0 AS significant, count(*) >= 8 AS resolving FROM diffs JOIN ci USING (folds, challenger, reference) GROUP BY folds, challenger, reference, lo, hi"""))
def q_bootstrap(spark, sf):
    """Paired comparison with the full bootstrap interval against the raw forecast."""
    return finish(K.compare(fold_rows(spark, sf), reference="raw_gfs"), 7)


@query(with_sql(*SCORED, """errors AS (SELECT model, folds, cutoff, yhat - y AS e FROM scored WHERE yhat - y IS NOT NULL),
quart AS (SELECT model, folds, cutoff, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.5) AS median, quantile_cont(e, 0.75) AS q3 FROM errors GROUP BY ALL)""", select="""
SELECT model, folds, cutoff, round(q1, 7) AS q1, round(median, 7) AS median, round(q3, 7) AS q3,
       round(least(min(e) FILTER (WHERE e >= q1 - 1.5 * (q3 - q1)), q1), 7) AS whisker_low, round(greatest(max(e) FILTER (WHERE e <= q3 + 1.5 * (q3 - q1)), q3), 7) AS whisker_high,
       round(avg(e), 7) AS bias_c, count(*) AS scored_hours FROM errors JOIN quart USING (model, folds, cutoff) GROUP BY model, folds, cutoff, q1, median, q3"""))
def q_box_summary(spark, sf):
    """Signed-error quartiles, whiskers and bias per model and fold."""
    rows, _, _ = scored(spark, sf)
    return finish(M.box_summary(cut_lineage(rows)), 7)


@query(with_sql(*SCORED, METRICS_SQL, select=f"""
SELECT m.model, m.folds, m.cutoff, {ROUNDED.replace('scored_hours', 'm.scored_hours', 1)}, t.training_hours, round(t.training_hours / (365.25 * 24), 2) AS training_years
FROM metrics m JOIN (SELECT f.folds, f.cutoff, count(t.y) AS training_hours FROM trainable f LEFT JOIN target t ON t.station_id = f.station_id AND t.ds < f.cutoff GROUP BY ALL) t
  ON t.folds = m.folds AND t.cutoff = m.cutoff"""))
def q_score(spark, sf):
    """Complete metric rows: errors, coverage and training volume."""
    rows, past, folds = scored(spark, sf)
    return finish(score(rows.drop(Y), past, folds, DAILY, by_series=False), 7, training_years=2)


@query(with_sql(*SCORED, select="""
SELECT station_id, cutoff, ds, round(yhat, 7) AS yhat, round(y, 7) AS y, date_diff('day', cutoff, ds) + 1 AS lead_day, round(yhat - y, 7) AS error_c
FROM scored WHERE model = 'prophet_gfs' AND folds = 'rolling'"""))
def q_stored_predictions(spark, sf):
    """One model's stored predictions on one fold set, with lead day and signed error; reads that partition only."""
    rows, _, _ = scored(spark, sf)
    folder = shared_dir(spark, "predictions")
    rows.write.partitionBy(MODEL, FOLDS).parquet(folder)
    shaped = M.stored_predictions(spark.read.parquet(folder), "prophet_gfs", "rolling")
    return finish(shaped.select(STATION, CUTOFF, DS, "yhat", Y, "lead_day", "error_c"), 7)
