"""Scoring: fold metrics, coverage, lead-day curves, summaries and error distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridcast.functions.vocabulary import CUTOFF, DS, FOLDS, MODEL, Y

TOTAL = "all"
BY_FOLD = (MODEL, FOLDS, CUTOFF)
HOURS_PER_YEAR = 365.25 * 24


def with_truth(predictions: DataFrame, history: DataFrame, keys: Sequence[str] = (), how: str = "left") -> DataFrame:
    """Attach observed values; hours without one stay, unscored."""
    return predictions.join(history.select(*keys, DS, Y), [*keys, DS], how)


def coverage() -> Column:
    """Share of observations inside the interval; null when a fold has no bounds at all.

    Once any bound is present, a row without bounds counts as not covered.
    """
    bounded = F.count("yhat_lower") + F.count("yhat_upper") > 0
    inside = F.coalesce(F.col(Y).between(F.col("yhat_lower"), F.col("yhat_upper")), F.lit(False))
    return F.when(bounded, F.avg(inside.cast("int")))


def error_metrics(predicted: Column, actual: Column) -> list[Column]:
    e = predicted - actual
    return [
        F.avg(F.abs(e)).alias("mae_c"),
        F.sqrt(F.avg(e * e)).alias("rmse_c"),
        F.avg(e).alias("bias_c"),
        F.max(F.abs(e)).alias("max_abs_error_c"),
    ]


def fold_metrics(scored: DataFrame, by: Sequence[str] = BY_FOLD) -> DataFrame:
    """One metric row per fold over the hours that have an observation."""
    rows = scored.filter(F.col(Y).isNotNull())
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scored_hours"), *error_metrics(F.col("yhat"), F.col(Y)), coverage().alias("interval_coverage")
    )


def with_training(metrics: DataFrame, training: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add training hours and years (``training`` has ``training_hours`` per fold)."""
    joined = metrics.join(training, list(on), "left")
    return joined.withColumn("training_years", F.round(F.col("training_hours") / F.lit(HOURS_PER_YEAR), 2))


def overall(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics over every out-of-sample prediction at once."""
    rows = scored.filter(F.col(Y).isNotNull())
    mae, rmse, bias, _ = error_metrics(F.col("yhat"), F.col(Y))
    return rows.groupBy(*by).agg(mae, rmse, bias, F.count(F.lit(1)).alias("n_predictions"))


def lead_day(ds: str = DS, cutoff: str = CUTOFF) -> Column:
    return (F.floor((F.unix_seconds(ds) - F.unix_seconds(cutoff)) / F.lit(86400)) + 1).cast("int")


def by_lead_day(scored: DataFrame, by: Sequence[str] = BY_FOLD) -> DataFrame:
    """Mean absolute error per day of lead time."""
    rows = scored.filter(F.col(Y).isNotNull()).withColumn("lead_day", lead_day())
    return rows.groupBy(*by, "lead_day").agg(
        F.avg(F.abs(F.col("yhat") - F.col(Y))).alias("mae_c"), F.count(F.lit(1)).alias("scored_hours")
    )


def lead_day_curve(lead_days: DataFrame, by: Sequence[str] = (MODEL, FOLDS)) -> DataFrame:
    """Mean of the per-fold lead-day errors, and the number of folds behind it."""
    return lead_days.groupBy(*by, "lead_day").agg(
        F.avg("mae_c").alias("mean_mae_c"), F.count_distinct(CUTOFF).alias("n_folds")
    )


def curve_ceiling(curve: DataFrame, headroom: float = 1.0) -> DataFrame:
    return curve.agg((F.max("mean_mae_c") * F.lit(headroom)).alias("ceiling_c"))


def _weighted(metric: str, weight: str = "scored_hours") -> Column:
    present = F.when(F.col(metric).isNotNull(), F.col(weight))
    return F.sum(F.col(metric) * present) / F.sum(present)


def pooled_rmse(metric: str = "rmse_c", weight: str = "scored_hours") -> Column:
    """Root of the weighted mean square: exactly one pass over every residual."""
    present = F.when(F.col(metric).isNotNull(), F.col(weight))
    return F.sqrt(F.sum(F.col(metric) * F.col(metric) * present) / F.sum(present))


def total_rows(metrics: DataFrame, by: Sequence[str] = (MODEL, FOLDS)) -> DataFrame:
    """Hour-weighted totals over the folds; a fold lacking a metric is left out of that metric."""
    sums = [F.sum("scored_hours").alias("scored_hours")]
    if "training_hours" in metrics.columns:
        sums.append(F.sum("training_hours").alias("training_hours"))
    return metrics.groupBy(*by).agg(
        *sums,
        _weighted("mae_c").alias("mae_c"),
        pooled_rmse().alias("rmse_c"),
        _weighted("bias_c").alias("bias_c"),
        F.max("max_abs_error_c").alias("max_abs_error_c"),
        _weighted("interval_coverage").alias("interval_coverage"),
    )


def summarize(metrics: DataFrame, by: Sequence[str] = (MODEL, FOLDS)) -> DataFrame:
    """Fold rows plus one ``cutoff = 'all'`` row per group; cutoff becomes text."""
    text = F.date_format(F.col(CUTOFF), "yyyy-MM-dd HH:mm:ss") if metrics.schema[CUTOFF].dataType.typeName() != "string" else F.col(CUTOFF)
    folds = metrics.withColumn(CUTOFF, text)
    return folds.unionByName(total_rows(metrics, by).withColumn(CUTOFF, F.lit(TOTAL)), allowMissingColumns=True)


def per_fold(summary: DataFrame) -> DataFrame:
    return summary.filter(F.col(CUTOFF).cast("string") != TOTAL)


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles without gathering a group in one task.

    A mergeable sketch brackets each quantile; equal values are counted and
    only those inside the narrow bracket are ordered, with everything below it
    contributing a count.
    """
    accuracy, slack = 10_000, 4e-4
    fences = [f for q in quantiles for f in (max(q - slack, 0.0), min(q + slack, 1.0))]
    data = rows.filter(F.col(value).isNotNull())
    counts = data.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    sketch = data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(value, fences, accuracy).alias("_f"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
    )
    # A small group is its own bracket: its neighbouring ranks are too few for the slack.
    few = F.col("_n") <= accuracy
    wanted = sketch.select(
        *by,
        "_n",
        F.explode(
            F.array(*[
                F.struct(
                    F.lit(i).alias("i"),
                    F.lit(q).alias("q"),
                    F.when(few | F.lit(q <= slack), F.col("_min")).otherwise(F.get("_f", F.lit(2 * i))).alias("lo"),
                    F.when(few | F.lit(q >= 1 - slack), F.col("_max")).otherwise(F.get("_f", F.lit(2 * i + 1))).alias("hi"),
                )
                for i, q in enumerate(quantiles)
            ])
        ).alias("w"),
    ).select(*by, "_n", "w.*")
    met = counts.join(wanted, list(by)) if by else counts.withColumn("_k", F.lit(1)).join(wanted.withColumn("_k", F.lit(1)), "_k").drop("_k")
    near = met.filter(F.col("_v") <= F.col("hi"))
    # Everything below the bracket collapses to one row before any ordering.
    folded = near.groupBy(*by, "i", "q", "_n", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v")).agg(F.sum("_c").alias("_c"))
    order = Window.partitionBy(*by, "i").orderBy(F.col("_v").asc_nulls_first())
    ranked = folded.withColumn("_cum", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.col("q") * (F.col("_n") - 1)
    low, high = F.floor(rank), F.ceil(rank)
    picked = ranked.groupBy(*by, "i", "q", "_n").agg(
        F.min(F.when(F.col("_v").isNotNull() & (F.col("_cum") > low), F.col("_v"))).alias("a"),
        F.min(F.when(F.col("_v").isNotNull() & (F.col("_cum") > high), F.col("_v"))).alias("b"),
    )
    valued = picked.withColumn("_q", F.col("a") + (F.col("b") - F.col("a")) * (rank - F.floor(rank)))
    names = {i: f"q{i}" for i in range(len(quantiles))}
    return valued.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, F.col("_q"))).alias(n) for i, n in names.items()])


def box_summary(scored: DataFrame, by: Sequence[str] = BY_FOLD) -> DataFrame:
    """Signed-error box per fold: quartiles, whiskers within 1.5 IQR, bias."""
    errors = scored.select(*by, (F.col("yhat") - F.col(Y)).alias("error_c")).filter(F.col("error_c").isNotNull())
    quartiles = exact_quantiles(errors, by, "error_c", (0.25, 0.5, 0.75))
    boxes = quartiles.select(*by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    joined = errors.join(boxes, list(by))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    e = F.col("error_c")
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        F.least(F.min(F.when(e >= F.col("q1") - reach, e)), F.col("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(e <= F.col("q3") + reach, e)), F.col("q3")).alias("whisker_high"),
        F.avg(e).alias("bias_c"),
        F.count(F.lit(1)).alias("scored_hours"),
    )


def stored_predictions(stored: DataFrame, model: str, folds: str) -> DataFrame:
    """One model on one fold set with lead day and signed error; an empty selection is an error."""
    rows = stored.filter((F.col(MODEL) == model) & (F.col(FOLDS) == folds))
    if rows.isEmpty():
        raise ValueError(f"No {model!r} predictions on the {folds!r} folds.")
    return rows.withColumns({"lead_day": lead_day(), "error_c": F.col("yhat") - F.col(Y)})
