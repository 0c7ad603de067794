from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import ts
from pyspark.sql import functions as F

from gridcast.operators import compare as K
from gridcast.operators import metrics as M

PRED = "model string, folds string, cutoff timestamp, ds timestamp, yhat double, yhat_lower double, yhat_upper double, y double"
CUT = ts("2026-01-01T00:00:00")


def rows(errors, model="m", cutoff=CUT, bounds=None, truth=10.0):
    out = []
    for i, e in enumerate(errors):
        y = None if e is None else truth
        yhat = truth if e is None else truth + e
        lo, hi = (None, None) if bounds is None or bounds[i] is None else (yhat - bounds[i], yhat + bounds[i])
        out.append((model, "rolling", cutoff, cutoff + timedelta(hours=i), yhat, lo, hi, y))
    return out


def test_fold_metrics(spark):
    got = M.fold_metrics(spark.createDataFrame(rows([1.0, -2.0, None, 3.0]), PRED)).first()
    assert got["scored_hours"] == 3
    assert got["mae_c"] == pytest.approx(2.0) and got["bias_c"] == pytest.approx(2 / 3)
    assert got["rmse_c"] == pytest.approx(np.sqrt(14 / 3)) and got["max_abs_error_c"] == 3.0
    assert got["interval_coverage"] is None


def test_coverage_counts_unbounded_rows_once_any_bound_exists(spark):
    data = rows([1.0, 2.0, 1.0, 1.0], bounds=[1.0, 1.0, None, 2.0])
    assert M.fold_metrics(spark.createDataFrame(data, PRED)).first()["interval_coverage"] == pytest.approx(0.5)


def test_lead_days(spark):
    got = M.by_lead_day(spark.createDataFrame(rows([1.0] * 24 + [3.0] * 25), PRED)).orderBy("lead_day").collect()
    assert [(r["lead_day"], r["mae_c"], r["scored_hours"]) for r in got] == [(1, 1.0, 24), (2, 3.0, 24), (3, 3.0, 1)]
    curve = M.lead_day_curve(M.by_lead_day(spark.createDataFrame(rows([1.0]) + rows([5.0], cutoff=CUT + timedelta(days=1)), PRED)))
    assert (curve.first()["mean_mae_c"], curve.first()["n_folds"]) == (3.0, 2)
    assert M.curve_ceiling(curve, 2.0).first()[0] == 6.0


def test_totals_weight_by_hours_and_pool_squares(spark):
    a = rows([1.0] * 10, bounds=[2.0] * 10)
    b = rows([3.0] * 30, cutoff=CUT + timedelta(days=14))
    df = spark.createDataFrame(a + b, PRED)
    summary = M.summarize(M.fold_metrics(df))
    total = summary.filter("cutoff = 'all'").first()
    once = M.overall(df).first()
    assert total["scored_hours"] == 40 and total["mae_c"] == pytest.approx(2.5) == once["mae_c"]
    assert total["rmse_c"] == pytest.approx(np.sqrt((10 + 270) / 40)) == pytest.approx(once["rmse_c"])
    assert total["interval_coverage"] == 1.0 and total["max_abs_error_c"] == 3.0
    assert M.per_fold(summary).count() == 2


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 15000])
def test_exact_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.standard_cauchy(n), 3)
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "v": values}))
    got = M.exact_quantiles(df, ["g"], "v", (0.0, 0.25, 0.5, 0.9, 1.0)).first()
    np.testing.assert_allclose([got[f"q{i}"] for i in range(5)], np.quantile(values, [0, 0.25, 0.5, 0.9, 1.0]), rtol=1e-12)


def test_box(spark):
    errors = [-10.0, -1.0, 0.0, 1.0, 2.0, 3.0, 50.0]
    got = M.box_summary(spark.createDataFrame(rows(errors), PRED)).first()
    q1, med, q3 = np.quantile(errors, [0.25, 0.5, 0.75])
    assert (got["q1"], got["median"], got["q3"]) == (pytest.approx(q1), med, q3)
    inside = [e for e in errors if q1 - 1.5 * (q3 - q1) <= e <= q3 + 1.5 * (q3 - q1)]
    assert (got["whisker_low"], got["whisker_high"]) == (min(inside), max(inside))


def test_stored_predictions(spark):
    df = spark.createDataFrame(rows([1.0] * 30), PRED)
    got = M.stored_predictions(df, "m", "rolling").agg(F.max("lead_day"), F.avg("error_c")).first()
    assert tuple(got) == (2, 1.0)
    with pytest.raises(ValueError):
        M.stored_predictions(df, "other", "rolling")


SUMMARY = "cutoff string, model string, folds string, mae_c double, scored_hours long"


def summary(spark, table, folds="rolling"):
    out = []
    for model, values in table.items():
        out += [(f"2026-01-{i + 1:02d}", model, folds, v, 336) for i, v in enumerate(values)]
        out.append(("all", model, folds, 99.0, 1))
    return spark.createDataFrame(out, SUMMARY)


def test_paired_difference(spark):
    df = summary(spark, {"a": [1.0, 2.0, 3.0], "b": [2.0, 2.0, 5.0], "c": [1.0, 1.0, None]})
    got = {r["challenger"]: r for r in K.compare(df, reference="b", resamples=500).collect()}
    assert got["a"]["n_folds"] == 3 and got["a"]["mean_difference"] == pytest.approx(-1.0) and got["a"]["challenger_wins"] == 2
    assert got["a"]["win_rate"] == pytest.approx(2 / 3) and got["c"]["n_folds"] == 2
    assert got["a"]["resolving"] is False and got["a"]["metric"] == "mae_c"


def test_interval_agrees_with_numpy(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(3, 1, 40)
    df = summary(spark, {"a": (base + rng.normal(-0.3, 0.6, 40)).tolist(), "b": base.tolist()})
    native = K.compare(df, reference="b", resamples=8000).first()
    seeded = K.compare(df, reference="b", resamples=8000, seeded=True).first()
    assert native["ci_low"] == pytest.approx(seeded["ci_low"], abs=0.02)
    assert native["ci_high"] == pytest.approx(seeded["ci_high"], abs=0.02)
    again = K.compare(df, reference="b", resamples=8000).first()
    assert (native["ci_low"], native["ci_high"]) == (again["ci_low"], again["ci_high"])
    other = K.compare(df, reference="b", resamples=8000, seed=1).first()
    assert other["ci_low"] != native["ci_low"]


def test_draws_are_uniform(spark):
    n = 19
    slots = spark.range(20000).select(F.col("id").alias("r"), F.lit(n).cast("long").alias("n"), F.explode(F.array(*[F.lit(j).cast("long") for j in (3, 4)])).alias("j"))
    draws = K.with_draws(slots, "r", "j", "n", K.SEED, "i").toPandas()
    counts = np.bincount(draws[draws.j == 3].i, minlength=n)
    chi = ((counts - 20000 / n) ** 2 / (20000 / n)).sum()
    assert len(counts) == n and counts.min() > 0 and chi < 50
    wide = draws.pivot(index="r", columns="j", values="i")
    assert abs(np.corrcoef(wide[3], wide[4])[0, 1]) < 0.03


def test_clear_differences_are_significant_and_noise_is_not(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(3, 0.2, 30)
    df = summary(spark, {"better": (base - 1).tolist(), "same": (base + rng.normal(0, 0.5, 30)).tolist(), "b": base.tolist()})
    got = {r["challenger"]: r["significant"] for r in K.compare(df, reference="b", resamples=2000).collect()}
    assert got["better"] is True and got["same"] is False


def test_pair_list_and_unknown_models(spark):
    df = summary(spark, {"a": [1.0, 2.0], "b": [2.0, 3.0], "c": [0.0, 0.0]})
    pairs = spark.createDataFrame([("a", "b", "rolling"), ("c", "a", "rolling")], "challenger string, reference string, folds string")
    got = {(r["challenger"], r["reference"]): r["mean_difference"] for r in K.compare(df, pairs=pairs, resamples=50).collect()}
    assert got == {("a", "b"): -1.0, ("c", "a"): -1.5}
    with pytest.raises(ValueError, match="zzz"):
        K.require_pairs(df, [("zzz", "a", "rolling")])
    with pytest.raises(ValueError):
        K.require_pairs(df, [("a", "b", "seasonal")])


def test_a_repeated_key_is_refused(spark):
    rows = [("a", "s", "2024-01-01", "m", 1.0), ("b", "s", "2024-01-01", "m", 2.0)]
    summary = spark.createDataFrame(rows, "station_id string, folds string, cutoff string, model string, mae_c double")
    K.require_one_row(summary, ("station_id",))
    with pytest.raises(ValueError):
        K.require_one_row(summary)
