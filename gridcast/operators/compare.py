"""Paired model comparison over shared folds, with a bootstrap interval."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gridcast.functions.vocabulary import CUTOFF, FOLDS, MODEL
from gridcast.operators.metrics import per_fold
from gridcast.session import spread

RESAMPLES = 20_000
SEED = 20260917
MIN_RESOLVING_FOLDS = 8
PAIR = ("challenger", "reference")

# Multiplier and increment of the 31-bit mixing steps.
_MASK = 2147483647
_STEPS = ((1103515245, 12345), (22695477, 1), (1664525, 1013904223))


def with_draws(df: DataFrame, resample: str, slot: str, size: str, seed: int, out: str) -> DataFrame:
    """Add a uniform index below ``size`` per bootstrap draw, a pure function of its row.

    Counter-based: no generator state, so any task computes any draw and a
    retried task repeats it exactly. Integer arithmetic stays below 2**62.
    Each mixing step is its own projection: nested into one expression, every
    step would evaluate the one before it twice.
    """
    mask, x = F.lit(_MASK), F.col(out)
    mixed = df.withColumn(out, (F.col(resample) * F.lit(40503) + F.lit(seed % _MASK)).bitwiseAND(mask))
    mixed = mixed.withColumn(out, (x * F.lit(1103515245) + F.col(slot) * F.lit(2654435) + F.lit(12345)).bitwiseAND(mask))
    for a, c in _STEPS:
        mixed = mixed.withColumn(out, (x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(a) + F.lit(c)).bitwiseAND(mask))
    return mixed.withColumn(out, F.shiftright(x.bitwiseXOR(F.shiftright(x, 13)) * F.col(size), 31))


def differences(summary: DataFrame, metric: str = "mae_c", reference: str | None = None, pairs: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Per shared fold, challenger minus reference.

    Either every other model against one reference on every fold set, or the
    rows of a pair table (challenger, reference, folds).
    """
    rows = per_fold(summary).filter(F.col(metric).isNotNull()).select(*keys, FOLDS, CUTOFF, MODEL, F.col(metric).alias("_m"))
    a = rows.select(*keys, FOLDS, CUTOFF, F.col(MODEL).alias("challenger"), F.col("_m").alias("_a"))
    b = rows.select(*keys, FOLDS, CUTOFF, F.col(MODEL).alias("reference"), F.col("_m").alias("_b"))
    if reference is not None:
        b = b.filter(F.col("reference") == reference)
        a = a.filter(F.col("challenger") != reference)
        met = a.join(b, [*keys, FOLDS, CUTOFF])
    else:
        chosen = a.join(pairs.select("challenger", "reference", FOLDS), ["challenger", FOLDS])
        met = chosen.join(b, [*keys, FOLDS, CUTOFF, "reference"])
    return met.select(*keys, FOLDS, *PAIR, CUTOFF, (F.col("_a") - F.col("_b")).alias("difference"))


def require_one_row(summary: DataFrame, keys: Sequence[str] = ()) -> None:
    """Differences pair rows by their key; a key held by several rows would pair every one with every other."""
    names = [*keys, FOLDS, CUTOFF, MODEL]
    repeated = per_fold(summary).groupBy(*names).count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError(f"The summary has several rows for one of {names}; name the columns that tell them apart as keys.")


def require_pairs(summary: DataFrame, pairs: Sequence[tuple[str, str, str]], metric: str = "mae_c") -> None:
    """Unknown models or pairs without a shared fold are errors."""
    known = {(r[FOLDS], r[MODEL]) for r in per_fold(summary).filter(F.col(metric).isNotNull()).select(FOLDS, MODEL).distinct().collect()}
    for challenger, reference, folds in pairs:
        absent = sorted(m for m in (challenger, reference) if (folds, m) not in known)
        if absent:
            raise ValueError(f"No {metric} for {absent} on the {folds!r} folds.")


def paired_stats(diffs: DataFrame, by: Sequence[str] = (FOLDS, *PAIR)) -> DataFrame:
    return diffs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("difference").alias("mean_difference"),
        F.count_if(F.col("difference") < 0).alias("challenger_wins"),
        F.avg((F.col("difference") < 0).cast("int")).alias("win_rate"),
    )


def resample(diffs: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, by: Sequence[str] = (FOLDS, *PAIR)) -> DataFrame:
    """Mean difference of every bootstrap resample: (by, resample, mean).

    Draws are generated from one row per pair, resolved to fold differences by
    an equi-join on the drawn index, and averaged; nothing is collected.
    """
    order = Window.partitionBy(*by).orderBy(CUTOFF)
    indexed = diffs.withColumn("_i", (F.row_number().over(order) - 1).cast("long")).select(*by, "_i", "difference")
    sizes = diffs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    # One row per resample is spread over the cluster before the draws fan out.
    fanned = sizes.withColumn("resample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    slots = spread(fanned, *by, "resample").withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    drawn = with_draws(slots, "resample", "_j", "_n", seed, "_i").drop("_j", "_n")
    # Generated draws look as small as the pairs they came from; the hint keeps them from being the built side.
    return drawn.join(indexed.hint("shuffle_hash"), [*by, "_i"]).groupBy(*by, "resample").agg(F.avg("difference").alias("mean"))


def intervals(draws: DataFrame, by: Sequence[str] = (FOLDS, *PAIR), confidence: float = 95.0) -> DataFrame:
    """Percentile interval of the resample means; a pair has exactly ``resamples`` of them."""
    tail = (100.0 - confidence) / 200.0
    return draws.groupBy(*by).agg(
        F.percentile("mean", F.lit(tail)).alias("ci_low"), F.percentile("mean", F.lit(1.0 - tail)).alias("ci_high")
    )


def seeded_intervals(diffs: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, by: Sequence[str] = (FOLDS, *PAIR), confidence: float = 95.0) -> DataFrame:
    """The interval from one seeded numpy generator per pair, for repeating published figures.

    A pair's group is its fold differences only (the fold schedule bounds it).
    """
    tail = (100.0 - confidence) / 2.0
    names = list(by)
    fields = {f.name: f.dataType.simpleString() for f in diffs.schema.fields}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(CUTOFF)["difference"].to_numpy()
        means = np.random.default_rng(seed).choice(values, size=(resamples, values.size), replace=True).mean(axis=1)
        low, high = np.percentile(means, [tail, 100.0 - tail])
        return pd.DataFrame([{**{n: pdf[n].iloc[0] for n in names}, "ci_low": low, "ci_high": high}])

    schema = ", ".join([f"`{n}` {fields[n]}" for n in names] + ["ci_low double", "ci_high double"])
    return diffs.groupBy(*names).applyInPandas(one, schema)


def compare(
    summary: DataFrame,
    metric: str = "mae_c",
    reference: str | None = None,
    pairs: DataFrame | None = None,
    resamples: int = RESAMPLES,
    seed: int = SEED,
    seeded: bool = False,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Comparison rows for all requested pairs in one plan."""
    by = (*keys, FOLDS, *PAIR)
    diffs = differences(summary, metric, reference, pairs, keys)
    ci = seeded_intervals(diffs, resamples, seed, by) if seeded else intervals(resample(diffs, resamples, seed, by), by)
    rows = paired_stats(diffs, by).join(ci, list(by))
    return rows.withColumns(
        {
            "metric": F.lit(metric),
            "significant": (F.col("ci_low") > 0) | (F.col("ci_high") < 0),
            "resolving": F.col("n_folds") >= MIN_RESOLVING_FOLDS,
        }
    )
