"""Data contracts: schema checks on the driver, value checks as one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Columns that reveal the answer.
FORBIDDEN_FEATURES = frozenset({"temperature_c", "temperature_source"})


def infinite(name: str) -> Column:
    v = F.col(name).cast("double")
    return F.abs(v) == F.lit(float("inf"))


def missing(name: str) -> Column:
    return F.col(name).isNull() | F.isnan(F.col(name).cast("double"))


def violations(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    """One row per checked column: null-or-NaN count and infinite count."""
    names = [*features, *([label] if label else [])]
    marks = [F.count_if(missing(n)).alias(f"m:{n}") for n in names] + [F.count_if(infinite(n)).alias(f"i:{n}") for n in names]
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *marks)
    lines = F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"`m:{n}`").alias("missing"), F.col(f"`i:{n}`").alias("infinite")) for n in names
    ])
    return counted.select("rows", F.explode(lines).alias("v")).select("v.*", "rows")


def check_feature_names(df: DataFrame, features: Sequence[str], forbidden=FORBIDDEN_FEATURES) -> None:
    if len(set(features)) != len(features):
        raise ValueError("Feature names must be unique.")
    absent = [f for f in features if f not in df.columns]
    if absent:
        raise ValueError(f"Features are missing: {absent}.")
    leaking = sorted(set(features) & forbidden)
    if leaking:
        raise ValueError(f"Features contain target-derived columns: {leaking}.")
    textual = [f for f in features if not isinstance(df.schema[f].dataType, T.NumericType)]
    if textual:
        raise TypeError(f"Features contain non-numeric columns: {textual}.")


def check_features(df: DataFrame, features: Sequence[str], label: str | None = None, forbidden=FORBIDDEN_FEATURES, allow_missing: bool = True) -> int:
    """Validate names, types and values; returns the row count."""
    check_feature_names(df, features, forbidden)
    if label is not None and not isinstance(df.schema[label].dataType, T.NumericType):
        raise TypeError("The label must be numeric.")
    found = violations(df, features, label).collect()
    rows = found[0]["rows"]
    if not rows:
        raise ValueError("There are no rows to fit.")
    unbounded = [r["column"] for r in found if r["infinite"]]
    if unbounded:
        raise ValueError(f"Infinite values in columns: {unbounded}.")
    holes = [r["column"] for r in found if r["missing"] and (not allow_missing or r["column"] == label)]
    if holes:
        raise ValueError(f"Missing values in columns: {holes}.")
    return rows


def check_order(features: Sequence[str], trained: Sequence[str]) -> None:
    if list(features) != list(trained):
        raise ValueError("Columns must match the training columns and their order.")


def check_holdout(train: DataFrame, validation: DataFrame, ts: str, keys: Sequence[str] = ()) -> None:
    """Per series, training and validation times unique, disjoint, and validation strictly later.

    Both sides are counted by (series, time) in one job; only one row reaches the driver.
    """
    held = F.col("_held")
    both = train.select(*keys, F.col(ts).alias("_t"), F.lit(False).alias("_held")).unionByName(
        validation.select(*keys, F.col(ts).alias("_t"), F.lit(True).alias("_held"))
    )
    times = both.groupBy(*keys, "_t").agg(F.count_if(~held).alias("_train"), F.count_if(held).alias("_later"))
    in_train, in_later = F.col("_train") > 0, F.col("_later") > 0
    series = times.groupBy(*keys).agg(
        F.max("_train").alias("train_repeats"),
        F.max("_later").alias("later_repeats"),
        F.count_if(in_train & in_later).alias("shared"),
        (F.max(F.when(in_train, F.col("_t"))) >= F.min(F.when(in_later, F.col("_t")))).alias("early"),
    )
    found = series.agg(F.max("train_repeats"), F.max("later_repeats"), F.max("shared"), F.bool_or("early")).first()
    for name, repeats in (("Training", found[0]), ("Validation", found[1])):
        if repeats is not None and repeats > 1:
            raise ValueError(f"{name} times must be unique.")
    if found[2]:
        raise ValueError("Training and validation times cannot overlap.")
    if found[3]:
        raise ValueError("Validation rows must come after all training rows.")


def unmatched_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, tagged by side."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    only_left = a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left"))
    only_right = b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)
