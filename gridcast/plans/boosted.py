"""Boosted-tree correction of the forecast.

The label is the forecast's residual; predictions are added back to the raw
forecast. A recipe holds out each series' latest run, ranks the features by a first fit,
stops a second fit early on that run, and repeats both on every row. The trial
and the repeat grow side by side: a booster cut at its best round is the
booster grown that far, so nothing is fitted again. A backtest grows the
recipes of all its cutoffs in the same passes. Null features are learned from.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridcast.functions.features import TREE_FEATURES, tree_features
from gridcast.functions.vocabulary import CUTOFF, DS, FOLDS, HORIZON_HOURS, INIT, LEAD, OBSERVED, PREFIX, STATION, VALID
from gridcast.operators.contracts import FORBIDDEN_FEATURES, check_feature_names, check_features, check_holdout, check_order
from gridcast.operators.covariates import forecast_at, forecast_window, freshest_rows, latest_run_block, training_pairs
from gridcast.operators.folds import future_frame
from gridcast.plans.baselines import shape
from gridcast.plans.trees import TREES, WHOLE, Forest, Growth, best_rounds, binned, fit_edges, grow, grow_in_tasks
from gridcast.session import cut_lineage, spread

LABEL = "residual_c"
RAW = PREFIX + "temperature_c"
ARTIFACT_VERSION = 2

# Published learner settings and their names here.
DEFAULT_PARAMS: dict[str, Any] = {
    "maxIter": 500,
    "stepSize": 0.05,
    "maxDepth": 4,
    "minInstancesPerNode": 5,
    "subsamplingRate": 0.8,
    "columnRate": 0.8,
    "leafPenalty": 1.0,
    "seed": 42,
}
PATIENCE = 50
MAX_FEATURES = 8


def training_matrix(panel: DataFrame, target: DataFrame, cutoff, keys: Sequence[str] = (STATION,), ts: str = "timestamp_utc", value: str = "temperature_c", extra: Sequence[str] = ()) -> DataFrame:
    """Thirteen features, the observed value, the residual label and both clocks."""
    pairs = training_pairs(panel, target, cutoff, keys, ts, value, extra)
    return pairs.select(
        *keys, *extra, INIT, VALID, F.col(LEAD), *[c.alias(n) for n, c in tree_features(pairs).items()], OBSERVED
    ).withColumn(LABEL, F.col(OBSERVED) - F.col(RAW))


def forecast_matrix(panel: DataFrame, cutoff, hours: int = HORIZON_HOURS, keys: Sequence[str] = (STATION,), tiebreak: Sequence[str] = ()) -> DataFrame:
    """The same features for a forecast window."""
    rows = forecast_at(panel, cutoff, hours, keys, tiebreak)
    return rows.select(*keys, INIT, VALID, F.col(LEAD), *[c.alias(n) for n, c in tree_features(rows).items()])


def growth_of(params: Mapping[str, Any] | None) -> Growth:
    return Growth.of({**DEFAULT_PARAMS, **(params or {})})


def row_number_of(rows: DataFrame) -> Column:
    """A number that names a row, by which rounds draw their rows."""
    names = [c for c in (INIT, VALID) if c in rows.columns] or rows.columns
    others = [c for c in rows.columns if c not in (*names, *TREE_FEATURES, LABEL, OBSERVED, LEAD)]
    return F.pmod(F.xxhash64(*names, *others), F.lit((1 << 31) - 1))


@dataclass
class Boosted:
    """A fitted booster with the feature contract it must be used with."""

    features: list[str]
    forest: Forest
    model: int = 0
    candidates: dict[str, float] = field(default_factory=dict)
    best_iteration: int | None = None
    max_features: int | None = MAX_FEATURES
    min_importance: float = 0.0
    patience: int | None = PATIENCE
    forbidden: frozenset[str] = FORBIDDEN_FEATURES

    def kept(self) -> DataFrame | None:
        """How far the trees count: up to the best round, where one was sought."""
        if self.best_iteration is None:
            return None
        return self.forest.bases.select("model", F.lit(self.best_iteration).alias("last"))

    def predict(self, rows: DataFrame, out: str = "correction_c") -> DataFrame:
        check_feature_names(rows, self.features, self.forbidden)
        unused = [F.lit(None).cast("double").alias(f) for f in self.forest.features if f not in rows.columns]
        filled = rows.select("*", *unused) if unused else rows
        return self.forest.predict(filled, out, F.lit(self.model), self.kept()).select(*rows.columns, out)

    def importances(self, spark: SparkSession) -> DataFrame:
        """Importances of the features in use, ranked; earlier features first on ties."""
        return importance_table(self.forest, self.features, self.model, self.kept())

    def save(self, path: str) -> None:
        forest, growth = self.forest, self.forest.growth
        spark = forest.trees.sparkSession
        mine = F.col("model") == self.model
        last = self.best_iteration if self.best_iteration is not None else growth.rounds
        forest.trees.where(mine & (F.col("round") <= last)).write.mode("overwrite").parquet(f"{path}/trees")
        forest.bases.where(mine).write.mode("overwrite").parquet(f"{path}/bases")
        record = {
            "version": ARTIFACT_VERSION,
            "contract": {"columns": self.features, "never": sorted(self.forbidden)},
            "learned": {"columns": forest.features, "edges": forest.edges, "growth": vars(growth), "model": self.model},
            "selection": {"importance": self.candidates, "most": self.max_features, "least": self.min_importance},
            "rounds": {"best": self.best_iteration, "patience": self.patience},
        }
        spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Boosted":
        record = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        if record.get("version") != ARTIFACT_VERSION:
            raise ValueError(f"{path} was not saved by this version.")
        contract, learned, selection, rounds = record["contract"], record["learned"], record["selection"], record["rounds"]
        trees, bases = spark.read.schema(TREES).parquet(f"{path}/trees"), spark.read.parquet(f"{path}/bases")
        losses = spark.createDataFrame([], "model int, round int, loss double")
        return cls(
            features=contract["columns"],
            forest=Forest(learned["columns"], learned["edges"], trees, bases, losses, Growth(**learned["growth"])),
            model=learned["model"],
            candidates=selection["importance"],
            best_iteration=rounds["best"],
            max_features=selection["most"],
            min_importance=selection["least"],
            patience=rounds["patience"],
            forbidden=frozenset(contract["never"]),
        )


def importance_table(forest: Forest, features: Sequence[str], model: int = 0, last: DataFrame | None = None) -> DataFrame:
    """(position, feature, importance) of one model, ranked; features without a split have none."""
    spark = forest.trees.sparkSession
    names = spark.createDataFrame([(i, n, forest.features.index(n)) for i, n in enumerate(features)], "position int, feature string, f int")
    shares = forest.importances(last).where(F.col("model") == model).select("f", "importance")
    table = names.join(shares, "f", "left").select("position", "feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    return table.orderBy(F.col("importance").desc(), "position")


def check_choice(max_features: int | None, min_importance: float) -> None:
    if max_features is not None and max_features < 1:
        raise ValueError(f"Cannot keep {max_features} features; give one or more, or None for all.")
    if min_importance < 0:
        raise ValueError(f"An importance is never below zero, but {min_importance} was asked for.")


def top_features(importances: DataFrame, max_features: int | None = None, min_importance: float = 0.0) -> DataFrame:
    """Features above the threshold, at most ``max_features``; the single best one if none is above."""
    check_choice(max_features, min_importance)
    ranked = importances.orderBy(F.col("importance").desc(), "position")
    above = ranked.filter(F.col("importance") > min_importance)
    kept = above if max_features is None else above.limit(max_features)
    return ranked.limit(1) if kept.isEmpty() else kept


def kept_columns(forest: Forest, models: Sequence[int], max_features: int | None, min_importance: float) -> dict[int, list[int]]:
    """The same choice for many models at once, by column number; its size is that of the models."""
    check_choice(max_features, min_importance)
    shares: dict[int, dict[int, float]] = {m: {} for m in models}
    for r in forest.importances().collect():
        shares[r["model"]][r["f"]] = r["importance"]
    out = {}
    for m in models:
        ranked = sorted(range(len(forest.features)), key=lambda f: (-shares[m].get(f, 0.0), f))
        out[m] = sorted([f for f in ranked if shares[m].get(f, 0.0) > min_importance][:max_features] or ranked[:1])
    return out


def named_rows(rows: DataFrame, features: Sequence[str], label: str, held: Column, row: Column | None) -> DataFrame:
    """What the learner reads of a matrix: one model, the row's number, whether it is held out, label and features."""
    number = row_number_of(rows) if row is None else row
    return rows.select(F.lit(0).alias("model"), number.cast("long").alias("row"), held.alias("held"), F.col(label).cast("double").alias("y"), *features)


def select_features(
    rows: DataFrame, features: Sequence[str], label: str = LABEL, max_features: int | None = MAX_FEATURES, min_importance: float = 0.0, params: Mapping[str, Any] | None = None, row: Column | None = None
) -> tuple[list[str], dict[str, float]]:
    """Rank candidates by a model fitted on training rows only; returns the kept names and every importance."""
    check_features(rows, features, label)
    growth = growth_of(params)
    read = named_rows(rows, features, label, F.lit(False), row)
    edges = fit_edges(read, features, growth.bins)
    forest = grow(binned(read, features, edges), features, edges, growth, {0: range(len(features))})
    table = importance_table(forest, features)
    kept = [r["feature"] for r in top_features(table, max_features, min_importance).collect()]
    return kept, {r["feature"]: r["importance"] for r in table.collect()}


def best_round(losses: Sequence[float], patience: int | None) -> int:
    """Zero-based round of the lowest loss, giving up ``patience`` rounds after the last improvement."""
    best, at = float("inf"), 0
    for i, loss in enumerate(losses):
        if loss < best:
            best, at = loss, i
        elif patience is not None and i - at >= patience:
            break
    return at


def fit_boosted(
    train: DataFrame,
    features: Sequence[str] = TREE_FEATURES,
    label: str = LABEL,
    validation: DataFrame | None = None,
    ts: str | None = VALID,
    max_features: int | None = MAX_FEATURES,
    min_importance: float = 0.0,
    params: Mapping[str, Any] | None = None,
    patience: int | None = PATIENCE,
    keys: Sequence[str] = (),
    row: Column | None = None,
) -> Boosted:
    """Select on the training rows, fit, and stop early on a held-out block when one is given.

    ``ts`` names the time by which that block must be unique and strictly
    later in each series of ``keys``; without it the caller vouches for the order.
    """
    kept, candidates = select_features(train, features, label, max_features, min_importance, params, row)
    growth = growth_of(params)
    read = named_rows(train, kept, label, F.lit(False), row)
    edges = fit_edges(read, kept, growth.bins)
    if validation is not None:
        check_features(validation, kept, label)
        check_order([c for c in validation.columns if c in kept], [c for c in train.columns if c in kept])
        if ts is not None:
            check_holdout(train, validation, ts, keys)
        read = read.unionByName(named_rows(validation, kept, label, F.lit(True), row))
    stop = patience if validation is not None else None
    forest = grow(binned(read, kept, edges), kept, edges, growth, {0: range(len(kept))}, stop)
    best = best_rounds(forest.losses, patience)[0] if stop is not None else None
    return Boosted(kept, forest, 0, candidates, best, max_features, min_importance, patience)


def holdout_metrics(rows: DataFrame, predicted: str, actual: str = OBSERVED) -> dict[str, float]:
    e = F.col(predicted) - F.col(actual)
    r = rows.agg(F.avg(F.abs(e)).alias("mae_c"), F.sqrt(F.avg(e * e)).alias("rmse_c"), F.avg(e).alias("bias_c")).first()
    return r.asDict()


def before_block(train: DataFrame, validation: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The training rows that lie before the first held-out hour of their series."""
    if not keys:
        return train.filter(F.col(VALID) < F.lit(validation.agg(F.min(VALID)).first()[0]))
    first = validation.groupBy(*keys).agg(F.min(VALID).alias("_first"))
    return train.join(first, list(keys), "left").filter(F.col("_first").isNull() | (F.col(VALID) < F.col("_first"))).drop("_first")


@dataclass
class Recipes:
    """Trial 2k and repeat 2k + 1 of every recipe k, grown together."""

    forest: Forest
    shares: DataFrame
    columns: dict[int, list[int]]
    best: dict[int, int]

    def kept(self) -> DataFrame | None:
        """(model, last) of trials and repeats alike: a repeat stops where its trial was best."""
        rows = [(m, best) for trial, best in self.best.items() for m in (trial, trial + 1)]
        return self.forest.trees.sparkSession.createDataFrame(rows, "model int, last int") if rows else None


def grow_recipes(read: DataFrame, models: Sequence[int], growth: Growth, max_features: int | None, patience: int | None, edges: Sequence[Sequence[float]] | None = None) -> Recipes:
    """Ranks the features of every model, then grows all of them on those they keep: in tasks, unless one has too many rows for it.

    ``read`` holds model, row, held, y and the tree features. Cuts are fitted on
    the learning rows unless given: a backtest gives those of its first cutoff,
    so that no fold's cuts know later forecasts.
    """
    if edges is None:
        edges = fit_edges(read.where(~F.col("held")), TREE_FEATURES, growth.bins)
    staged = cut_lineage(binned(read, TREE_FEATURES, edges).select("model", "row", "held", "y", "bins"))
    every = range(len(TREE_FEATURES))
    largest = staged.groupBy("model").count().agg(F.max("count")).first()[0]
    if largest is not None and largest <= WHOLE:
        first = grow_in_tasks(staged.where(~F.col("held")), TREE_FEATURES, edges, growth, {m: every for m in models})
        columns = kept_columns(first, models, max_features, 0.0)
        trial = grow_in_tasks(staged, TREE_FEATURES, edges, growth, {m: c for m, c in columns.items() if m % 2 == 0}, patience)
        best = {} if patience is None else best_rounds(trial.losses, patience)
        repeat = grow_in_tasks(staged, TREE_FEATURES, edges, growth, {m: c for m, c in columns.items() if m % 2}, None, {m + 1: last + 1 for m, last in best.items()})
        both = [getattr(trial, x).unionByName(getattr(repeat, x)) for x in ("trees", "bases", "losses")]
        return Recipes(Forest(trial.features, trial.edges, *both, growth), first.importances(), columns, best)
    columns = kept_columns(first, models, max_features, 0.0)
    forest = grow(staged, TREE_FEATURES, edges, growth, columns, patience)
    return Recipes(forest, first.importances(), columns, {} if patience is None else best_rounds(forest.losses, patience))


def residual_recipe(
    matrix: DataFrame,
    params: Mapping[str, Any] | None = None,
    max_features: int = MAX_FEATURES,
    patience: int | None = PATIENCE,
    keys: Sequence[str] = (STATION,),
    overlap: str = "raise",
    row: Column | None = None,
) -> tuple[Boosted, dict[str, Any]]:
    """Hold out each series' latest run, select and stop early on it, and fit the same on every row.

    An older run that reaches into the held-out hours is an error; with
    ``overlap="trial"`` its rows there miss the trial fit only, and the report counts them.

    The matrix is written to the shared folder once: both fits read that table
    instead of repeating the joins.
    """
    if overlap not in ("raise", "trial"):
        raise ValueError("overlap is 'raise' or 'trial'.")
    staged = cut_lineage(matrix)
    marked = latest_run_block(staged, keys)
    train, validation = marked.filter(~F.col("is_validation")), marked.filter("is_validation")
    if train.isEmpty() or validation.isEmpty():
        raise ValueError("At least two historical runs are required.")
    left_out = 0
    if overlap == "trial":
        earlier = before_block(train, validation, keys)
        if earlier.isEmpty():
            raise ValueError("No training row lies before the held-out hours.")
        left_out = train.count() - earlier.count()
        train = earlier
    check_features(staged, TREE_FEATURES, LABEL)
    check_holdout(train, validation, VALID, keys)
    number = F.lit(0)
    trial = named_rows(train, TREE_FEATURES, LABEL, F.lit(False), row).unionByName(named_rows(validation, TREE_FEATURES, LABEL, F.lit(True), row))
    repeat = named_rows(staged, TREE_FEATURES, LABEL, F.lit(False), row)
    read = trial.withColumn("model", number).unionByName(repeat.withColumn("model", number + 1))
    growth = growth_of(params)
    # Each model's cuts come from the rows it learns from; the trial's know nothing of the held-out run.
    edges = fit_edges(read.where("model = 0 AND NOT held"), TREE_FEATURES, growth.bins)
    recipes = grow_recipes(read, [0, 1], growth, max_features, patience, edges)
    best = recipes.best.get(0)

    def fitted(model: int) -> Boosted:
        names = [TREE_FEATURES[f] for f in recipes.columns[model]]
        shares = {TREE_FEATURES[r["f"]]: r["importance"] for r in recipes.shares.where(F.col("model") == model).collect()}
        return Boosted(names, recipes.forest, model, {n: shares.get(n, 0.0) for n in TREE_FEATURES}, best, max_features, 0.0, patience)

    tried, final = fitted(0), fitted(1)
    corrected = cut_lineage(tried.predict(validation).withColumn("corrected_c", F.col(RAW) + F.col("correction_c")))
    counts = marked.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(INIT).alias("runs"),
        F.max(INIT).alias("run"),
        F.count_if("is_validation").alias("held"),
    ).first()
    report = {
        "training_rows": counts["rows"],
        "historical_runs": counts["runs"],
        "validation_run": str(counts["run"]),
        "validation_rows": counts["held"],
        "trial_rows_left_out": left_out,
        "target_definition": f"{OBSERVED} - {RAW}",
        "boosted_validation": holdout_metrics(corrected, "corrected_c"),
        "raw_validation": holdout_metrics(corrected, RAW),
        "best_iteration": best,
        "selected_features": final.features,
    }
    return final, report


def corrected_forecast(fitted: Boosted, panel: DataFrame, cutoff, hours: int = HORIZON_HOURS, keys: Sequence[str] = (STATION,), tiebreak: Sequence[str] = ()) -> DataFrame:
    """Raw forecast plus the learned correction over one window."""
    rows = fitted.predict(forecast_matrix(panel, cutoff, hours, keys, tiebreak))
    return rows.withColumn("predicted_temperature_c", F.col(RAW) + F.col("correction_c")).withColumnRenamed(VALID, DS)


def fold_models(matrix: DataFrame, cutoffs: Sequence[Any], keys: Sequence[str], overlap: str, row: Column | None) -> DataFrame:
    """Every cutoff's trial rows (model 2k) and repeat rows (model 2k + 1), cutoffs in order.

    ``matrix`` holds the freshest run of each hour. No lead is negative, so an
    hour before a cutoff was forecast before it, and that run is the freshest
    at every later cutoff too.
    """
    number = row_number_of(matrix) if row is None else row
    passed = F.size(F.filter(F.array(*[F.lit(c) for c in cutoffs]), lambda c: c <= F.col(VALID)))
    numbered = matrix.select(*keys, INIT, VALID, number.cast("long").alias("row"), F.col(LABEL).cast("double").alias("y"), *TREE_FEATURES, passed.alias("_from"))
    # Rows are spread before they are repeated for the cutoffs behind them.
    later = spread(numbered.where(F.col("y").isNotNull() & (F.col("_from") < len(cutoffs)))).withColumn("_k", F.explode(F.sequence(F.col("_from"), F.lit(len(cutoffs) - 1)))).drop("_from")
    first = F.max(F.struct(INIT, (-F.unix_micros(VALID)).alias("_less")))
    latest = later.groupBy("_k", *keys).agg(first.alias("_run"))
    marked = later.join(latest, ["_k", *keys]).withColumn("held", F.col(INIT) == F.col(f"_run.{INIT}"))
    reaches = ~F.col("held") & (F.unix_micros(VALID) >= -F.col("_run._less"))
    if overlap == "raise":
        if not marked.where(reaches).isEmpty():
            raise ValueError("Validation rows must come after all training rows.")
        trials = marked
    elif overlap == "trial":
        trials = marked.where(~reaches)
    else:
        raise ValueError("overlap is 'raise' or 'trial'.")
    repeats = later.withColumn("held", F.lit(False)).withColumn("model", (2 * F.col("_k") + 1).cast("int"))
    names = ["model", "row", "held", "y", *TREE_FEATURES]
    return trials.withColumn("model", (2 * F.col("_k")).cast("int")).select(*names).unionByName(repeats.select(*names))


def boosted_backtest(
    history: DataFrame,
    panel: DataFrame,
    folds: DataFrame,
    hours: int = HORIZON_HOURS,
    keys: Sequence[str] = (STATION,),
    params: Mapping[str, Any] | None = None,
    max_features: int = MAX_FEATURES,
    patience: int | None = PATIENCE,
    step_hours: int = 1,
    tiebreak: Sequence[str] = (),
    name: str = "xgboost",
    overlap: str = "raise",
    row: Column | None = None,
    parallelism: int | None = None,
) -> DataFrame:
    """One recipe per cutoff over all series, all of them grown in the same passes.

    Training rows are the freshest legitimate run per hour (whole rows). Only
    the cutoffs and the trees of a few rounds are on the driver. Every fold and hour asked
    for comes back; ``yhat`` is null where no run covers the hour, or where a
    cutoff lacks a held-out run and rows before it. ``parallelism`` is of no
    effect and kept for callers that set it.
    """
    cutoffs = [r[CUTOFF] for r in folds.select(CUTOFF).distinct().orderBy(CUTOFF).collect()]
    if not cutoffs:
        raise ValueError("There are no folds to score.")
    growth = growth_of(params)
    matrix = cut_lineage(freshest_rows(training_matrix(panel, history, None, keys, DS, "y", tiebreak), (*keys, VALID), tiebreak))
    read = cut_lineage(fold_models(matrix, cutoffs, keys, overlap, row))
    tally = read.groupBy("model").agg(F.count_if("held").alias("held"), F.count_if(~F.col("held")).alias("learned")).collect()
    usable = [r["model"] for r in tally if r["model"] % 2 == 0 and r["held"] and r["learned"]]
    wanted = future_frame(folds.select(*keys, FOLDS, CUTOFF), hours, step_hours)
    if not usable:
        return shape(wanted, name, F.lit(None).cast("double"), keys)
    models = sorted([*usable, *[m + 1 for m in usable]])
    # Cuts that the first of the folds could have made: later forecasts are not looked at.
    edges = fit_edges(read.where((F.col("model") == min(usable)) & ~F.col("held")), TREE_FEATURES, growth.bins)
    recipes = grow_recipes(read.where(F.col("model").isin(models)), models, growth, max_features, patience, edges)
    spark = folds.sparkSession
    numbers = spark.createDataFrame([(cutoffs[m // 2], m + 1) for m in usable], f"{CUTOFF} {folds.schema[CUTOFF].dataType.simpleString()}, _m int")
    ahead = forecast_window(panel, folds, hours, keys, tiebreak)
    ahead = ahead.select(*keys, FOLDS, CUTOFF, F.col(VALID).alias(DS), *[c.alias(n) for n, c in tree_features(ahead).items()])
    scored = recipes.forest.predict(ahead.join(numbers, CUTOFF), "correction_c", F.col("_m"), recipes.kept())
    corrected = scored.select(*keys, FOLDS, CUTOFF, DS, (F.col(RAW) + F.col("correction_c")).alias("_yhat"))
    return shape(wanted.join(corrected, [*keys, FOLDS, CUTOFF, DS], "left"), name, F.col("_yhat"), keys)
