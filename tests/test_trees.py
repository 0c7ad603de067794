"""The histogram tree learner against a plain greedy learner over all cuts."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.plans import trees as T

NAMES = ["a", "b", "c"]
SCHEMA = "model int, row long, held boolean, y double, a double, b double, c double"


def greedy(x, y, growth, allowed, edges):
    """One booster by the definition: every cut of every open feature, nulls tried on both sides."""
    def gradient_of(p):
        return np.floor((p - y) * T.UNIT + 0.5).astype(np.int64)

    pred = np.full(len(y), int(np.floor(y * T.UNIT + 0.5).sum()) / len(y) / T.UNIT)
    total, count = {}, {}
    for round_ in range(growth.rounds):
        opened = T.open_columns(allowed, round_, growth)
        used = np.array([growth.rows >= 1.0 or T.draw(round_, i, growth.seed) < int(growth.rows * T.SHARES) for i in range(len(y))])
        gradient, leaf = gradient_of(pred), np.zeros(len(y))

        def descend(rows, depth):
            g, n = int(gradient[rows & used].sum()), int((rows & used).sum())
            leaf[rows] = -(g / T.UNIT) / (n + growth.l2) * growth.rate
            best = None
            for f in opened if depth else []:
                null = np.isnan(x[:, f])
                for b, cut in enumerate([*edges[f], math.inf], 1):
                    for right in (True, False):
                        low = (x[:, f] <= cut) | (null if not right else False)
                        gl, nl = int(gradient[rows & used & low].sum()), int((rows & used & low).sum())
                        gr, nr = g - gl, n - nl
                        if nl < growth.least or nr < growth.least:
                            continue
                        gain = gl * gl / (nl + growth.l2) + gr * gr / (nr + growth.l2) - g * g / (n + growth.l2)
                        if best is None or (gain, -f, -b, right) > best[:4]:
                            best = (gain, -f, -b, right, low)
            if best and best[0] > T.LEAST_GAIN * T.UNIT * T.UNIT:
                total[-best[1]] = total.get(-best[1], 0.0) + best[0]
                count[-best[1]] = count.get(-best[1], 0) + 1
                descend(rows & best[4], depth - 1)
                descend(rows & ~best[4], depth - 1)

        descend(np.ones(len(y), dtype=bool), growth.depth)
        pred = pred + leaf
    average = {f: total[f] / count[f] for f in total}
    return pred, {f: v / sum(average.values()) for f, v in average.items()}


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(4)
    x = np.round(draw.normal(size=(300, 3)), 1)
    x[draw.random(300) < 0.3, 0] = np.nan
    x[:, 2] = draw.integers(0, 2, 300)
    y = np.where(np.isnan(x[:, 0]), 2.0, np.nan_to_num(x[:, 0])) + 0.5 * x[:, 1] * x[:, 2] + 0.1 * draw.normal(size=300)
    return x, y


def frame_of(spark, x, y, models=(0,), held=lambda m, i: False):
    rows = [(m, i, held(m, i), float(y[i]), *[float(v) for v in x[i]]) for m in models for i in range(len(y))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("growth", [T.Growth(rounds=5, depth=3, bins=8, rate=0.3, chunk=2), T.Growth(rounds=3, depth=2, bins=64, rows=1.0, columns=1.0, least=1, l2=0.0)])
def test_trees_equal_greedy_search(spark, data, growth):
    x, y = data
    rows = frame_of(spark, x, y)
    edges = T.fit_edges(rows, NAMES, growth.bins)
    forest = T.grow(T.binned(rows, NAMES, edges), NAMES, edges, growth, {0: [0, 1, 2]})
    expected, gains = greedy(x, y, growth, [0, 1, 2], edges)
    got = {r["row"]: r["p"] for r in forest.predict(rows, "p").collect()}
    np.testing.assert_allclose([got[i] for i in range(len(y))], expected, rtol=0, atol=1e-12)
    shares = {r["f"]: r["importance"] for r in forest.importances().collect()}
    assert shares.keys() == gains.keys() and all(shares[f] == pytest.approx(gains[f]) for f in gains)


def test_models_grow_apart_and_held_rows_are_only_scored(spark, data):
    x, y = data
    growth = T.Growth(rounds=6, depth=2, bins=16, rate=0.5, chunk=4, columns=1.0)
    both = frame_of(spark, x, y, (0, 1), lambda m, i: m == 1 and i >= 200)
    edges = T.fit_edges(both.where("model = 0"), NAMES, growth.bins)
    forest = T.grow(T.binned(both, NAMES, edges), NAMES, edges, growth, {0: [0, 1, 2], 1: [1]})
    alone, _ = greedy(x, y, growth, [0, 1, 2], edges)
    part, used = greedy(x[:200], y[:200], growth, [1], edges)
    got = {(r["model"], r["row"]): r["p"] for r in forest.predict(both, "p", F.col("model")).collect()}
    np.testing.assert_allclose([got[0, i] for i in range(300)], alone, atol=1e-12)
    np.testing.assert_allclose([got[1, i] for i in range(200)], part, atol=1e-12)
    assert set(used) == {1}
    losses = {(r["model"], r["round"]): r["loss"] for r in forest.losses.collect()}
    assert set(losses) == {(1, i) for i in range(6)}
    assert losses[1, 5] == pytest.approx(np.mean([abs(got[1, i] - y[i]) for i in range(200, 300)]), abs=1e-5)
    last = spark.createDataFrame([(0, 1), (1, 5)], "model int, last int")
    short, _ = greedy(x, y, T.Growth(**{**vars(growth), "rounds": 2}), [0, 1, 2], edges)
    cut = {(r["model"], r["row"]): r["p"] for r in forest.predict(both, "p", F.col("model"), last).collect()}
    np.testing.assert_allclose([cut[0, i] for i in range(300)], short, atol=1e-12)


def test_growth_ends_after_patience(spark, data):
    x, y = data
    rows = frame_of(spark, x, np.where(np.arange(300) < 200, y, -y), (0,), lambda m, i: i >= 200)
    growth = T.Growth(rounds=40, depth=2, bins=8, rate=0.5, chunk=3)
    edges = T.fit_edges(rows, NAMES, growth.bins)
    forest = T.grow(T.binned(rows, NAMES, edges), NAMES, edges, growth, {0: [0, 1, 2]}, patience=2)
    tried = forest.losses.count()
    assert tried < 40 and T.best_rounds(forest.losses, 2)[0] <= tried - 3


def test_constant_and_null_features(spark):
    rows = spark.createDataFrame([(0, i, False, float(i % 3), None, 1.0, float("nan")) for i in range(30)], SCHEMA)
    growth = T.Growth(rounds=2, depth=2, bins=4, rows=1.0)
    edges = T.fit_edges(rows, NAMES, growth.bins)
    assert edges == [[], [1.0], []]
    forest = T.grow(T.binned(rows, NAMES, edges), NAMES, edges, growth, {0: [0, 1, 2]})
    assert forest.importances().count() == 0
    assert {round(r["p"], 3) for r in forest.predict(rows, "p").collect()} == {1.0}


def test_sketched_edges_are_exact_quantiles(spark):
    draw = np.random.default_rng(0)
    values = draw.normal(size=5000)
    rows = spark.createDataFrame([(float(v),) for v in values], "a double").repartition(7)
    [edges] = T.fit_edges(rows, ["a"], 64)
    assert edges == sorted(np.sort(np.rint(values * 1e9) / 1e9)[[math.ceil(i * 5000 / 64) - 1 for i in range(1, 64)]].tolist())
    assert T.Growth.of({"maxIter": 3, "subsamplingRate": 1.0}).rounds == 3
    with pytest.raises(ValueError, match="Unknown"):
        T.Growth.of({"nope": 1})


def test_trees_grown_in_tasks_are_those_grown_in_passes(spark):
    rng = random.Random(21)
    rows = [(m, i, m == 2 and i % 5 == 0, rng.gauss(0, 3), *[None if rng.random() < 0.1 else rng.randrange(9) / 4 + (i % 7) * f for f in range(3)]) for m in (0, 2, 3) for i in range(300)]
    table = spark.createDataFrame(rows, "model int, row long, held boolean, y double, a double, b double, c double")
    growth = T.Growth(rounds=7, rate=0.3, depth=3, bins=16, chunk=3)
    edges = T.fit_edges(table, ["a", "b", "c"], growth.bins)
    binned = T.binned(table, ["a", "b", "c"], edges)
    allowed = {0: [0, 1, 2], 2: [0, 2], 3: [1]}
    passes, tasks = (f(binned, ["a", "b", "c"], edges, growth, allowed, 50) for f in (T.grow, T.grow_in_tasks))
    for x in ("trees", "bases", "losses"):
        assert sorted(getattr(tasks, x).collect()) == sorted(getattr(passes, x).collect())
    ended = T.grow_in_tasks(binned, ["a", "b", "c"], edges, growth, allowed, 50, {3: 2})
    assert {r["model"]: r["count"] for r in ended.trees.groupBy("model").count().collect()} == {0: 7, 2: 7, 3: 2}


def test_backtest_query_has_the_published_rounds_and_patience():
    from gridcast.plans import boosted
    from queries import models, tree_sql

    assert boosted.growth_of(models.BACKTEST) == T.Growth() and T.Growth().rounds == 500
    assert f"step < {500 * 4})" in models.gbt_backtest_sql() and f"r - lowest >= {boosted.PATIENCE}" in models.gbt_backtest_sql()
    rng = random.Random(22)
    rows = [(m, r, rng.randrange(20) / 4) for m in range(0, 40, 2) for r in range(rng.randrange(1, 30))]
    for patience in (None, 2, 5):
        parts = [f"losses(model, r, loss) AS (VALUES {', '.join(map(str, rows))})", *tree_sql.best_sql("losses", patience)]
        got = dict(duckdb.sql("WITH " + ", ".join(parts) + " SELECT model, r FROM best").fetchall())
        assert got == {m + 1: boosted.best_round([x[2] for x in rows if x[0] == m], patience) for m in range(0, 40, 2)}
