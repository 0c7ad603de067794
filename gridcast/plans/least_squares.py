"""Least squares for every series and fold from additive cross products.

Cross products of ``[1, features, label]`` add up, so they are aggregated per
segment once. A running total over a series' segments, kept per product and so
spread over the cluster, gives every cutoff's products; each fold's row is
then solved by itself, in SQL functions over one array. The history is read once,
whatever the fold count, and no group of rows is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridcast.functions.vocabulary import CUTOFF, FOLDS
from gridcast.operators.folds import ORDINAL, SEGMENT, number_folds
from gridcast.session import spread

# Beyond this many features the sum expressions outgrow compiled code.
WIDE = 24
# A column that the ones before it explain but for this share of its spread gets no coefficient.
EXPLAINED = 1e-10


def _upper(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def cross_products(rows: DataFrame, by: Sequence[str], features: Mapping[str, Column], label: Column) -> DataFrame:
    """Per ``by``: upper triangle of the cross products of ``[1, features, label]``, as one array."""
    names = [f"_z{i}" for i in range(len(features) + 2)]
    values = [F.lit(1.0), *features.values(), label.cast("double")]
    staged = rows.select(*by, *[v.cast("double").alias(n) for n, v in zip(names, values)])
    if len(features) <= WIDE:
        sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{p}") for p, (i, j) in enumerate(_upper(len(names)))]
        summed = staged.groupBy(*by).agg(*sums)
        return summed.select(*by, F.array(*[F.col(f"s{p}") for p in range(len(sums))]).alias("products"))
    return _wide_products(staged, by, names)


def _wide_products(staged: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The same by Arrow batches: each batch reduces to one row per group before any shuffle."""
    at = np.array(_upper(len(names)))
    types = {f.name: f.dataType.simpleString() for f in staged.schema.fields}
    keys = list(by)

    def reduce_batches(batches):
        for pdf in batches:
            z = pdf[list(names)].to_numpy(dtype="float64")
            parts = []
            for key, index in pdf.groupby(keys, sort=False, dropna=False).indices.items():
                block = z[index]
                total = (block.T @ block)[at[:, 0], at[:, 1]]
                parts.append((*(key if isinstance(key, tuple) else (key,)), total))
            yield pd.DataFrame(parts, columns=[*keys, "products"])

    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["products array<double>"])
    partial = staged.mapInPandas(reduce_batches, schema)
    cells = partial.select(*keys, F.posexplode("products").alias("_p", "_v")).groupBy(*keys, "_p").agg(F.sum("_v").alias("_v"))
    packed = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_p", "_v"))).alias("_c"))
    return packed.select(*keys, F.transform("_c", lambda c: c["_v"]).alias("products"))


def solve(products: np.ndarray, size: int, penalty: np.ndarray | None = None) -> tuple[float, float, np.ndarray, float]:
    """Rows, intercept, coefficients and residual sum of squares from one upper triangle."""
    full = np.zeros((size, size))
    at = np.array(_upper(size))
    full[at[:, 0], at[:, 1]] = products
    full[at[:, 1], at[:, 0]] = products
    n = full[0, 0]
    mean = full[0, 1:] / n
    centred = full[1:, 1:] - n * np.outer(mean, mean)
    sxx, sxy, syy = centred[:-1, :-1], centred[:-1, -1], centred[-1, -1]
    scale = np.sqrt(np.clip(np.diag(sxx), 0.0, None))
    live = scale > 1e-9 * np.sqrt(np.maximum(np.diag(full)[1:-1], 1e-300))
    beta = np.zeros(size - 2)
    if live.any():
        d = scale[live]
        system = sxx[np.ix_(live, live)] / np.outer(d, d)
        if penalty is not None:
            system = system + np.diag(penalty[live] / (d * d))
        beta[live] = np.linalg.lstsq(system, sxy[live] / d, rcond=1e-12)[0] / d
    rss = syy - 2 * beta @ sxy + beta @ sxx @ beta
    return n, float(mean[-1] - mean[:-1] @ beta), beta, float(max(rss, 0.0))


#: From the residual variance without a penalty and the label's root mean square to one weight a feature.
Penalty = Callable[[Column, Column], Column]


def fold_products(products: DataFrame, slots: DataFrame, keys: Sequence[str], width: int, carried: Sequence[str]) -> DataFrame:
    """Every fold's products: running totals over segments, one window partition a series and product."""
    named = [*keys, FOLDS, SEGMENT]
    cells = products.select(*named, F.lit(False).alias("_slot"), F.posexplode("products").alias("_p", "_v"))
    asked = spread(slots).select(*named, F.lit(True).alias("_slot"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_p"), F.lit(0.0).alias("_v"), *carried)
    upto = Window.partitionBy(*keys, FOLDS, "_p").orderBy(SEGMENT, "_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = cells.unionByName(asked, allowMissingColumns=True).withColumn("_t", F.sum("_v").over(upto)).where("_slot")
    # One fold's row holds as many numbers as the regression has products.
    packed = totals.groupBy(*keys, FOLDS, *carried).agg(F.array_sort(F.collect_list(F.struct("_p", "_t"))).alias("_c"))
    # A few small rows would all land in one task, which then solves all folds.
    return spread(packed, *keys, FOLDS, *carried).withColumn("_tri", F.transform("_c", lambda c: c["_t"])).drop("_c")


def eliminated(matrix: str, size: int) -> str:
    """Gauss-Jordan elimination of all but the last column of a symmetric matrix, row by row in one array.

    The last column then holds the coefficients and its corner the residual
    sum of squares. A pivot that earlier ones explain is crossed out.
    """
    rows = let("m", matrix, f"transform(sequence(0, {size - 1}), i -> slice(m, i * {size} + 1, {size}))")
    pivot = "get(get(a, p), p)"
    crossed = "transform(a, (r, i) -> CASE WHEN i = p THEN transform(r, x -> 0D) ELSE transform(r, (x, j) -> CASE WHEN j = p THEN 0D ELSE x END) END)"
    # The factor of a row is bound once, by a list of one.
    cleared = f"get(transform(array(get(r, p) / {pivot}), f -> zip_with(r, get(a, p), (x, y) -> x - f * y)), 0)"
    step = f"transform(a, (r, i) -> CASE WHEN i = p THEN transform(r, x -> x / get(r, p)) ELSE {cleared} END)"
    return f"flatten(aggregate(sequence(0, {size - 2}), {rows}, (a, p) -> CASE WHEN {pivot} <= {EXPLAINED!r}D THEN {crossed} ELSE {step} END))"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once: inside a lambda a merged projection would repeat it for every item."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def with_solution(rows: DataFrame, size: int, penalty: Penalty | None = None) -> DataFrame:
    """Adds n_rows, intercept, coefficients and rss from ``_tri``, the upper triangle of the products.

    Columns are centred and scaled by their spread first; one without any has no coefficient.
    """
    m, k = size - 1, size - 2
    i, j = f"cast(c div {m} as int)", f"(c % {m})"

    def at(r: str, q: str) -> str:
        low, high = f"least({r}, {q})", f"greatest({r}, {q})"
        return f"get(tri, cast({low} * {size} - {low} * ({low} - 1) / 2 + {high} - {low} as int))"

    cells = f"sequence(0, {m * m - 1})"
    out = rows.withColumn("_n", F.expr("get(_tri, 0)"))
    out = out.withColumn("_centred", F.expr(let("tri", "_tri", f"transform({cells}, c -> {at(f'({i} + 1)', f'({j} + 1)')} - {at('0', f'({i} + 1)')} * {at('0', f'({j} + 1)')} / nullif(get(tri, 0), 0D))")))
    scale = f"sqrt(greatest(get(centred, i * {m + 1}), 0D))"
    alive = f"{scale} > 1e-9D * sqrt(greatest({at('(i + 1)', '(i + 1)')}, 1e-300D))"
    scales = f"transform(sequence(0, {m - 1}), i -> CASE WHEN i = {k} THEN CASE WHEN {scale} > 0 THEN {scale} ELSE 1D END WHEN {alive} THEN {scale} ELSE 0D END)"
    out = out.withColumn("_scale", F.expr(let("tri", "_tri", let("centred", "_centred", scales))))
    unit = f"CASE WHEN get(d, {i}) = 0 OR get(d, {j}) = 0 THEN 0D ELSE get(centred, c) / (get(d, {i}) * get(d, {j})) END"
    out = out.withColumn("_unit", F.expr(let("centred", "_centred", let("d", "_scale", f"transform({cells}, c -> {unit})"))))
    plain = out.withColumn("_done", F.expr(eliminated("_unit", m)))
    corner = f"greatest(get(_done, {m * m - 1}), 0D) * get(_scale, {k}) * get(_scale, {k})"
    lost = "0D"
    if penalty is not None:
        sigma2 = F.greatest(F.expr(corner) / F.greatest("_n", F.lit(1.0)), F.lit(1e-12))
        height = F.greatest(F.sqrt(F.expr(f"get(_tri, {size * (size + 1) // 2 - 1}) / nullif(_n, 0D)")), F.lit(1e-9))
        weighed = plain.withColumn("_weights", penalty(sigma2, height))
        extra = f"CASE WHEN {i} = {j} AND {i} < {k} AND get(d, {i}) > 0 THEN get(w, {i}) / (get(d, {i}) * get(d, {i})) ELSE 0D END"
        stiffened = let("d", "_scale", let("w", "_weights", let("unit", "_unit", f"transform({cells}, c -> get(unit, c) + {extra})")))
        plain = weighed.withColumn("_stiff", F.expr(stiffened)).withColumn("_done", F.expr(eliminated("_stiff", m)))
        # The corner counts the penalty as a residual.
        lost = "aggregate(zip_with(coefficients, _weights, (b, w) -> b * b * w), 0D, (t, v) -> t + v)"
    beta = f"transform(sequence(0, {k - 1}), i -> CASE WHEN get(d, i) = 0 THEN 0D ELSE get(done, i * {m} + {m - 1}) * get(d, {k}) / get(d, i) END)"
    fitted = plain.withColumn("coefficients", F.expr(let("d", "_scale", let("done", "_done", beta)) if k else "cast(array() as array<double>)"))
    explained = let("tri", "_tri", f"aggregate(transform(coefficients, (b, i) -> b * {at('0', '(i + 1)')} / nullif(get(tri, 0), 0D)), 0D, (t, v) -> t + v)")
    return fitted.withColumns(
        {
            "n_rows": F.col("_n").cast("long"),
            "intercept": F.expr(f"get(_tri, {m}) / nullif(_n, 0D) - {explained}"),
            "rss": F.expr(f"greatest({corner} - {lost}, 0D)"),
        }
    )


def solve_folds(
    products: DataFrame,
    folds: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    minimum: int = 2,
    on_short: str = "error",
    penalty: Penalty | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """One fitted row per fold: rows used, intercept, coefficients, residual sum of squares.

    A fold with fewer than ``minimum`` rows is an error, or with ``on_short``
    'drop' left out, or with 'null' kept with its count and no fit.
    """
    if on_short not in ("error", "drop", "null"):
        raise ValueError("on_short is one of 'error', 'drop' and 'null'.")
    size = len(features) + 2
    slots = number_folds(folds, keys).select(*keys, FOLDS, CUTOFF, (F.col(ORDINAL) - 1).alias(SEGMENT))
    if extra:
        slots = slots.join(folds.select(*keys, FOLDS, CUTOFF, *extra), [*keys, FOLDS, CUTOFF])
    totals = fold_products(products, slots, keys, size * (size + 1) // 2, [CUTOFF, *extra])
    found = F.expr("cast(get(_tri, 0) as long)")
    short = found < minimum
    if on_short == "error":
        said = F.concat(F.lit("Only "), found, F.lit(" training pair(s) before "), CUTOFF, F.lit(f"; at least {minimum} are needed."))
        totals = totals.where(F.when(short, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))
    elif on_short == "drop":
        totals = totals.where(~short)
    fits = with_solution(totals, size, penalty)
    fitted = [F.when(~short, F.col(c)).alias(c) for c in ("intercept", "coefficients", "rss")]
    return fits.select(*keys, FOLDS, CUTOFF, "n_rows", *fitted)


def predict(rows: DataFrame, fits: DataFrame, keys: Sequence[str], features: Mapping[str, Column], out: str = "yhat") -> DataFrame:
    """Dot product of each row's features with its fold's coefficients."""
    # Generated rows look as small as the folds they came from; the hint keeps Spark from broadcasting them.
    joined = rows.join(fits.hint("shuffle_hash"), [*keys, FOLDS, CUTOFF])
    total = F.col("intercept")
    for i, value in enumerate(features.values()):
        total = total + F.get("coefficients", F.lit(i)) * value
    return joined.withColumn(out, total)


def residual_sd(degrees: int) -> Column:
    """Residual standard deviation with ``degrees`` fitted parameters taken off."""
    return F.when(F.col("n_rows") > degrees, F.sqrt(F.col("rss") / (F.col("n_rows") - degrees)))


def coefficient_table(fits: DataFrame, keys: Sequence[str], features: Sequence[str], model: str) -> DataFrame:
    """One row per fitted term."""
    names = F.array(*[F.lit(n) for n in features])
    zipped = F.arrays_zip(names.alias("feature"), F.col("coefficients").alias("coefficient"))
    return fits.select(*keys, FOLDS, CUTOFF, F.explode(zipped).alias("t")).select(
        *keys, FOLDS, CUTOFF, "t.feature", "t.coefficient", F.lit(model).alias("model")
    )
