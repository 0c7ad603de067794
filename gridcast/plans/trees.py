"""Boosted trees of many models at once, grown from histograms.

A model is one booster: a fold, a series, a trial and its refit. All models of a
call grow level by level together, so a level is one aggregate over the rows of
all of them, keyed by (model, node, feature, bin), however many models there are.
Map tasks add up first; what is shuffled is histograms, and split choice is a
prefix sum over the bins of a node. The driver holds the trees since the rows
were last written, whose size is that of the models, and no rows.

Rows are cut into bins once. A null (or NaN) has a bin of its own, and every
split learns the side it goes to. Gradients are whole multiples of 2**-20, so their
sums are exact in any order and a retried task or another engine chooses the same
splits. Rows and columns are drawn per round by a counter hash.

``grow_in_tasks`` grows the same trees of many models of bounded size, each one in a task, so
that hundreds of rounds cost one pass and not one a level.

Squared error with an L2 penalty on leaves. For a split into sums of gradients
GL, GR over NL, NR rows the gain is GL^2/(NL+l2) + GR^2/(NR+l2) - (GL+GR)^2/(NL+NR+l2);
a leaf is -G/(N+l2) times the learning rate. Ties go to the earlier feature, the
lower cut, and nulls to the right.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcast.operators.compare import _MASK, _STEPS
from gridcast.session import cut_lineage

UNIT = 1 << 20
LEAST_GAIN = 1e-6
SHARES = 1_000_000
#: Rows of a draw table: columns are drawn with numbers behind all rounds.
COLUMN_DRAWS = 1 << 20
MOST_LEVELS = 16
#: Rows of a model (some 600 bytes each while it grows) up to which it is grown in one task.
WHOLE = 1 << 17
ARROW_TREE = pa.struct([("feature", pa.list_(pa.int32())), ("bin", pa.list_(pa.int32())), ("left", pa.list_(pa.bool_())), ("value", pa.list_(pa.float64()))])
STATE = pa.schema([("model", pa.int32()), ("done", pa.list_(ARROW_TREE)), ("part", ARROW_TREE), ("open", pa.list_(pa.int32())), ("round", pa.int64()), ("level", pa.int32()), ("first", pa.int32())])
TREE = "struct<feature:array<int>,bin:array<int>,left:array<boolean>,value:array<double>>"
TREES = "model int, round int, feature array<int>, bin array<int>, cut array<double>, left array<boolean>, value array<double>, gain array<double>"


@dataclass(frozen=True)
class Growth:
    """How trees grow; the defaults are the published settings."""

    rounds: int = 500
    rate: float = 0.05
    depth: int = 4
    least: int = 5
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    bins: int = 64
    seed: int = 42
    #: Rounds between two writings of the rows.
    chunk: int = 8

    @classmethod
    def of(cls, params: Mapping[str, Any]) -> Growth:
        """From the names the learner's settings bear."""
        names = {
            "maxIter": "rounds",
            "stepSize": "rate",
            "maxDepth": "depth",
            "minInstancesPerNode": "least",
            "subsamplingRate": "rows",
            "columnRate": "columns",
            "leafPenalty": "l2",
            "maxBins": "bins",
            "seed": "seed",
        }
        unknown = sorted(set(params) - set(names))
        if unknown:
            raise ValueError(f"Unknown tree settings: {unknown}.")
        return cls(**{names[k]: v for k, v in params.items()})


def number(value: Column) -> Column:
    """A feature as a double whose holes are null, to nine decimals: equal angles have equal sines on every machine."""
    return F.rint(F.nanvl(value.cast("double"), F.lit(None).cast("double")) * 1e9) / 1e9


def fit_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Per feature the upper edges of its bins: distinct values at equal shares of the given rows.

    One aggregate of bounded sketches, exact for tables of up to a hundred
    thousand rows; the driver gets at most ``bins`` numbers a feature.
    """
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(number(F.col(f)), shares, 200_000).alias(f) for f in features]).first()
    return [sorted(set(found[f] or [])) for f in features]


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """0 for null, else one more than the number of edges below the value."""
    below = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < value)) if edges else F.lit(0)
    return F.when(value.isNull(), 0).otherwise(below + 1)


def binned(rows: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]], out: str = "bins") -> DataFrame:
    """Adds the array of all features' bins."""
    return rows.withColumn(out, F.array(*[bin_of(number(F.col(f)), e) for f, e in zip(features, edges)]))


def draw(round_: int, slot: int, seed: int) -> int:
    """The counter hash of ``with_draws`` for one number below ``SHARES``, on the driver."""
    x = (round_ * 40503 + seed % _MASK) & _MASK
    x = (x * 1103515245 + slot * 2654435 + 12345) & _MASK
    for a, c in _STEPS:
        x = ((x ^ (x >> 15)) * a + c) & _MASK
    return ((x ^ (x >> 13)) * SHARES) >> 31


def open_columns(allowed: Sequence[int], round_: int, growth: Growth) -> list[int]:
    """The columns a round may split on: a fixed share of those allowed, at least one."""
    count = max(1, int(growth.columns * len(allowed)))
    return sorted(sorted(allowed, key=lambda f: (draw(round_, COLUMN_DRAWS + f, growth.seed), f))[:count])


def node_sql(tree: str, bins: str, depth: str) -> str:
    """The node a row ends in after ``depth`` steps down; it stays where no split is."""
    feature, place = f"get({tree}.feature, n)", f"get({bins}, get({tree}.feature, n))"
    left = f"CASE WHEN {place} = 0 THEN get({tree}.left, n) ELSE {place} <= get({tree}.bin, n) END"
    step = f"CASE WHEN {feature} < 0 THEN n ELSE 2 * n + CASE WHEN {left} THEN 1 ELSE 2 END END"
    return f"aggregate(filter(sequence(1, {MOST_LEVELS}), i -> i <= {depth}), 0, (n, i) -> {step})"


def predicted_sql(start: str, trees: str, bins: str, depth: str) -> str:
    """``start`` plus the leaves of all trees, added in their order."""
    return f"aggregate({trees}, {start}, (total, tree) -> total + get(tree.value, {node_sql('tree', bins, depth)}))"


@dataclass
class Tree:
    """One tree in heap order; grown on the driver from the chosen splits."""

    feature: list[int]
    bin: list[int]
    left: list[bool]
    value: list[float]
    gain: list[float]

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = (1 << (depth + 1)) - 1
        return cls([-1] * size, [0] * size, [False] * size, [0.0] * size, [0.0] * size)

    def place(self, found, growth: Growth) -> None:
        """Enters a node's best split, or its value if no split is good enough."""

        def leaf(g: int, n: int) -> float:
            return -(g / UNIT) / (n + growth.l2) * growth.rate

        node = found["node"]
        self.value[node] = leaf(found["g"], found["n"])
        if found["gain"] <= LEAST_GAIN * UNIT * UNIT:
            return
        self.feature[node], self.bin[node], self.left[node] = -found["f"], -found["b"], not found["right"]
        self.gain[node] = found["gain"] / UNIT / UNIT
        self.value[2 * node + 1] = leaf(found["gl"], found["nl"])
        self.value[2 * node + 2] = leaf(found["g"] - found["gl"], found["n"] - found["nl"])

    def splits(self, level: int) -> bool:
        first = (1 << level) - 1
        return any(f >= 0 for f in self.feature[first : 2 * first + 1])

    def row(self) -> dict[str, list]:
        return {"feature": self.feature, "bin": self.bin, "left": self.left, "value": self.value}


def level_sql(growth: Growth) -> str:
    """Per (model, node) of a level the best split and the node's totals, from ``{rows}`` and ``{state}``.

    One text with everything that changes in the state's columns, so all levels
    of all rounds are parsed alike and run the same compiled code.
    """
    steps = ", ".join(
        f"x{k + 1} AS (SELECT *, ((x{k} ^ shiftright(x{k}, 15)) * {a}L + {c}L) & {_MASK}L AS x{k + 1} FROM x{k})" for k, (a, c) in enumerate(_STEPS)
    )
    last = f"x{len(_STEPS)}"
    drawn = f"WHERE shiftright(({last} ^ shiftright({last}, 13)) * {SHARES}L, 31) < {int(growth.rows * SHARES)}" if growth.rows < 1.0 else ""

    def share(g: str, n: str) -> str:
        return f"(double({g}) * double({g}) / (double({n}) + {growth.l2!r}D))"

    def side(right: bool) -> str:
        gl, nl = ("g_low", "n_low") if right else ("(g_low + g_null)", "(n_low + n_null)")
        gr, nr = f"(g_all - {gl})", f"(n_all - {nl})"
        gain = f"{share(gl, nl)} + {share(gr, nr)} - {share('g_all', 'n_all')}"
        valid = f"b > 0 AND {nl} >= {growth.least} AND {nr} >= {growth.least}"
        return f"""struct(CASE WHEN {valid} THEN {gain} ELSE -1.0D END AS gain, -f AS f, -b AS b, {str(right).lower()} AS right,
    {gl} AS gl, {nl} AS nl, g_all AS g, n_all AS n)"""

    return f"""
WITH x0 AS (
  SELECT /*+ BROADCAST(s) */ r.model, r.row, r.y, r.pred, r.bins, s.done, s.part, s.open, s.level, s.first,
    (((s.round * 40503L + {growth.seed % _MASK}L) & {_MASK}L) * 1103515245L + r.row * 2654435L + 12345L) & {_MASK}L AS x0
  FROM {{rows}} r JOIN {{state}} s ON r.model = s.model WHERE NOT r.held),
{steps},
placed AS (
  SELECT model, open, bins, first, {node_sql('part', 'bins', 'level')} AS node,
    floor(({predicted_sql('pred', 'done', 'bins', str(growth.depth))} - y) * {UNIT} + 0.5D) AS g
  FROM {last} {drawn}),
-- A row that stopped above stands at a smaller number than this level's first.
cells AS (SELECT model, node, g, bins, explode(open) AS f FROM placed WHERE node >= first),
hist AS (SELECT model, node, f, get(bins, f) AS b, sum(g) AS g, count(*) AS n FROM cells GROUP BY model, node, f, get(bins, f)),
sums AS (
  SELECT model, node, f, b, sum(g) OVER part AS g_all, sum(n) OVER part AS n_all,
    sum(if(b > 0, g, 0L)) OVER upto AS g_low, sum(if(b > 0, n, 0L)) OVER upto AS n_low,
    sum(if(b > 0, 0L, g)) OVER part AS g_null, sum(if(b > 0, 0L, n)) OVER part AS n_null
  FROM hist
  WINDOW part AS (PARTITION BY model, node, f), upto AS (PARTITION BY model, node, f ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
best AS (SELECT model, node, max(greatest({side(True)}, {side(False)})) AS s FROM sums GROUP BY model, node)
SELECT model, node, s.* FROM best"""


@dataclass
class Forest:
    """Boosters of several models over the same features; tables, but for the edges."""

    features: list[str]
    edges: list[list[float]]
    trees: DataFrame
    bases: DataFrame
    losses: DataFrame
    growth: Growth

    def upto(self, last: DataFrame | None) -> DataFrame:
        """The trees up to round ``last`` of (model, last)."""
        return self.trees if last is None else self.trees.join(last, "model").where("round <= last")

    def importances(self, last: DataFrame | None = None) -> DataFrame:
        """(model, f, importance): average gain of a feature's splits, as a share of all features' averages."""
        nodes = self.upto(last).select("model", F.explode(F.arrays_zip("feature", "gain")).alias("s")).where("s.feature >= 0")
        average = nodes.groupBy("model", F.col("s.feature").alias("f")).agg(F.avg("s.gain").alias("gain"))
        return average.withColumn("importance", F.col("gain") / F.sum("gain").over(Window.partitionBy("model"))).select("model", "f", "importance")

    def packed(self, last: DataFrame | None = None) -> DataFrame:
        """(model, base, trees): a model's trees in order, up to round ``last`` of (model, last)."""
        trees = self.upto(last)
        # The round leads the struct, so sorting puts trees in order.
        lists = trees.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("round", "feature", "bin", "left", "value"))).alias("trees"))
        return self.bases.join(lists, "model", "left").select("model", "base", F.coalesce("trees", F.array().cast(f"array<struct<round:int,{TREE[7:]}>")).alias("trees"))

    def predict(self, rows: DataFrame, out: str, model: Column | None = None, last: DataFrame | None = None) -> DataFrame:
        """Adds the prediction of each row's model (0 if there is but one)."""
        named = binned(rows.withColumn("_model", F.lit(0) if model is None else model), self.features, self.edges, "_bins")
        packed = self.packed(last).select(F.col("model").alias("_model"), F.col("base").alias("_base"), F.col("trees").alias("_trees"))
        value = F.expr(predicted_sql("_base", "_trees", "_bins", str(self.growth.depth)))
        return named.join(packed, "_model", "left").withColumn(out, value).drop("_model", "_bins", "_base", "_trees")


def losses_of(rows: DataFrame, after: int, depth: int) -> DataFrame:
    """(model, round, loss) of held-out rows after each of the trees in ``done``; sums of whole units, so exact."""
    now = f"total.p + get(tree.value, {node_sql('tree', 'bins', str(depth))})"
    error = f"array(floor(abs({now} - y) * {UNIT} + 0.5D))"
    start = "named_struct('p', pred, 'e', cast(array() AS array<bigint>))"
    run = f"aggregate(done, {start}, (total, tree) -> named_struct('p', {now}, 'e', concat(total.e, {error})))"
    errors = rows.where("held").select("model", F.posexplode(F.expr(f"{run}.e")).alias("i", "e"))
    return errors.groupBy("model", (F.col("i") + after).cast("int").alias("round")).agg((F.sum("e") / F.count("e") / UNIT).alias("loss"))


def grow(
    rows: DataFrame,
    features: Sequence[str],
    edges: Sequence[Sequence[float]],
    growth: Growth,
    allowed: Mapping[int, Sequence[int]],
    patience: int | None = None,
) -> Forest:
    """Grows the boosters of all models in ``allowed`` (model number to the features it may use).

    ``rows`` holds model, row (a number that names the row), held (scored, not
    learned from), y and bins. With ``patience`` growth ends once every model
    with held-out rows has gone that many rounds without a lower loss.
    """
    spark = rows.sparkSession
    depth = growth.depth
    totals = rows.where(~F.col("held")).groupBy("model").agg(F.sum(F.floor(F.col("y") * UNIT + 0.5)).alias("s"), F.count(F.lit(1)).alias("n"))
    bases = cut_lineage(totals.select("model", (F.col("s") / F.col("n") / UNIT).alias("base")))
    # Rows are written with their prediction every few rounds; trees since then go along as arrays.
    current = cut_lineage(rows.select("model", "row", "held", "y", "bins").join(bases, "model").withColumnRenamed("base", "pred"))
    has_held = not current.where("held").isEmpty()
    written, losses = [], []
    tried: dict[int, list[tuple[int, float]]] = {}
    done: dict[int, list[Tree]] = {m: [] for m in allowed}
    start = 0

    def state(parts: Mapping[int, Tree], opened: Mapping[int, list[int]], round_: int = 0, level: int = 0) -> DataFrame:
        """One row a model, sent along as a literal table."""
        place = {"round": round_, "level": level, "first": (1 << level) - 1}
        rows = [{"model": m, "done": [t.row() for t in done[m]], "part": parts[m].row() if m in parts else None, "open": opened.get(m, []), **place} for m in allowed]
        return spark.createDataFrame(pa.Table.from_pylist(rows, STATE))

    def with_state() -> DataFrame:
        return current.join(F.broadcast(state({}, {})), "model")

    level_text = level_sql(growth)
    for round_ in range(growth.rounds):
        opened = {m: open_columns(allowed[m], round_, growth) for m in allowed}
        parts = {m: Tree.empty(depth) for m in allowed}
        for level in range(depth):
            for found in spark.sql(level_text, rows=current, state=state(parts, opened, round_, level)).collect():
                parts[found["model"]].place(found, growth)
            if not any(t.splits(level) for t in parts.values()):
                break
        for m, tree in parts.items():
            done[m].append(tree)
        last = round_ + 1 == growth.rounds
        if last or len(next(iter(done.values()))) == growth.chunk:
            if has_held:
                found = losses_of(with_state(), start, depth).collect()
                losses += [(r["model"], r["round"], r["loss"]) for r in found]
                for r in losses[len(losses) - len(found) :]:
                    tried.setdefault(r[0], []).append(r[1:])
            written.append(stored(spark, done, start, edges))
            stop = patience is not None and tried and all(given_up(t, patience) for t in tried.values())
            if last or stop:
                break
            value = F.expr(predicted_sql("pred", "done", "bins", str(depth)))
            current = cut_lineage(with_state().select("model", "row", "held", "y", "bins", value.alias("pred")))
            done, start = {m: [] for m in allowed}, round_ + 1
    trees = written[0]
    for more in written[1:]:
        trees = trees.unionByName(more)
    return Forest(list(features), [list(e) for e in edges], trees, bases, spark.createDataFrame(losses, "model int, round int, loss double"), growth)


def drawn(round_: int, rows: np.ndarray, growth: Growth) -> np.ndarray:
    """Which rows a round learns from, as ``level_sql`` draws them."""
    if growth.rows >= 1.0:
        return np.ones(len(rows), dtype=bool)
    x = (((round_ * 40503 + growth.seed % _MASK) & _MASK) * 1103515245 + rows * 2654435 + 12345) & _MASK
    for a, c in _STEPS:
        x = ((x ^ (x >> 15)) * a + c) & _MASK
    return ((x ^ (x >> 13)) * SHARES) >> 31 < int(growth.rows * SHARES)


def moved(tree: Tree, node: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The nodes that rows reach by one step down; they stay where no split is."""
    feature = np.array(tree.feature)[node]
    place = bins[np.arange(len(node)), np.maximum(feature, 0)]
    left = np.where(place == 0, np.array(tree.left)[node], place <= np.array(tree.bin)[node])
    return np.where(feature < 0, node, 2 * node + np.where(left, 1, 2))


def best_splits(g: np.ndarray, cells: np.ndarray, node: np.ndarray, nodes: int, width: int, growth: Growth) -> list[tuple[int, dict[str, Any]]]:
    """What ``level_sql`` finds for each node with rows; ``f`` counts the open columns. Sums are of whole numbers below 2**53."""
    columns = cells.shape[1]
    key = (node[:, None] * (columns * width) + cells).ravel()
    shape = (nodes, columns, width)
    sums = np.bincount(key, np.repeat(g, columns), nodes * columns * width).reshape(shape)
    counts = np.bincount(key, minlength=nodes * columns * width).reshape(shape).astype(np.float64)
    g_all, n_all = sums.sum(axis=2, keepdims=True), counts.sum(axis=2, keepdims=True)

    def share(g, n):
        return g * g / (n + growth.l2)

    low, n_low = np.cumsum(sums[:, :, 1:], axis=2), np.cumsum(counts[:, :, 1:], axis=2)
    sides, whole = [], share(g_all, n_all)
    for gl, nl in ((low, n_low), (low + sums[:, :, :1], n_low + counts[:, :, :1])):
        gr, nr = g_all - gl, n_all - nl
        valid = (counts[:, :, 1:] > 0) & (nl >= growth.least) & (nr >= growth.least)
        sides.append((np.where(valid, share(gl, nl) + share(gr, nr) - whole, -1.0), gl, nl))
    # Nulls to the right come first, so that the first of the best is the one that ties go to.
    gain, left_g, left_n = (np.stack(x, axis=3).reshape(nodes, -1) for x in zip(*sides))
    found = []
    for i in np.flatnonzero(n_all[:, 0, 0]).tolist():
        at = int(gain[i].argmax())
        f, rest = divmod(at, 2 * (width - 1))
        b, null_left = divmod(rest, 2)
        totals = {"g": int(g_all[i, 0, 0]), "n": int(n_all[i, 0, 0]), "gl": int(left_g[i, at]), "nl": int(left_n[i, at])}
        found.append((i, {"gain": float(gain[i, at]), "f": f, "b": -(b + 1), "right": not null_left, **totals}))
    return found


def grown(row: np.ndarray, held: np.ndarray, y: np.ndarray, pred: np.ndarray, bins: np.ndarray, allowed: Sequence[int], growth: Growth, rounds: int, patience: int | None) -> list[tuple[Tree, float | None]]:
    """One model's trees with the loss of its held-out rows after each."""
    out: list[tuple[Tree, float | None]] = []
    learned, width = np.flatnonzero(~held), max(int(bins.max(initial=0)) + 1, 2)
    best, at = float("inf"), 0
    for round_ in range(rounds):
        opened = open_columns(allowed, round_, growth)
        used = learned[drawn(round_, row[learned], growth)]
        g = np.floor((pred[used] - y[used]) * UNIT + 0.5)
        own, node, tree = bins[used], np.zeros(len(used), dtype=np.int64), Tree.empty(growth.depth)
        cells = own[:, opened] + np.arange(len(opened)) * width
        for level in range(growth.depth):
            first = (1 << level) - 1
            live = node >= first
            for i, found in best_splits(g[live], cells[live], node[live] - first, 1 << level, width, growth):
                tree.place({**found, "node": first + i, "f": -opened[found["f"]]}, growth)
            if not tree.splits(level):
                break
            node = moved(tree, node, own)
        node = np.zeros(len(row), dtype=np.int64)
        for _ in range(growth.depth):
            node = moved(tree, node, bins)
        pred = pred + np.array(tree.value)[node]
        loss = None
        if held.any():
            error = np.floor(np.abs(pred[held] - y[held]) * UNIT + 0.5)
            loss = float(error.sum()) / len(error) / UNIT
        out.append((tree, loss))
        if loss is not None and patience is not None:
            if loss < best:
                best, at = loss, round_
            elif round_ - at >= patience:
                break
    return out


def grow_in_tasks(
    rows: DataFrame,
    features: Sequence[str],
    edges: Sequence[Sequence[float]],
    growth: Growth,
    allowed: Mapping[int, Sequence[int]],
    patience: int | None = None,
    limits: Mapping[int, int] | None = None,
) -> Forest:
    """What ``grow`` gives, with every model grown in a task; a model has ``WHOLE`` rows at most.

    A model ends by itself: with held-out rows after ``patience`` rounds without a lower loss, else
    after its number of rounds in ``limits``, where it has one.
    """
    spark = rows.sparkSession
    mine = rows.where(F.col("model").isin(list(allowed)))
    totals = mine.where(~F.col("held")).groupBy("model").agg(F.sum(F.floor(F.col("y") * UNIT + 0.5)).alias("s"), F.count(F.lit(1)).alias("n"))
    bases = cut_lineage(totals.select("model", (F.col("s") / F.col("n") / UNIT).alias("base")))
    opened, most = {m: list(f) for m, f in allowed.items()}, dict(limits or {})
    cuts, names = [list(e) for e in edges], [x.split()[0] for x in TREES.split(", ")]
    numbers, whole = pa.list_(pa.float64()), pa.list_(pa.int32())
    types = dict(zip(names, [pa.int32(), pa.int32(), whole, whole, numbers, pa.list_(pa.bool_()), numbers, numbers]))

    def per_model(table: pa.Table) -> pa.Table:
        model = table.column("model")[0].as_py()
        bins = table.column("bins").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(table.num_rows, -1)
        columns = [table.column(c).to_numpy() for c in ("row", "held", "y", "base")]
        found = grown(*columns, bins, opened[model], growth, min(most.get(model, growth.rounds), growth.rounds), patience)
        rows = [tree_row(model, i, tree, cuts) for i, (tree, _) in enumerate(found)]
        arrays = [pa.array([r[i] for r in rows], types[n]) for i, n in enumerate(names)]
        return pa.Table.from_arrays([*arrays, pa.array([loss for _, loss in found], pa.float64())], names=[*names, "loss"])

    count = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    read = mine.select("model", "row", "held", "y", "bins").join(bases, "model")
    done = cut_lineage(read.repartition(min(count, max(len(opened), 1)), "model").groupBy("model").applyInArrow(per_model, TREES + ", loss double"))
    return Forest(list(features), cuts, done.drop("loss"), bases, done.where("loss IS NOT NULL").select("model", "round", "loss"), growth)


def tree_row(model: int, round_: int, t: Tree, edges: Sequence[Sequence[float]]) -> tuple:
    """A finished tree as a row of ``TREES``; a cut is the edge its bin ends at, and infinite behind the last."""

    def cut(f: int, b: int) -> float | None:
        return None if f < 0 else edges[f][b - 1] if b <= len(edges[f]) else float("inf")

    return model, round_, t.feature, t.bin, [cut(f, b) for f, b in zip(t.feature, t.bin)], t.left, t.value, t.gain


def stored(spark: SparkSession, done: Mapping[int, list[Tree]], start: int, edges: Sequence[Sequence[float]]) -> DataFrame:
    """Writes finished trees."""
    rows = [tree_row(m, start + i, t, edges) for m, trees in done.items() for i, t in enumerate(trees)]
    return cut_lineage(spark.createDataFrame(rows, TREES).coalesce(1))


def given_up(tried: Sequence[tuple[int, float]], patience: int) -> bool:
    """Whether the lowest loss lies ``patience`` rounds back."""
    ordered = sorted(tried)
    best = min(range(len(ordered)), key=lambda i: (ordered[i][1], i))
    return len(ordered) - 1 - best >= patience


def best_rounds(losses: DataFrame, patience: int | None) -> dict[int, int]:
    """Per model the zero-based round of the lowest loss, giving up ``patience`` rounds after the last improvement."""
    tried: dict[int, list[tuple[int, float]]] = {}
    for r in losses.collect():
        tried.setdefault(r["model"], []).append((r["round"], r["loss"]))
    out = {}
    for model, rounds in tried.items():
        best, at = float("inf"), 0
        for i, loss in sorted(rounds):
            if loss < best:
                best, at = loss, i
            elif patience is not None and i - at >= patience:
                break
        out[model] = at
    return out
